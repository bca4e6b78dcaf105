"""Connected components of an edge table, by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.plans.durable import durable, durable_table, forget, kept_at


def lookup(left: DataFrame, right: DataFrame, key: str, rows: int, share: int = 1000) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row for each key and in ``n`` how many rows of ``left`` have it.

    Keys with over a ``share``-th of the ``rows`` of ``left`` are at most ``share``: their rows are told by a broadcast and
    stay where they are, so that no task gets a key's rows all. The others are dealt by key.
    """
    heavy = F.broadcast(right.where(F.col("n") > rows / share).drop("n"))
    light = right.where(F.col("n") <= rows / share).drop("n")
    rest = left.join(heavy.select(key), key, "left_anti").join(light, key)
    return rest.unionByName(left.join(heavy, key))


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return lookup(both.where("v > u"), least, "u", 2 * rows).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = lookup(down, least, "u", rows).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


#: Edges from which on a graph is thinned before it is solved.
THIN = 1_000_000


def _thinned(edges: DataFrame) -> DataFrame:
    """Of each node the edges to its least and its greatest neighbour: two a node at most, and none is left without."""
    ends = []
    for a, b in (("u", "v"), ("v", "u")):
        least = edges.groupBy(a).agg(F.min(b).alias("x"), F.max(b).alias("y")).select(a, F.explode(F.array("x", "y")).alias(b))
        ends.append(least.select("u", "v"))
    return ends[0].union(ends[1]).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, thin: int = THIN, plain: bool = False) -> DataFrame:
    """Columns ``node`` and ``component`` (the least node reachable) for every node on an edge ``(u, v)``.

    Loops and repeated edges are allowed; rows with a null end are left out. An empty edge table gives an empty
    result. ``plain`` edges are a kept table without loops, nulls and repeats, and are not copied.

    From ``thin`` edges on, two edges of each node are solved first. The others are written between the components of
    these, where nearly all are loops, and what is left joins components: each edge is read twice, and rounds go over nodes.
    """
    current = edges.select("u", "v") if plain else durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if current.count() < thin:
        found = _settled(current, max_rounds)
    else:
        labels = durable_table(_settled(durable(_thinned(current)), max_rounds), "components-thinned")
        by = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"__{end}"))
        between = current.join(by("u"), "u").join(by("v"), "v").where("__u <> __v").select(F.greatest("__u", "__v").alias("u"), F.least("__u", "__v").alias("v")).distinct()
        solved = _settled(durable(between), max_rounds).select(F.col("node").alias("component"), F.col("component").alias("__new"))
        found = labels.join(solved, "component", "left").select("node", F.coalesce("__new", "component").alias("component"))
    if plain:
        return found
    loops = edges.where("u = v").select(F.col("u").alias("node")).distinct()
    alone = loops.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.union(alone)


def _settled(current: DataFrame, max_rounds: int) -> DataFrame:
    """The same for kept edges without loops, nulls and repeats. Each round is two joins on minima, so a node with very many
    neighbours costs map-side combined rows, not pairs, and its edges are not dealt to one task (``lookup``); rounds are kept
    by ``durable`` and stop when a checksum of the edge table no longer changes."""
    seen = None
    for _ in range(max_rounds):
        mark = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
        large = durable(_large_star(current, mark[0]))
        current = durable(_small_star(large, mark[0]))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labelled = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labelled.union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Edges up to which the rest of a graph is solved by one task.
SMALL = 100_000


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, into) of all nodes of the edges (u, v) of a task: the first node of their tree."""
    parent: dict = {}

    def root(x):  # noqa: ANN001, ANN202
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    schema = None
    for batch in batches:
        schema = batch.schema
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            parent[root(u)] = root(v)
    if schema is not None:
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), schema[0].type), pa.array([root(x) for x in parent], schema[0].type)], ["node", "into"])


def contracted_components(edges: DataFrame, max_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(node, component) as by ``connected_components``, but for the name of a component, which is any of its nodes, and loops,
    whose nodes are left out: for large graphs, by contraction.

    In each round a node joins whichever of itself and its neighbours comes first in an order of that round's own (a hash),
    and edges are written between the groups, so that their number falls from round to round; then what each node joined is
    followed through the rounds. ``small`` edges or fewer are solved by one task. Tables are compressed columns, and edges of a
    round are removed after the next.
    """
    spark = edges.sparkSession
    current, at = kept_at(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components-edges")
    joined = []
    for i in range(max_rounds):
        rows = current.count()
        if not rows:
            break
        if rows <= small:
            kind = current.schema["u"].dataType.simpleString()
            joined.append(kept_at(current.coalesce(1).mapInArrow(_tied, f"node {kind}, into {kind}"), "components-into"))
            break
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = lambda c: F.xxhash64(c, F.lit(i))  # noqa: E731, B023
        least = both.groupBy("u").agg(F.min_by("v", first("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        into, into_at = kept_at(least.select(F.col("u").alias("node"), F.when(first("u") < first("m"), F.col("u")).otherwise(F.col("m")).alias("into"), "n"), "components-into")
        by = lambda end: into.select(F.col("node").alias(end), F.col("into").alias(f"__{end}"), "n")  # noqa: E731, B023
        half, half_at = kept_at(lookup(current, by("u"), "u", rows).select("__u", "v"), "components-half")  # as a look-up reads it twice
        moved = lookup(half, by("v"), "v", rows).where("__u <> __v")
        current, next_at = kept_at(moved.select(F.greatest("__u", "__v").alias("u"), F.least("__u", "__v").alias("v")).distinct(), "components-edges")
        joined.append((into.drop("n"), into_at))
        forget(spark, at, half_at)
        at = next_at
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    forget(spark, at)
    if not joined:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).limit(0)
    found, found_at = joined.pop()
    found = found.withColumnRenamed("into", "component")
    while joined:
        into, into_at = joined.pop()
        counts = into.groupBy(F.col("into")).agg(F.count(F.lit(1)).alias("n"))
        named = counts.join(found.withColumnRenamed("node", "into"), "into", "left").select("into", F.coalesce("component", "into").alias("component"), "n")
        found, next_at = kept_at(lookup(into, named, "into", into.count()).select("node", "component"), "components-found")
        forget(spark, into_at, found_at)
        found_at = next_at
    return found


def _solved(edges: DataFrame) -> DataFrame:
    """``contracted_components``, the nodes of loops included."""
    found = contracted_components(edges)
    loops = edges.where("u = v").select(F.col("u").alias("node")).distinct()
    return found.union(loops.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))


def nested_components(edges: DataFrame, steps: int) -> DataFrame:
    """Components of growing graphs: (node, step, component) for each node of graph ``step``, which has the edges (u, v, step)
    of that step and of those before it, from 0 to ``steps`` - 1.

    Every edge is worked on once: those that a step adds are written between the components of the step before, and only
    the graph of these is solved. ``component`` names the node's component within its step.
    """
    spark, labels, out = edges.sparkSession, None, []
    for step in range(steps):
        added = edges.where(F.col("step") == step).select("u", "v")
        if labels is None:
            labels = durable_table(_solved(added), "components-0")
        else:
            by = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"__{end}"))  # noqa: E731, B023
            between = added.join(by("u"), "u", "left").join(by("v"), "v", "left").select(F.coalesce("__u", "u").alias("u"), F.coalesce("__v", "v").alias("v"))
            kept, kept_path = kept_at(between.distinct(), f"components-between-{step}")
            solved = durable_table(_solved(kept), f"components-joined-{step}")
            forget(spark, kept_path)
            # A component is named by one of its nodes, so old and new nodes are told alike; those that nothing touched stay.
            moved = solved.select(F.col("node").alias("component"), F.col("component").alias("__new"))
            old = labels.join(moved, "component", "left").select("node", F.coalesce("__new", "component").alias("component"))
            labels = durable_table(old.unionByName(solved.join(labels.select("node"), "node", "left_anti")), f"components-{step}")
        out.append(labels.select("node", F.lit(step).alias("step"), "component"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "node string, step int, component string")
