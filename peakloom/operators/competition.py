"""Who else is near: number, sum, best and better ones of the other candidates at a locus, without a list for each row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from peakloom.operators.quantiles import at_or_better
from peakloom.plans.durable import durable_table

FOUND = [StructField("__n", LongType()), StructField("__total", DoubleType()), StructField("__best", DoubleType()), StructField("__better", LongType())]


def better_in(score: np.ndarray, low: np.ndarray, high: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How many of ``score[low:high]`` exceed ``own``, for each query: one pass over the ranks' bits, highest first, in which the
    rows are parted by the bit and each query follows its own bit."""
    values, rank = np.unique(score, return_inverse=True)
    bar = np.searchsorted(values, own, side="right")  # ranks from here on are better
    count, a, b = np.zeros(len(own), np.int64), low.astype(np.int64), high.astype(np.int64)
    for k in reversed(range(len(values).bit_length())):
        on = (rank >> k) & 1
        ones = np.concatenate([[0], np.cumsum(on)])
        follow = (bar >> k) & 1 == 1
        count += np.where(follow, 0, ones[b] - ones[a])
        zeros = len(rank) - ones[-1]
        a, b = np.where(follow, zeros + ones[a], a - ones[a]), np.where(follow, zeros + ones[b], b - ones[b])
        rank = np.concatenate([rank[on == 0], rank[on == 1]])
    return count + b - a


def highest_in(score: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest of ``score[low:high]`` for each query, minus infinity where there is none: two stretches of a power of two."""
    found, length, top, size = np.full(len(low), -np.inf), high - low, score, 1
    while len(top):
        these = np.flatnonzero((length >= size) & (length < 2 * size))
        found[these] = np.maximum(top[low[these]], top[high[these] - size])
        top, size = np.maximum(top[:-size], top[size:]), 2 * size
    return found


def _among(rt: np.ndarray, score: np.ndarray, low: np.ndarray, high: np.ndarray, own: np.ndarray, self_at: np.ndarray) -> list[np.ndarray]:
    """Number, sum, best other and number of better ones among the rows, sorted by ``rt``, with rt from ``low`` to ``high``. The
    query's own row stands at ``self_at``, -1 if not here."""
    a, b = np.searchsorted(rt, low, "left"), np.searchsorted(rt, high, "right")
    sums = np.concatenate([[0], np.cumsum(score.astype(np.longdouble))])
    inside = self_at >= 0
    best = np.maximum(highest_in(score, a, np.where(inside, self_at, b)), highest_in(score, np.where(inside, self_at + 1, b), b))
    return [b - a, (sums[b] - sums[a]).astype(float), best, better_in(score, a, b, own)]


def _with(table: pa.Table, found: list[np.ndarray]) -> pa.Table:
    for name, values in zip(("__n", "__total", "__best", "__better"), found, strict=True):
        table = table.append_column(name, pa.array(values))
    return table


def rivals(df: DataFrame, group: Column, place: Column, score: Column, tol: float, blocks_of: float, most: int) -> DataFrame:
    """Rows of ``df`` (none of the three null) with, among the rows of their ``group`` within ``tol`` of their ``place``, ends
    included and the row itself counted: ``__n`` rows, their score's sum ``__total``, the best other score ``__best`` (minus
    infinity without), and ``__better`` rows of a strictly higher score.

    Groups are cut into blocks of ``blocks_of`` tolerances; rows near an edge also go to the next block as rivals. A block is
    searched by one task in n log n steps. Blocks of more than ``most`` rows are cut by place into pieces of about that many, see
    ``_crowded``; the driver learns only how many rows the largest has.
    """
    span = tol * blocks_of
    block = lambda x: F.floor(x / F.lit(span))
    at = df.select(F.struct("*").alias("__row"), group.alias("__g"), place.cast("double").alias("__rt"), score.cast("double").alias("__s")).withColumn("__own", block(F.col("__rt")))
    near = F.array_distinct(F.array(block(F.col("__rt") - tol), F.col("__own"), block(F.col("__rt") + tol)))
    spread = at.withColumn("__block", F.explode(near)).withColumn("__mine", F.col("__block") == F.col("__own")).withColumn("__row", F.when(F.col("__mine"), F.col("__row"))).drop("__own")
    crowds = spread.groupBy("__g", "__block").agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") > most)
    largest = crowds.agg(F.max("__size")).first()[0]

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("__rt")
        rt, s, mine = (table[c].to_numpy() for c in ("__rt", "__s", "__mine"))
        here = np.flatnonzero(mine)
        found = _among(rt, s, rt[here] - tol, rt[here] + tol, s[here], here)
        return _with(table.take(here).select(["__row"]), found)

    kept = StructType([spread.schema["__row"], *FOUND])
    light = spread
    if largest is not None:
        # Crowds are blocks with more than ``most`` rows each, so there are few of them beside the rows.
        light = spread.join(F.broadcast(crowds), ["__g", "__block"], "left_anti")
    found = light.groupBy("__g", "__block").applyInArrow(search, kept)
    if largest is not None:
        found = found.unionByName(_crowded(spread.join(F.broadcast(crowds.drop("__size")), ["__g", "__block"], "left_semi"), tol, most, -(-largest // most)))
    return found.select("__row.*", "__n", "__total", "__best", "__better")


def _crowded(spread: DataFrame, tol: float, most: int, parts: int) -> DataFrame:
    """The same for crowded blocks. A block is cut at about ``parts`` quantiles of place: odd pieces hold the places of one cut,
    even ones what lies between two. A row's neighbourhood is whole pieces and at most two pieces in part. Whole ones are a
    few nodes of a binary tree over the pieces, whose sums are plain aggregates and whose ranks are running counts by score in
    ranges; those in part, never a single place, are searched by a task with about ``most`` of its rows, queries dealt likewise.
    """
    by, fields = ["__g", "__block"], ["n", "total", "best", "better"]
    rows = durable_table(spread.withColumn("__id", F.monotonically_increasing_id()), "crowded-loci")
    cuts = rows.groupBy(*by).agg(F.array_distinct(F.percentile_approx("__rt", F.array(*(F.lit(i / (parts + 1)) for i in range(1, parts + 1))), F.lit(100 * (parts + 1)))).alias("__cuts"))
    piece = lambda x: 2 * F.size(F.filter("__cuts", lambda c: c < x)) + F.array_contains("__cuts", x).cast("int")
    low, high = F.col("__rt") - tol, F.col("__rt") + tol
    placed = rows.select(*by, "__id", "__rt", "__s", "__mine").join(F.broadcast(cuts), by).select(
        *by, "__id", "__rt", "__s", "__mine", piece(F.col("__rt")).alias("piece"), low.alias("low"), high.alias("high"), piece(low).alias("from"), piece(high).alias("to")
    )
    placed = durable_table(placed, "crowded-pieces")
    asks = placed.where("__mine")

    # Pieces in part.
    partly = asks.withColumn("piece", F.explode(F.array_distinct(F.array("from", "to")))).where("piece % 2 = 0").select(*by, "piece", "__id", "__s", "low", "high")
    dealt = partly.groupBy(*by, "piece").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("tasks"))  # a row for each piece
    asked = partly.join(F.broadcast(dealt), [*by, "piece"]).withColumn("task", F.pmod(F.xxhash64("__id"), "tasks").cast("int")).drop("tasks")
    there = placed.select(*by, "piece", "__id", "__rt", "__s").join(F.broadcast(dealt), [*by, "piece"]).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    key = [*by, "piece", "task"]
    # Both sides come from one table, so one has its columns named anew.
    there = there.select(*(F.col(c).alias(f"at{c}") for c in [*key, "__id", "__rt", "__s"]))

    def search(some: pa.Table, queries: pa.Table) -> pa.Table:
        some = some.sort_by("at__rt")
        rt, s, ids = (some[c].to_numpy() for c in ("at__rt", "at__s", "at__id"))
        mine, low, high, own = (queries[c].to_numpy() for c in ("__id", "low", "high", "__s"))
        order = np.argsort(ids)
        place = np.minimum(np.searchsorted(ids[order], mine), max(len(ids) - 1, 0))
        self_at = np.where(ids[order][place] == mine, order[place], -1) if len(ids) else np.full(len(mine), -1)
        return pa.table([queries["__id"], *map(pa.array, _among(rt, s, low, high, own, self_at))], names=["__id", *fields])

    in_part = asked.groupBy(*key).cogroup(there.groupBy(*(f"at{c}" for c in key))).applyInArrow(lambda q, d: search(d, q), "__id bigint, n bigint, total double, best double, better bigint")

    # Whole pieces, as nodes.
    levels = (2 * parts + 1).bit_length()
    node = [*by, "level", "node"]
    step = lambda a, i: F.struct(
        F.shiftright(a["u"] + a["u"] % 2, 1).alias("u"), F.shiftright(a["v"] - (1 - a["v"] % 2), 1).alias("v"),
        F.when(a["u"] <= a["v"], F.concat(a["nodes"], F.filter(F.array(
            F.when(a["u"] % 2 == 1, F.struct(i.alias("level"), a["u"].alias("node"))),
            F.when((a["v"] % 2 == 0) & ~((a["u"] % 2 == 1) & (a["u"] == a["v"])), F.struct(i.alias("level"), a["v"].alias("node"))),
        ), lambda x: x.isNotNull()))).otherwise(a["nodes"]).alias("nodes"),
    )
    first = F.struct((F.col("from") + 1 - F.col("from") % 2).alias("u"), (F.col("to") - 1 + F.col("to") % 2).alias("v"), F.array().cast("array<struct<level:int,node:int>>").alias("nodes"))
    wholly = asks.select(*by, "__id", "__s", F.inline(F.aggregate(F.sequence(F.lit(0), F.lit(levels)), first, step, lambda a: a["nodes"])))
    leaves = placed.select(*by, "__id", "__s", "piece", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")).withColumn("node", F.expr("shiftright(piece, level)")).drop("piece")
    top = leaves.groupBy(*node).agg(F.count(F.lit(1)).alias("n"), F.sum("__s").alias("total"), F.max(F.struct("__s", "__id")).alias("top"))
    second = leaves.join(F.broadcast(top.select(*node, "top")), node).where(F.col("top.__id") != F.col("__id")).groupBy(*node).agg(F.max("__s").alias("second"))
    whole = top.join(second, node, "left")  # a row for each node
    counts = leaves.select(*node, "__s", F.lit(1).alias("w")).unionByName(wholly.select(*node, "__s", F.lit(0).alias("w")))
    above = at_or_better(counts, node, "__s", {"better": F.col("w")}, strictly=True).withColumnRenamed("value", "__s")
    best = F.coalesce(F.when(F.col("top.__id") == F.col("__id"), F.col("second")).otherwise(F.col("top.__s")), F.lit(float("-inf")))
    by_node = wholly.join(F.broadcast(whole), node).join(above, [*node, "__s"]).select("__id", "n", "total", best.alias("best"), "better")

    sums = in_part.unionByName(by_node).groupBy("__id").agg(F.sum("n").alias("__n"), F.sum("total").alias("__total"), F.max("best").alias("__best"), F.sum("better").alias("__better"))
    return rows.where("__mine").join(sums, "__id").select("__row", "__n", "__total", "__best", "__better")
