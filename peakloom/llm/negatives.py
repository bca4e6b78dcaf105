"""Hard negatives: each anchor's scores sorted in full, block by block, and read from every positive's upper limit on."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakloom.llm.vectors import embeddings, is_whole, products, reach, scaled
from peakloom.plans.durable import durable_table

#: Rows and anchors of a block: a task holds the scores of one pair of blocks, some two million.
ROWS, ANCHORS = 4096, 512
#: Blocks of each kind that meet in one cell of the grid, once there are far more pairs than tasks.
SIDE = 16
#: Score of a row with itself, which is nobody's positive.
SELF = -(1 << 62)
_ROWS = "block bigint, row_ids binary, row_labels binary, row_vectors binary, is_anchor binary"
_ANCHORS = "block bigint, uids binary, labels binary, vectors binary, limits binary"


def _cut(rows: DataFrame, size: int, partitions: int, build: Callable[[pa.Table, int], list], schema: str) -> DataFrame:
    """``rows`` dealt evenly, whatever they hold, and each ``size`` of a partition (or what is left) made one row by ``build``,
    which is given their table and a block number."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), *[pa.binary()] * (len(names) - 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, block = [], 0, TaskContext.get().partitionId() << 24

        def made() -> pa.RecordBatch:
            cells = [block, *build(pa.Table.from_batches(held), block)]
            return pa.record_batch([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names=names)

        for batch in batches:
            while batch.num_rows:
                part, batch = batch.slice(0, size - n), batch.slice(size - n)
                held.append(part)
                n += part.num_rows
                if n == size:
                    yield made()
                    held, n, block = [], 0, block + 1
        if n:
            yield made()

    return rows.repartition(partitions).mapInArrow(run, schema)


def _meet(anchors: DataFrame, rows: DataFrame, step: Callable[..., tuple], schema: str) -> DataFrame:
    """``step`` on every pair of an anchor block and a row block: the two are dealt to the cells of a grid, each cell getting
    some blocks of both, so a pair meets once and no block goes to more than the cells of its line."""
    n_anchors, n_rows = anchors.count(), rows.count()
    side = min(SIDE, max(1, isqrt(n_anchors * n_rows // 200)))
    down, across = max(1, ceil(n_anchors / side)), max(1, ceil(n_rows / side))
    cell = lambda n: F.pmod(F.shiftright("block", 24) * 7 + F.col("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = min(down * across, 20_000)
    left = anchors.withColumn("i", cell(down)).drop("block").withColumn("j", every(across))
    right = rows.drop("is_anchor").withColumn("j", cell(across)).withColumn("i", every(down))
    pairs = left.repartition(tasks, "i", "j").hint("merge").join(right.repartition(tasks, "i", "j"), ["i", "j"]).drop("i", "j")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = step(**{c: batch.column(c)[i].as_buffer() if pa.types.is_binary(batch.schema.field(c).type) else batch.column(c)[i].as_py() for c in batch.schema.names})
                yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in found], names=names)

    return pairs.mapInArrow(run, schema)


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``: for each row that
    ``anchor`` holds of and each of its first ``positives`` other rows of its label, the first ``negatives`` rows of other
    labels whose score is from ``low`` to ``high`` percent of the positive's.

    Components count as ``floor(scale * x)``; a score is the inner product with the anchor; higher scores come first, ties
    by smaller id. Ids and labels are whole numbers. Rows with a null id, label or vector, or a component that is null or
    not finite, take no part; empty vectors score 0, shorter ones are padded with zeros. Each of several rows with one id
    is a row of its own (and each an anchor of its own). Other columns are not read, and an empty table gives an empty
    result.

    Every anchor is scored against every row, in pairs of blocks of bounded size; nothing is pruned. Only the first few of
    each anchor and block leave a task.
    """
    spark = rows.sparkSession
    given = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    able = given.where(F.col("id").isNotNull() & F.col("label").isNotNull() & is_whole("vector"))
    n, n_anchors, width, most = able.agg(F.count(F.lit(1)), F.count_if("anchor"), F.coalesce(F.max(F.size("vector")), F.lit(0)), F.coalesce(F.max(reach("vector")), F.lit(0.0))).first()
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not n_anchors:
        return spark.createDataFrame([], schema)
    width, kind = max(1, width), np.dtype(np.int16 if most * abs(scale) + 1 < 1 << 15 else np.int32)
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = lambda rows_, size: max(1, min(ceil(rows_ / size), max(shuffled, ceil(rows_ / (64 * size)))))

    def row_block(t: pa.Table, block: int) -> list:
        """A block's rows in order of id, so that a stable sort by score leaves ties in that order."""
        ids = t["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x = scaled(t["vector"].combine_chunks(), scale, width)[order].astype(kind)
        return [ids[order].tobytes(), t["label"].to_numpy()[order].tobytes(), x.tobytes(), t["anchor"].to_numpy()[order].astype(np.uint8).tobytes()]

    blocks = durable_table(_cut(able, ROWS, tasks(n, ROWS), row_block, _ROWS), "negatives-rows")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The anchors of the blocks. A row is told by its block and its place there, as ids may repeat."""
        for batch in batches:
            for block, ids, labels, vectors, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.flatnonzero(np.frombuffer(marks, np.uint8))
                x = np.frombuffer(vectors, kind).reshape(-1, width)
                yield pa.record_batch([block * ROWS + at, np.frombuffer(ids, np.int64)[at], np.frombuffer(labels, np.int64)[at], pa.array([r.tobytes() for r in x[at]], pa.binary())], names=["uid", "anchor_id", "label", "vector"])

    anchors = durable_table(blocks.mapInArrow(pick, "uid bigint, anchor_id bigint, label bigint, vector binary"), "negatives-anchors")

    def anchor_block(t: pa.Table, _: int) -> list:
        """Anchors; with their positives' scores, if there are any yet, highest first and padded with the least number."""
        limits = np.full((t.num_rows, positives), SELF, np.int64)
        if "scores" in t.column_names:
            for row, scores in zip(limits, t["scores"].to_pylist(), strict=True):
                row[: len(scores)] = scores
        return [t["uid"].to_numpy().tobytes(), t["label"].to_numpy().tobytes(), b"".join(t["vector"].to_pylist()), limits.tobytes()]

    def sides(labels, vectors, row_labels, row_vectors):
        return np.frombuffer(labels, np.int64), np.frombuffer(vectors, kind).reshape(-1, width), np.frombuffer(row_labels, np.int64), np.frombuffer(row_vectors, kind).reshape(-1, width)

    def same_label(uids, labels, vectors, limits, block, row_ids, row_labels, row_vectors):
        mine_, x, theirs, y = sides(labels, vectors, row_labels, row_vectors)
        uids, row_ids, found = np.frombuffer(uids, np.int64), np.frombuffer(row_ids, np.int64), ([], [], [])
        for label in np.unique(mine_):
            a, b = np.flatnonzero(mine_ == label), np.flatnonzero(theirs == label)
            score = products(x[a], y[b]).astype(np.int64)
            score[uids[a][:, None] == block * ROWS + b] = SELF
            first = np.argsort(-score, axis=1, kind="stable")[:, :positives]
            best = np.take_along_axis(score, first, axis=1)
            ok = best != SELF
            for out, values in zip(found, (np.repeat(uids[a], ok.sum(axis=1)), row_ids[b][first][ok], best[ok]), strict=True):
                out.append(values)
        return found

    def other_labels(uids, labels, vectors, limits, block, row_ids, row_labels, row_vectors):
        mine_, x, theirs, y = sides(labels, vectors, row_labels, row_vectors)
        uids, row_ids, tops = np.frombuffer(uids, np.int64), np.frombuffer(row_ids, np.int64), np.frombuffer(limits, np.int64).reshape(-1, positives)
        down = -products(x, y)
        order, found = np.argsort(down, axis=1, kind="stable"), ([], [], [], [])
        for i, top in enumerate(tops):
            top = top[top != SELF]
            at = order[i][theirs[order[i]] != mine_[i]]
            score = down[i][at]
            begin = np.searchsorted(score, -(high * top // 100))  # the first of at most that score
            take = begin[:, None] + np.arange(negatives)
            ok = take < len(at)
            ok[ok] = (100 * -score[take[ok]].astype(np.int64) >= np.repeat(low * top, ok.sum(axis=1)))
            k = np.repeat(np.arange(len(top)), ok.sum(axis=1))
            for out, values in zip(found, (np.full(len(k), uids[i]), k, row_ids[at[take[ok]]], -score[take[ok]].astype(np.int64)), strict=True):
                out.append(values)
        return found

    cut = lambda df: durable_table(_cut(df, ANCHORS, tasks(n_anchors, ANCHORS), anchor_block, _ANCHORS), "negatives-anchor-blocks")
    near = _meet(cut(anchors), blocks, same_label, "uid bigint, positive_id bigint, score bigint")
    place = F.row_number().over(W.partitionBy("uid").orderBy(F.desc("score"), "positive_id")).alias("place")
    chosen = near.select("*", place).where(F.col("place") <= positives)
    listed = durable_table(chosen.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("place", "score", "positive_id"))).alias("p")), "negatives-positives")
    asked = cut(anchors.join(listed.select("uid", F.col("p.score").alias("scores")), "uid"))
    far = _meet(asked, blocks, other_labels, "uid bigint, k bigint, negative_id bigint, negative_score bigint")
    rank = F.row_number().over(W.partitionBy("uid", "k").orderBy(F.desc("negative_score"), "negative_id")).alias("rank")
    taken = far.select("*", rank).where(F.col("rank") <= negatives)
    named = anchors.select("uid", "anchor_id").join(listed, "uid").select("uid", "anchor_id", F.posexplode("p").alias("k", "p"))
    found = taken.join(named.withColumn("k", F.col("k").cast("bigint")), ["uid", "k"])
    return found.select("anchor_id", F.col("p.positive_id").alias("positive_id"), "rank", "negative_id", F.col("p.score").alias("positive_score"), "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings(spark, sf_dir).withColumn("label", moved), F.col("vec_id") % 50 == 0)


#: The same by every pair of an anchor and a row.
NEGATIVES_SQL = """
WITH k AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM k a JOIN k b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id))::INT AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3
"""
