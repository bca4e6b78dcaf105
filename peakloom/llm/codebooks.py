"""Codes of vectors by one codebook for each part, fitted by Lloyd rounds that skip what the triangle inequality rules out."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.common import map_batches
from peakloom.llm.vectors import embeddings, is_whole, reach, scaled
from peakloom.operators.graph import lookup
from peakloom.plans.durable import durable_table

#: The largest distance, in the units that bounds are kept in.
FAR = 30_000


def squared(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances of parts (rows, parts, width) to all entries of their codebooks (parts, entries, width)."""
    most = max(abs(x).max(initial=0), abs(books).max(initial=0))
    kind = np.float64 if 4.0 * most * most * max(1, x.shape[2]) < 1 << 53 else np.int64
    cross = np.matmul(x.transpose(1, 0, 2).astype(kind), books.transpose(0, 2, 1).astype(kind)).transpose(1, 0, 2).astype(np.int64)
    return (x * x).sum(axis=2)[:, :, None] + (books * books).sum(axis=2) - 2 * cross


def root(square: np.ndarray) -> np.ndarray:
    """The largest whole number whose square is at most ``square``."""
    r = np.sqrt(square.astype(np.float64)).astype(np.int64)
    return r - (r * r > square)


class Bounds:
    """Distances as whole numbers of a unit that brings the largest possible one to ``FAR`` or less: lower bounds are
    rounded down and upper ones up, so that what they rule out is ruled out strictly."""

    def __init__(self, most: int, width: int):
        self.unit = max(1, ceil(2 * most * sqrt(width) / FAR))

    def lower(self, square: np.ndarray) -> np.ndarray:
        return root(square) // self.unit

    def upper(self, square: np.ndarray) -> np.ndarray:
        r = root(square)
        return -(-(r + (r * r < square)) // self.unit)


def nearest(x: np.ndarray, books: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first assignment: of each part its nearest entry (ties to the lower index), the upper bound of the distance to it
    and a lower bound for each entry, all of them measured."""
    d = squared(x, books)
    return d.argmin(axis=2), bounds.upper(d.min(axis=2)), bounds.lower(d)


def moved(code: np.ndarray, upper: np.ndarray, lower: np.ndarray, x: np.ndarray, old: np.ndarray, new: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the entries moved from ``old`` to ``new``, and the number of distances that had to be measured.

    Bounds are shifted by how far each entry moved. A part stays with its entry if the upper bound is under half the
    distance from that entry to the next one; else its distance is measured, and those to the entries that neither their
    lower bound nor their distance from its entry rules out. Only strictly worse entries are ruled out, and measured
    ones are compared as whole numbers, so ties go to the lower index as in a full search.
    """
    part, (n, parts, k) = np.arange(x.shape[1]), lower.shape
    step = bounds.upper(((new - old) ** 2).sum(axis=2))
    upper = np.minimum(upper + step[part, code], FAR)
    lower = np.maximum(lower - step, 0)
    apart = bounds.lower(((new[:, :, None] - new[:, None]) ** 2).sum(axis=3))
    apart[:, np.arange(k), np.arange(k)] = 2 * FAR + 2  # an entry is no rival of its own
    row, p = np.nonzero(2 * upper >= apart.min(axis=2)[part, code])
    if not len(row):
        return code, upper, lower, 0
    mine, at = code[row, p], x[row, p]
    own = ((at - new[p, mine]) ** 2).sum(axis=1)
    low, up = lower[row, p], bounds.upper(own)
    low[np.arange(len(row)), mine] = bounds.lower(own)
    i, c = np.nonzero((low <= up[:, None]) & (apart[p, mine] <= 2 * up[:, None]))
    d = ((at[i] - new[p[i], c]) ** 2).sum(axis=1)
    low[i, c] = bounds.lower(d)
    best, choice = own.copy(), mine.copy()
    np.minimum.at(best, i, d)
    choice[best < own] = k
    tie = d == best[i]
    np.minimum.at(choice, i[tie], c[tie])
    code, upper, lower = code.copy(), upper.copy(), lower.copy()
    code[row, p], upper[row, p], lower[row, p] = choice, bounds.upper(best), low
    return code, upper, lower, len(row) + len(i)


def _raw(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _cells(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape).astype(np.int64)


_STATE = "x binary, code binary, upper binary, lower binary, n_measured bigint"


def encode(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> DataFrame:
    """For each row with a whole vector: its id and label, ``code`` (array of the nearest entry's index for each part),
    ``error`` (squared distances summed), ``n_measured`` (distances measured after the first assignment) and
    ``codebooks_sha256``.

    Components count as ``floor(scale * x)``. Vectors are cut into ``parts`` equal consecutive parts, each with a codebook
    that begins as that part of the ``entries`` rows with the smallest ids (at most 256; null ids last, ties by label and
    vector). Each of ``rounds`` assigns every part to its nearest entry and replaces entries by the floor of their parts'
    mean; unused ones stay. Then parts are assigned once more.

    Rows whose vector is null or holds a null or a component that is not finite are left out. Empty and shorter vectors
    are padded with zeros to the longest, and that to a multiple of ``parts``. Fewer rows than ``entries`` give a smaller
    codebook; repeated rows are coded alike; null ids and labels are kept; other columns are not read; an empty table
    gives an empty result. Between rounds the bounds of each row are kept in the shared folder; what the driver gets is
    sums for each entry of a codebook, whatever the number of rows.
    """
    spark = rows.sparkSession
    if not 0 < entries <= 256:
        raise ValueError("an index is one byte")
    able = rows.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"), F.col(vector_col).alias("__vector")).where(is_whole("__vector"))
    ids = ", ".join(f"{c} {able.schema[c].dataType.simpleString()}" for c in ("__id", "__label"))
    first = able.orderBy(F.asc_nulls_last("__id"), F.asc_nulls_last("__label"), "__vector").limit(entries).select("__vector").toArrow().column(0).combine_chunks()
    longest, most = able.agg(F.coalesce(F.max(F.size("__vector")), F.lit(0)), F.coalesce(F.max(reach("__vector")), F.lit(0.0))).first()
    if not len(first):
        return spark.createDataFrame([], f"{ids}, code array<int>, error bigint, n_measured bigint, codebooks_sha256 string").withColumnsRenamed({"__id": id_col, "__label": label_col})
    width = max(1, ceil(longest / parts))
    books = scaled(first, scale, parts * width).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    k, small = books.shape[1], np.int16 if most * abs(scale) + 1 < 1 << 15 else np.int32
    bounds = Bounds(ceil(min(most * abs(scale) + 1, 1 << 26)), width)

    def state(batch: pa.RecordBatch, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, measured: int) -> pa.RecordBatch:
        counted = pa.array([measured] + [0] * (len(x) - 1), pa.int64())[: len(x)]
        return pa.record_batch([batch.column(0), batch.column(1), _raw(x.astype(small)), _raw(code.astype(np.uint8)), _raw(upper.astype(np.uint16)), _raw(lower.astype(np.uint16)), counted], names=["__id", "__label", "x", "code", "upper", "lower", "n_measured"])

    def begin(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = scaled(batch.column(2), scale, parts * width).reshape(-1, parts, width)
        return state(batch, x, *nearest(x, books_at[0], bounds), 0)

    def again(old: np.ndarray, new: np.ndarray):
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = _cells(batch.column("x"), small, parts, width)
            return state(batch, x, *moved(_cells(batch.column("code"), np.uint8, parts), _cells(batch.column("upper"), np.uint16, parts), _cells(batch.column("lower"), np.uint16, parts, k), x, old, new, bounds))

        return step

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a task's rows for each entry, the last of each being their number."""
        sums = np.zeros((parts * k, width + 1), np.int64)
        for batch in batches:
            x, code = _cells(batch.column(0), small, parts, width), _cells(batch.column(1), np.uint8, parts)
            np.add.at(sums, (code + np.arange(parts) * k).ravel(), np.concatenate([x, np.ones_like(x[:, :, :1])], axis=2).reshape(-1, width + 1))
        at = np.flatnonzero(sums)
        yield pa.record_batch([at, sums.ravel()[at]], names=["at", "sum"])

    books_at = [books]
    kept = durable_table(map_batches(able, begin, f"{ids}, {_STATE}"), "codebooks-0")
    for r in range(1, rounds + 1):
        sums = np.zeros((parts, k, width + 1), np.int64)
        for at, value in kept.select("x", "code").mapInArrow(total, "at bigint, sum bigint").groupBy("at").agg(F.sum("sum")).collect():
            sums.ravel()[at] = value
        old, n = books_at[-1], sums[:, :, width:]
        books_at.append(np.where(n > 0, sums[:, :, :width] // np.maximum(n, 1), old))
        kept = durable_table(map_batches(kept, again(old, books_at[-1]), f"{ids}, {_STATE}"), f"codebooks-{r}")
    final = books_at[-1]

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, code = _cells(batch.column("x"), small, parts, width), _cells(batch.column("code"), np.uint8, parts)
        error = ((x - final[np.arange(parts), code]) ** 2).sum(axis=(1, 2))
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(code.astype(np.int32).tolist(), pa.list_(pa.int32())), error, batch.column("n_measured")], names=["__id", "__label", "code", "error", "n_measured"])

    digest = sha256(",".join(map(str, final.ravel().tolist())).encode()).hexdigest()
    found = map_batches(kept.select("__id", "__label", "x", "code", "n_measured"), finish, f"{ids}, code array<int>, error bigint, n_measured bigint")
    return found.withColumn("codebooks_sha256", F.lit(digest)).withColumnsRenamed({"__id": id_col, "__label": label_col})


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's code and error, with the error of all rows of its label. A label can hold most rows: sums are combined
    before the shuffle, and frequent labels are told by a broadcast of bounded size."""
    coded = durable_table(encode(embeddings(spark, sf_dir)), "codebooks-codes")
    keyed = coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    by_label = keyed.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("bigint")), 2, "0"))), "")
    return lookup(keyed, by_label, "key", coded.count()).select("vec_id", code.alias("code"), "error", "label_error", "codebooks_sha256")


def _round(i: int) -> str:
    """CTEs of one assignment to codebook ``c{i}``, and of the codebook after it."""
    gap = "list_sum(list_transform(x, lambda v, j: (v - c[j]) * (v - c[j])))"
    return (
        f", a{i} AS (SELECT row, p, any_value(x) AS x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT row, x.p, x, e, {gap} AS d FROM x JOIN c{i} ON x.p = c{i}.p) GROUP BY row, p)"
        f", s{i} AS (SELECT p, e, j, floor(sum(v) / count(*))::BIGINT AS v FROM (SELECT p, e, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS j FROM a{i}) GROUP BY p, e, j)"
        f", c{i + 1} AS (SELECT c{i}.p, c{i}.e, coalesce(z.c, c{i}.c) AS c FROM c{i} LEFT JOIN (SELECT p, e, list(v ORDER BY j) AS c FROM s{i} GROUP BY p, e) z ON z.p = c{i}.p AND z.e = c{i}.e)"
    )


#: The same by a full search.
CODES_SQL = (
    "WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),"
    " x AS (SELECT row, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM k, range(16) AS g(p)),"
    " c0 AS (SELECT p, row - 1 AS e, x AS c FROM x WHERE row <= 64)"
    + _round(0) + _round(1) + _round(2)
    + ", h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, j)) AS h FROM (SELECT p, e, unnest(c) AS v, unnest(range(1, len(c) + 1)) AS j FROM c2))"
    ", r AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY row)"
    " SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM k JOIN r USING (row), h"
)
