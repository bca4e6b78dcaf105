"""What the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a step takes at once. Spark bounds an Arrow batch by bytes; texts grow in Python, so batches are cut again.
BATCH_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def crc_mod(id_col: str, k: int) -> Column:
    """crc32 of the id's decimal text, modulo ``k``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % k


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """``step`` on ``df``, ``BATCH_ROWS`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                yield step(batch.slice(at, BATCH_ROWS))

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sample_by(docs: DataFrame, class_col: str, per_class: int, id_col: str = "doc_id", most_classes: int = 256) -> DataFrame:
    """About ``per_class`` rows of each of the ``most_classes`` most frequent values of ``class_col``, chosen by a hash of the id.

    Only a count for each class and the chosen rows move; the share of the hash's range that a class keeps follows
    from its count, so the number of distinct ids is bounded at any size, within sampling noise. Rows that share an id
    are chosen together: ``one_of_each`` bounds those.
    """
    sizes = docs.groupBy(class_col).agg(F.count(F.lit(1)).alias("class_rows")).orderBy(F.desc("class_rows"), class_col).limit(most_classes)
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    return docs.join(F.broadcast(sizes), class_col).where(u * F.col("class_rows") < per_class).drop("class_rows")


def one_of_each(rows: DataFrame, id_col: str) -> DataFrame:
    """The least row of each id: a minimum, combined before the shuffle."""
    rest = [c for c in rows.columns if c != id_col]
    return rows.groupBy(id_col).agg(F.min(F.struct(*rest)).alias("r")).select(id_col, "r.*")


def labelled_sample(docs: DataFrame, labels_df: DataFrame, label: str, per_class: int, allowed: Column, id_col: str = "doc_id") -> list:
    """Rows (id, label, text) for fitting: about ``per_class`` of each class, of ids that ``allowed`` lets be learned from.

    Ids are chosen from the narrow label table first; only the chosen ones, a bounded number, are joined with texts. Of
    several documents with one id the least text is taken.
    """
    known = labels_df.where(allowed & F.col(label).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("label"))
    chosen = sample_by(known, "label", per_class, id_col)
    return one_of_each(docs.select(id_col, "text").join(F.broadcast(chosen), id_col), id_col).orderBy(id_col).collect()


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a small ridge; the slope is never negative."""
    x, t = np.asarray(x, float), np.where(y > 0, 1 - 1e-3, 1e-3)
    scale = x.std() or 1.0
    design, w = np.c_[x / scale, np.ones(len(x))], np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        g = design.T @ (weight * (p - t)) + 1e-3 * w
        h = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0] / scale)), float(w[1])


def prefix_bits(keys: DataFrame) -> np.ndarray:
    """A bit for each of the 2**24 values of a key's first three bytes, set if a key has it: 2 MB whatever the input.

    Used as a filter with false positives only: a row that passes takes the longer way and comes to the same result.
    """
    at = (F.conv(F.hex(F.substring("key", 1, 3)), 16, 10).cast("bigint") + 1).alias("at")
    rows = keys.select(at).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros((512, 4096), np.uint8)
    for r in rows:
        out[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def has_prefix(bits: np.ndarray, key: bytes) -> bool:
    at = int.from_bytes(key[:3], "big")
    return bool(bits[at >> 3] >> (at & 7) & 1)
