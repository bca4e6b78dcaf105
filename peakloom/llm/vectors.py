"""What the operators on vectors share: which rows take part, and whole-numbered components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scaled components beyond this, either way, count as this: products of vectors stay within 64 bits.
LARGEST = 1 << 26


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def is_whole(vector_col: str) -> Column:
    """Whether a vector is there and all its components are numbers: true for an empty one, never null."""
    return F.coalesce(F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))


def reach(vector_col: str) -> Column:
    """The largest component of a vector, whatever its sign; null for an empty one."""
    return F.greatest(F.abs(F.array_max(vector_col)), F.abs(F.array_min(vector_col))).cast("double")


def scaled(vectors: pa.Array, scale: float, width: int) -> np.ndarray:
    """``floor(scale * x)`` of every component as int64, a row for each vector, shorter ones padded with zeros to ``width``."""
    size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = np.clip(np.floor(flat * scale), -LARGEST, LARGEST)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``: in floats where these hold every partial sum."""
    bound = float(abs(a).max(initial=0)) * float(abs(b).max(initial=0)) * a.shape[1]
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return a.astype(kind) @ b.astype(kind).T
