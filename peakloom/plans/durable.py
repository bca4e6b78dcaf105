"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset (tests)."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if named:
        if current.isEmpty():
            context.setCheckpointDir(named)
        return named
    if current.isEmpty():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="peakloom-checkpoint-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs a read, not a rerun."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tables written in each open ``scratch`` block, innermost last.
_open: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``durable_table`` writes in this block are removed at its end: what they lead to must be written or
    collected by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


def place(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. An open ``scratch`` block removes what is written there, as for a table."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def durable_table(df: DataFrame, name: str, compression: str = "zstd", keep: bool = False) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read again: columnar and compressed, for wide intermediates.
    The table stays after the job unless a ``scratch`` block is open and ``keep`` is not asked for."""
    return kept_at(df, name, compression, keep)[0]


def kept_at(df: DataFrame, name: str, compression: str = "zstd", keep: bool = False) -> tuple[DataFrame, str]:
    """``durable_table`` and the path of its folder, for tables that are removed (``forget``) before the job ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _open and not keep:
        _open[-1].append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Remove tables that nothing reads any more, and what shuffles of frames that are gone have left: Spark removes that when
    the driver happens to collect its garbage, which may be never in a job of few objects and large shuffles."""
    for path in paths:
        remove(spark, path)
    gc.collect()
    spark._jvm.System.gc()
