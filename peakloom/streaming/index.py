"""The index over a stream of peaks: one pass, keyed state for each (window, block), batch and stream alike."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from peakloom.operators.index import indexed_peaks
from peakloom.plans.durable import shared_dir


def stream_cells(peaks: DataFrame, ppm: float = 20.0, seconds: float = 30.0) -> DataFrame:
    """Peaks and occupied bins of each cell, as a streaming aggregation. Blocks are of retention time, not of event time, so
    state is kept until the stream ends; its size is that of the index."""
    at = indexed_peaks(peaks, ppm, seconds)
    return at.groupBy("win_key", "block").agg(F.count(F.lit(1)).alias("n_peaks"), F.min("bin").alias("min_bin"), F.max("bin").alias("max_bin"), F.sum(F.col("intensity").cast("double")).alias("intensity"))


def _summary(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/stream-{name}-cells"


def start_index(peaks: DataFrame, name: str, ppm: float = 20.0, seconds: float = 30.0, resume: bool = False) -> StreamingQuery:
    """Run the stream over what there is now and stop: ``read_index`` is the finished index's summary. The executors write
    it as Parquet in the shared folder; no cell passes through the driver. With ``resume`` the stream of that name goes on
    where it was last left, over the same source; else it begins anew."""
    spark = peaks.sparkSession
    where, to = f"{shared_dir(spark).rstrip('/')}/stream-{name}" + ("" if resume else f"-{uuid4().hex}"), _summary(spark, name)
    found = stream_cells(peaks, ppm, seconds)
    spark.createDataFrame([], found.schema).write.mode("overwrite").parquet(to)  # what a stream without data leaves
    write = lambda batch, _: batch.write.mode("overwrite").parquet(to)
    return found.writeStream.outputMode("complete").foreachBatch(write).queryName(name).option("checkpointLocation", where).trigger(availableNow=True).start()


def read_index(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.parquet(_summary(spark, name))


def windowed_cells(peaks: DataFrame, watermark: str = "60 seconds", block: str = "30 seconds") -> DataFrame:
    """The same cells for streams with an event time ``ts``: tumbling windows, emitted once the watermark has passed them."""
    return peaks.withWatermark("ts", watermark).groupBy("win_key", F.window("ts", block)).agg(F.count(F.lit(1)).alias("n_peaks"))
