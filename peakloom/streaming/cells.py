"""The index over a stream with bounded state: a cell's bitmap is kept while its window is in its block, then emitted."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from peakloom.functions.binning import MZ0, mz_bin, rt_block, window_key
from peakloom.plans.durable import place

CELL = "win_key bigint, block int, n_peaks bigint, n_bins bigint, intensity double, bits binary"
STATE = "last double, blocks array<int>, n_peaks array<bigint>, intensity array<double>, bits array<binary>"

#: A bin takes so many bits of a number whose upper ones are the block.
BIN_BITS = 31
#: Numbers that are collected at least before they are made distinct, and bitmaps that are emitted at once.
LEAST, CELLS = 200_000, 256


def with_bins(bits: bytes, bins: np.ndarray) -> bytes:
    """A bitmap, lowest bit first and as long as its highest bin needs, with further bins."""
    on = np.zeros(max(8 * len(bits), int(bins.max(initial=-1)) + 1), np.uint8)
    on[: 8 * len(bits)] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
    on[bins] = 1
    return np.packbits(on, bitorder="little").tobytes()


def count_bins(bits: bytes) -> int:
    return int(np.unpackbits(np.frombuffer(bits, np.uint8)).sum())


def closing_cells(peaks: DataFrame, ppm: float = 20.0, seconds: float = 30.0, late: float = 0.0) -> DataFrame:
    """The cells of a stream of peaks (win_mz, rt, mz, intensity), each once its window has a peak at least ``late`` seconds
    past the cell's block: (win_key, block, n_peaks, n_bins, intensity, bits). Within a batch a window's cells are sorted numbers of block and bin,
    8 bytes for each distinct one; bitmaps are made when cells are emitted, a few at once. A window's state is its open cells, one or
    two and as many as ``late`` spans, however long the run is.

    Within a window, batches come in order of retention time but for ``late`` seconds; a peak that comes later still begins
    its cell anew, which is then emitted in parts. Within a batch any order will do. Peaks under 100 Th have no bin and are left out, as are rows with a
    null in any of the columns.
    """
    at = peaks.where(F.col("mz") >= MZ0).select(window_key(F.col("win_mz")).alias("win_key"), rt_block(F.col("rt"), seconds).alias("block"), mz_bin(F.col("mz"), ppm).cast("int").alias("bin"), F.col("rt").cast("double").alias("rt"), F.col("intensity").cast("float").cast("double").alias("intensity")).dropna()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, kept = -np.inf, {}
        if state.exists:
            last, *rest = state.get
            kept = {b: (n, i, bytes(x)) for b, n, i, x in zip(*rest, strict=True)}
        codes, sums = np.zeros(0, np.int64), [pd.DataFrame({"size": [], "sum": []}, index=pd.Index([], dtype="int64"), dtype=float)]
        waiting, size = [], 0
        for frame in frames:
            last = max(last, float(frame["rt"].max()))
            waiting.append(frame["block"].to_numpy(np.int64) << BIN_BITS | frame["bin"].to_numpy(np.int64))
            sums.append(frame.groupby("block")["intensity"].agg(["size", "sum"]).astype(float))
            size += len(frame)
            if size > max(LEAST, len(codes)):
                codes, waiting, size = np.unique(np.concatenate([codes, *waiting])), [], 0
                sums = [pd.concat(sums).groupby(level=0).sum()]
        codes = np.unique(np.concatenate([codes, *waiting]))
        fresh = pd.concat(sums).groupby(level=0).sum()
        blocks = np.union1d(fresh.index.to_numpy(np.int64), np.array(list(kept), np.int64))
        n, i = (fresh[c].reindex(blocks, fill_value=0.0).to_numpy() for c in ("size", "sum"))
        ends = np.searchsorted(codes >> BIN_BITS, [blocks, blocks + 1])

        def cell(j: int) -> tuple[int, float, bytes]:
            m, more, bits = kept.get(int(blocks[j]), (0, 0.0, b""))
            return m + int(n[j]), more + float(i[j]), with_bins(bits, codes[ends[0, j] : ends[1, j]] & ((1 << BIN_BITS) - 1))

        over = (blocks + 1) * seconds + late <= last
        done = np.flatnonzero(over)
        for at_once in range(0, len(done), CELLS):
            made = [(key[0], int(blocks[j]), c[0], count_bins(c[2]), c[1], c[2]) for j in done[at_once : at_once + CELLS] for c in [cell(j)]]
            yield pd.DataFrame(made, columns=["win_key", "block", "n_peaks", "n_bins", "intensity", "bits"])
        still = [(int(blocks[j]), *cell(j)) for j in np.flatnonzero(~over)]
        state.update((last, *([c[f] for c in still] for f in range(4))))

    return at.groupBy("win_key").applyInPandasWithState(step, CELL, STATE, "append", GroupStateTimeout.NoTimeout)


def open_cells(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The cells that the stream of that checkpoint holds open, from its state store; none if it had no data yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/state")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CELL)
    state = spark.read.format("statestore").load(checkpoint).select(F.col("key.win_key").alias("win_key"), F.col("value.groupState.*"))
    each = state.select("win_key", F.inline(F.arrays_zip("blocks", "n_peaks", "intensity", "bits")))
    return each.select("win_key", F.col("blocks").alias("block"), "n_peaks", F.bitmap_count("bits").alias("n_bins"), "intensity", "bits")


def all_cells(spark: SparkSession, closed: str, checkpoint: str) -> DataFrame:
    """The whole index once the stream has ended: what it wrote (``closed``) and what it holds open."""
    return spark.read.schema(CELL).parquet(closed).drop("batch").unionByName(open_cells(spark, checkpoint))


def run_index(peaks: DataFrame, name: str, ppm: float = 20.0, seconds: float = 30.0, late: float = 0.0, checkpoint: str | None = None, by_ranges: bool = False) -> tuple[str, str]:
    """Run the stream over what there is now, in one start also where its source is ``sources.ranges`` (``by_ranges``): closed cells are added as Parquet in the shared folder by the executors, batch
    by batch. Returns that folder and the checkpoint, from which a later run goes on; see
    ``all_cells``."""
    spark = peaks.sparkSession
    fresh = checkpoint is None
    checkpoint = checkpoint or place(spark, f"cells-{name}")
    to = place(spark, f"cells-{name}-closed") if fresh else f"{checkpoint}-closed"
    spark.createDataFrame([], CELL).write.mode("overwrite").parquet(f"{to}/batch=-1")  # what a stream without data leaves
    # A batch that is run again after a failure replaces what it wrote before.
    write = lambda batch, i: batch.write.mode("overwrite").parquet(f"{to}/batch={i}")
    started = closing_cells(peaks, ppm, seconds, late).writeStream.foreachBatch(write).queryName(f"{name}-{uuid4().hex[:8]}").option("checkpointLocation", checkpoint)
    if by_ranges:
        drain(started.start())
    else:
        started.trigger(availableNow=True).start().awaitTermination()
    return to, checkpoint


def drain(query: StreamingQuery) -> None:
    """Wait until the query has taken all that its source has now, in as many batches as that takes, and end it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
