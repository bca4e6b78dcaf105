"""The (isolation window x retention-time block) index: cells of binned peaks with occupancy bitmaps, and what reads it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakloom.functions.binning import MZ0, mz_bin, neighbours, rt_block, window_key
from peakloom.functions.scoring import standardize, xcorr_max, xcorr_post


def window_ids(peaks: DataFrame) -> DataFrame:
    """``win_id`` of each ``win_key``, numbered by the first scan that has it. The number of windows is an acquisition's."""
    first = peaks.groupBy(window_key(F.col("win_mz")).alias("win_key")).agg(F.min("scan_index").alias("first_scan"))
    return first.withColumn("win_id", F.row_number().over(W.orderBy("first_scan", "win_key")) - 1)


def indexed_peaks(peaks: DataFrame, ppm: float = 20.0, seconds: float = 30.0) -> DataFrame:
    """Peaks as (win_key, block, bin, intensity, scan_index). Those under 100 Th have no bin and are left out; see
    ``index_counters`` for their number."""
    able = peaks.where(F.col("mz") >= MZ0)
    return able.select(window_key(F.col("win_mz")).alias("win_key"), rt_block(F.col("rt"), seconds).alias("block"), mz_bin(F.col("mz"), ppm).cast("int").alias("bin"), F.col("intensity").cast("float").alias("intensity"), "scan_index")


def cells(indexed: DataFrame) -> DataFrame:
    """For each (window, block) the number of its peaks, duplicates kept, of its distinct bins, and the summed intensity:
    all combined before the shuffle, so that a crowded cell is no large row."""
    return indexed.groupBy("win_key", "block").agg(F.count(F.lit(1)).alias("n_peaks"), F.count_distinct("bin").alias("n_bins"), F.sum(F.col("intensity").cast("double")).alias("intensity"))


def cell_bitmaps(indexed: DataFrame) -> DataFrame:
    """Occupancy bitmaps: a row for each (window, block, bucket of 32768 bins); bins are shifted by one as buckets count from one.

    Distinct bins are found first, narrow and combined before the shuffle, then dealt by cell and put in order: each bitmap is
    made where its cell is, from neighbouring rows, and no more than ``BITMAPS`` are held at once. Aggregates of bitmaps would
    hold one of 4 kB for every cell of a task.
    """
    at = (F.col("bin") + 1).cast("bigint")
    keys = indexed.select("win_key", "block", F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).cast("int").alias("bit"))
    return _from_bits(keys.where("bit IS NOT NULL"))


def _from_bits(keys: DataFrame) -> DataFrame:
    types, order = {f.name: f.dataType.simpleString() for f in keys.schema}, ["win_key", "block", "bucket"]
    bins = keys.distinct().repartition("win_key", "block").sortWithinPartitions(*order)
    return bins.mapInArrow(_bitmaps, ", ".join(f"{c} {types[c]}" for c in order) + ", bits binary")


#: Bytes of a bitmap, and how many of them a task makes at once.
BITMAP_BYTES, BITMAPS = 4096, 1000


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of rows (win_key, block, bucket, bit) in order of their first three. A group may go on in the next batch."""
    key, bits = None, np.zeros(BITMAP_BYTES, np.uint8)
    schema = None

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema[i].type) for i in range(3)] + [pa.array([r[3] for r in rows], pa.binary())], [*schema.names[:3], "bits"])

    out: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        schema = batch.schema
        columns = [batch.column(i).to_pylist() for i in range(3)]
        bit = batch.column(3).to_numpy().astype(np.int64)
        same = np.ones(len(bit) - 1, bool)
        for i in range(3):
            same &= np.fromiter((x == y for x, y in zip(columns[i], columns[i][1:])), bool, len(bit) - 1)
        ends = [0, *(np.flatnonzero(~same) + 1).tolist(), len(bit)]
        for start, end in zip(ends, ends[1:]):
            fresh = tuple(c[start] for c in columns)
            if key is not None and fresh != key:
                out.append((*key, bits.tobytes()))
                bits[:] = 0
            key = fresh
            np.bitwise_or.at(bits, bit[start:end] >> 3, (1 << (bit[start:end] & 7)).astype(np.uint8))
            if len(out) >= BITMAPS:
                yield made(out)
                out = []
    if key is not None:
        out.append((*key, bits.tobytes()))
        yield made(out)


def _set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (win_key, block, bucket, bit) of bitmaps, those of a hundred at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, 100):
            some = batch.slice(i, 100)
            each = [np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")) for b in some.column(3).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(each)), [len(e) for e in each]))
            bit = pa.array(np.concatenate(each).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(some.column(j).take(row) for j in range(3)), bit], [*batch.schema.names[:3], "bit"])


def merge_bitmaps(*parts: DataFrame) -> DataFrame:
    """Union of bitmap tables, such as those of two runs or two micro-batches. Set bits are dealt, not bitmaps: a nearly
    empty one costs what it holds."""
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    types = {f.name: f.dataType.simpleString() for f in all_.schema}
    keys = all_.where("bits IS NOT NULL").select("win_key", "block", "bucket", "bits").mapInArrow(_set_bits, ", ".join(f"{c} {types[c]}" for c in ("win_key", "block", "bucket")) + ", bit int")
    return _from_bits(keys)


def popcounts(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.groupBy("win_key", "block").agg(F.sum(F.bitmap_count("bits")).alias("n_bins"))


def index_counters(peaks: DataFrame, ppm: float = 20.0, seconds: float = 30.0) -> DataFrame:
    """Scans, peaks, windows and cells of the index, its logical bytes (bin and intensity of each peak), and peaks under 100 Th."""
    at = F.struct(window_key(F.col("win_mz")), rt_block(F.col("rt"), seconds))
    ok = F.col("mz") >= MZ0
    return peaks.agg(
        F.count_distinct("scan_index").alias("n_scans"), F.count_if(ok).alias("n_peaks"), F.count_distinct(window_key(F.col("win_mz"))).alias("n_windows"),
        F.count_distinct(F.when(ok, at)).alias("n_cells"), (8 * F.count_if(ok)).alias("logical_bytes"), F.count_if(~ok).alias("n_below"),
    )


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (win_key, block, bucket, word, bits) of bitmaps: their words of 64 bits that are not empty, those of a thousand at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, BITMAPS):
            some = batch.slice(i, BITMAPS)
            each = [np.frombuffer(b + bytes(-len(b) % 8), "<i8") for b in some.column(3).to_pylist()]
            at = [np.flatnonzero(e) for e in each]
            row = pa.array(np.repeat(np.arange(len(each)), [len(x) for x in at]))
            word, bits = np.concatenate(at).astype(np.int32), np.concatenate([e[x] for e, x in zip(each, at, strict=True)])
            yield pa.RecordBatch.from_arrays([*(some.column(j).take(row) for j in range(3)), pa.array(word), pa.array(bits)], [*batch.schema.names[:3], "word", "bits"])


def probe(bitmaps: DataFrame, at: DataFrame) -> DataFrame:
    """``at`` (win_key, block, bin) with ``occupied``: whether the cell's bitmap has the bin.

    Words that are not empty meet what is asked, not bitmaps, and both are dealt: a table of nearly empty bitmaps is small as
    it is shuffled and large as it is held, so that it would be sent to every task by its size in the shuffle."""
    types = {f.name: f.dataType.simpleString() for f in bitmaps.schema}
    order = ["win_key", "block", "bucket"]
    words = bitmaps.where("bits IS NOT NULL").select(*order, "bits").mapInArrow(_words, ", ".join(f"{c} {types[c]}" for c in order) + ", word int, bits bigint")
    place = (F.col("bin") + 1).cast("bigint")
    bit = F.bitmap_bit_position(place)
    keyed = at.withColumn("bucket", F.bitmap_bucket_number(place)).withColumn("word", F.shiftright(bit, 6).cast("int"))
    found = keyed.join(words.hint("merge"), [*order, "word"], "left")
    return found.withColumn("occupied", F.coalesce(F.getbit("bits", (bit % 64).cast("int")) == 1, F.lit(False))).drop("bits", "bucket", "word")


def prefilter(fragments: DataFrame, occupied: DataFrame, needed: int = 3) -> DataFrame:
    """Candidates of which ``needed`` fragments or more have an occupied bin, or one beside it, in the cell they go to.

    ``fragments``: (candidate, fragment, win_key, block, bin); ``occupied``: distinct (win_key, block, bin). An equi-join on
    the cell and three probes for each fragment; a fragment counts once.
    """
    probes = fragments.withColumn("bin", F.explode(neighbours(F.col("bin"))))
    hit = probes.join(occupied, ["win_key", "block", "bin"], "left_semi")
    return hit.groupBy("candidate").agg(F.count_distinct("fragment").alias("hits")).where(F.col("hits") >= needed)


def gather(transitions: DataFrame, peaks: DataFrame, ppm: float = 20.0, rt_width: float | None = None, im_width: float = -1.0) -> DataFrame:
    """Peaks within each transition's tolerance: ``mz`` within ``ppm`` / 2 on either side of ``product_mz``, in its window and,
    with ``rt_width``, within half of that of ``rt_apex``; with an ``im_width`` other than -1, the mobility ``im`` within half
    of that of ``im_apex``.

    An interval join as an equi-join on (window, bin): the transition goes to its bin and those beside it, which hold
    every value within the tolerance; the exact test follows. With ``rt_width`` blocks of that width are in the key as
    well (a transition goes to the one or two that its range touches), so that a crowded bin is not met over a whole run.
    """
    t = transitions.withColumn("bin", F.explode(neighbours(mz_bin(F.col("product_mz"), ppm))))
    p = peaks.select(window_key(F.col("win_mz")).alias("win_key"), mz_bin(F.col("mz"), ppm).alias("bin"), "scan_index", "rt", "mz", "intensity", *(["im"] if im_width >= 0 else []))
    keys = ["win_key", "bin"]
    if rt_width is not None:
        within = lambda rt: F.floor(rt / F.lit(max(rt_width, 1e-9)))
        touched = F.array_distinct(F.array(within(F.col("rt_apex") - rt_width / 2), within(F.col("rt_apex")), within(F.col("rt_apex") + rt_width / 2)))
        t, p, keys = t.withColumn("__block", F.explode(touched)), p.withColumn("__block", within(F.col("rt"))), [*keys, "__block"]
    near = F.abs(p["mz"] - t["product_mz"]) <= t["product_mz"] * (ppm / 2 * 1e-6)
    joined = t.join(p, keys).where(near).drop("__block")
    if rt_width is not None:
        joined = joined.where(F.abs(F.col("rt") - F.col("rt_apex")) <= rt_width / 2)
    return joined.where(F.abs(F.col("im") - F.col("im_apex")) <= im_width / 2) if im_width >= 0 else joined


def traces(gathered: DataFrame, group: str = "group", fragment: str = "fragment") -> DataFrame:
    """Fragment traces on the group's common retention-time points; a point that a fragment lacks is 0, several peaks add up."""
    points = gathered.groupBy(group).agg(F.array_sort(F.collect_set("rt")).alias("points"))
    summed = gathered.groupBy(group, fragment, "rt").agg(F.sum("intensity").alias("i"))
    each = summed.groupBy(group, fragment).agg(F.map_from_entries(F.collect_list(F.struct("rt", "i"))).alias("at"))
    return each.join(points, group).select(group, fragment, F.transform("points", lambda t: F.coalesce(F.try_element_at("at", t), F.lit(0.0))).alias("trace"))


def all_pairs_xcorr(traces_: DataFrame, max_delay: int, group: str = "group", fragment: str = "fragment", digits: int | None = None) -> DataFrame:
    """Cross-correlation peak of every pair i <= j of a group's traces, the diagonal included. Each trace is standardized
    once; a group has as many fragments as a transition group, so its pairs are few. With ``digits`` magnitudes that are
    equal when rounded to so many count as equal, and the first delay of these wins."""
    # Kept beside the join: a projection that joined rows are given could else be computed for each pair.
    z = traces_.select(group, fragment, standardize(F.col("trace")).alias("z")).repartition(group)
    a, b = z.select(group, F.col(fragment).alias("i"), F.col("z").alias("za")), z.select(group, F.col(fragment).alias("j"), F.col("z").alias("zb"))
    pairs = a.join(b, group).where("i <= j")
    return pairs.select(group, "i", "j", xcorr_max(xcorr_post(F.col("za"), F.col("zb"), max_delay), digits).alias("peak"))


#: Columns of a stored index; the window is the folder.
STORED = "block int, bin int, n_peaks bigint, intensity double, win_key bigint"
#: Windows up to which a stored index is asked for them by name.
MOST_WINDOWS = 10_000


def store_index(indexed: DataFrame, path: str) -> None:
    """Write the index once: for each (window, block, bin) its peaks and summed intensity, in folders by window, sorted by
    block and bin, so that a reader skips windows by folder and blocks by the statistics of row groups."""
    cells_ = indexed.groupBy("win_key", "block", "bin").agg(F.count(F.lit(1)).alias("n_peaks"), F.sum(F.col("intensity").cast("double")).alias("intensity"))
    # Dealt by ranges of blocks within windows: a window with most of the peaks is several tasks' and several files.
    cells_.repartitionByRange("win_key", "block").sortWithinPartitions("win_key", "block", "bin").write.partitionBy("win_key").mode("overwrite").parquet(path)


def stored_index(spark: SparkSession, path: str, asked: DataFrame | None = None) -> DataFrame:
    """The stored index; with ``asked`` (win_key, ...) only the windows that it has, which are read from it first (the number
    of windows is an acquisition's; over ``MOST_WINDOWS`` all are read)."""
    stored = spark.read.schema(STORED).parquet(path)  # a given schema opens no file to find it out
    if asked is None:
        return stored
    keys = [r[0] for r in asked.select("win_key").where("win_key IS NOT NULL").distinct().limit(MOST_WINDOWS + 1).collect()]
    return stored if len(keys) > MOST_WINDOWS else stored.where(F.col("win_key").isin(keys)) if keys else stored.limit(0)


def prefilter_stored(fragments: DataFrame, path: str, needed: int = 3) -> DataFrame:
    """``prefilter`` against a stored index: windows that no fragment goes to are not read."""
    occupied = stored_index(fragments.sparkSession, path, fragments).select("win_key", "block", F.col("bin").cast("bigint").alias("bin"))
    return prefilter(fragments, occupied, needed)
