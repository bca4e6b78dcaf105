"""Profile of an acquisition: census, windows, cycle time, occupancy of m/z bins, selectivity of a prefilter.

Spectra are rows (run, scan_index, ms_level, rt, drift_time, precursors, peaks); the peak-wise functions take one row
for each peak (scan_index, win_mz, rt, mz, intensity)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakloom.functions.binning import binomial_tail, mz_bin, neighbour_hit, upper_median
from peakloom.operators.quantiles import medians

#: Half widths of the retention-time cells that the sweep tries, in seconds.
HALF_WIDTHS = (5.0, 10.0, 30.0, 60.0, 150.0, 300.0, 600.0)


def fragment_scans(spectra: DataFrame) -> DataFrame:
    """MS2 spectra with peaks and a precursor: those that are indexed."""
    return spectra.where("ms_level = 2 AND size(peaks) > 0 AND size(precursors) > 0")


def isolation_bounds(spectra: DataFrame) -> DataFrame:
    """``lower`` and ``upper`` of the first precursor's window, and its centre ``win_mz``."""
    p = F.get("precursors", F.lit(0))
    return spectra.withColumns({"win_mz": p["mz"], "lower": p["mz"] - p["iso_lower"], "upper": p["mz"] + p["iso_upper"]})


def spectrum_census(spectra: DataFrame) -> DataFrame:
    """Counts by level, peaks, and whether any spectrum has a drift time (-1 is none)."""
    return spectra.agg(
        F.count_if(F.col("ms_level") == 1).alias("n_ms1"),
        F.count_if(F.col("ms_level") == 2).alias("n_ms2"),
        F.count_if(~F.col("ms_level").isin(1, 2)).alias("n_other"),
        F.sum("n_peaks").alias("n_peaks"),
        F.coalesce(F.bool_or(F.col("drift_time") != -1.0), F.lit(False)).alias("has_mobility"),
    )


def window_histogram(scans: DataFrame) -> DataFrame:
    """MS2 scans by isolation window, in order of its bounds, with the width."""
    return scans.where("ms_level = 2").groupBy("lower", "upper").agg(F.count(F.lit(1)).alias("scans")).withColumn("width", F.col("upper") - F.col("lower")).orderBy("lower", "upper")


def cycle_time(spectra: DataFrame) -> DataFrame:
    """For each run the upper median of the gaps between MS1 scans in file order, and the first and last by file order."""
    ms1 = spectra.where("ms_level = 1")
    gap = F.col("rt") - F.lag("rt").over(W.partitionBy("run").orderBy("scan_index"))
    return ms1.withColumn("gap", gap).groupBy("run").agg(upper_median("gap").alias("cycle_time"), F.min_by("rt", "scan_index").alias("first_rt"), F.max_by("rt", "scan_index").alias("last_rt"), F.count(F.lit(1)).alias("n_ms1"))


def occupancy_by_scan(peaks: DataFrame, ppm: float = 20.0) -> DataFrame:
    """For each scan of two peaks or more: peaks, distinct bins, span of bins, share of the span that is occupied."""
    binned = peaks.withColumn("bin", mz_bin(F.col("mz"), ppm))
    each = binned.groupBy("scan_index").agg(F.count(F.lit(1)).alias("n_peaks"), F.count_distinct("bin").alias("n_bins"), (F.max("bin") - F.min("bin") + 1).alias("span"))
    return each.where("n_peaks >= 2").withColumn("fraction", F.col("n_bins") / F.col("span"))


def occupancy_summary(peaks: DataFrame, ppm: float = 20.0, fragments: int = 6) -> DataFrame:
    """Upper medians over scans, bins of the whole range, hit chance with neighbours, and the chance that a random
    candidate passes k of ``fragments`` for k from all of them down to 2."""
    each = occupancy_by_scan(peaks, ppm)
    middle = medians(each.select(F.col("fraction").alias("p_raw"), F.col("n_bins").cast("double").alias("median_bins")), [], ["p_raw", "median_bins"], upper=True)
    scans = each.agg(F.count(F.lit(1)).alias("n_scans")).crossJoin(F.broadcast(middle.fillna(0.0)))
    wide = peaks.agg((mz_bin(F.max("mz"), ppm) - mz_bin(F.min("mz"), ppm) + 1).alias("total_bins"))
    p = scans.crossJoin(F.broadcast(wide)).withColumn("p", neighbour_hit(F.col("p_raw")))
    tails = F.array(*(F.struct(F.lit(k).alias("k"), binomial_tail(F.col("p"), k, fragments).alias("pass_chance")) for k in range(fragments, 1, -1)))
    return p.select("n_scans", "p_raw", "median_bins", "total_bins", "p", F.inline(tails))


def occupancy_by_cell(peaks: DataFrame, half: float, ppm: float = 20.0) -> DataFrame:
    """Occupied share of the global span for each (window, retention-time cell of ``2 half`` seconds from the window's
    first scan). A cell that begins at the window's last scan or later is none, so one scan alone has no cell."""
    binned = peaks.withColumn("bin", mz_bin(F.col("mz"), ppm))
    bounds = binned.groupBy("win_mz").agg(F.min("rt").alias("t0"), F.max("rt").alias("t1"))
    span = binned.agg((F.max("bin") - F.min("bin") + 1).alias("span"))
    cell = F.floor((F.col("rt") - F.col("t0")) / (2 * half))
    placed = binned.join(bounds, "win_mz").withColumn("cell", cell).where(F.col("t0") + F.col("cell") * (2 * half) < F.col("t1"))
    each = placed.groupBy("win_mz", "cell").agg(F.count_distinct("bin").alias("n_bins"), F.count_distinct("scan_index").alias("scans"))
    return each.crossJoin(F.broadcast(span)).withColumn("occupancy", F.col("n_bins") / F.col("span"))


def occupancy_sweep(peaks: DataFrame, ppm: float = 20.0, candidates: int = 150_000_000, fragments: int = 6, needed: int = 3, halves: tuple[float, ...] = HALF_WIDTHS) -> DataFrame:
    """Selectivity of the prefilter for each half width: upper medians over cells, hit chance, pass chance, survivors.

    Peaks are binned and deduplicated once for all widths; the few widths multiply that table before it is grouped.
    """
    bins = peaks.select("win_mz", "scan_index", "rt", mz_bin(F.col("mz"), ppm).alias("bin")).distinct()
    bounds = bins.groupBy("win_mz").agg(F.min("rt").alias("t0"), F.max("rt").alias("t1"))
    span = bins.agg((F.max("bin") - F.min("bin") + 1).alias("span"))
    wide = bins.join(bounds, "win_mz").withColumn("half", F.explode(F.array(*map(F.lit, halves))))
    placed = wide.withColumn("cell", F.floor((F.col("rt") - F.col("t0")) / (2 * F.col("half")))).where("t0 + cell * (2 * half) < t1")
    cells = placed.groupBy("half", "win_mz", "cell").agg(F.count_distinct("bin").alias("n_bins"), F.count_distinct("scan_index").alias("scans"))
    each = cells.crossJoin(F.broadcast(span)).withColumn("occupancy", F.col("n_bins") / F.col("span"))
    middle = medians(each.select("half", F.col("scans").cast("double").alias("median_scans"), F.col("occupancy").alias("p_raw")), ["half"], ["median_scans", "p_raw"], upper=True)
    p = middle.withColumn("p", neighbour_hit(F.col("p_raw"))).withColumn("pass_chance", binomial_tail(F.col("p"), needed, fragments))
    return p.withColumn("survivors", F.col("pass_chance") * candidates)
