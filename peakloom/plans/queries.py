"""The registered queries of the domain operators, and the SQL that DuckDB answers them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakloom.functions import binning, chemistry, scoring
from peakloom.operators import compare, digest, index, library, percolation, profile, rescore
from peakloom.plans.proxies import DUCK_TRACES, all_proteins, duck_sql, proxy, traces
from peakloom.streaming.index import read_index, start_index

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TOL = 3600.0
INV = 1.0 / __import__("math").log1p(20e-6)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def with_(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({duck_sql(n)})" for n in names)


def duck_bin(mz: str) -> str:
    return f"trunc(ln({mz} / 100.0::DOUBLE) * {INV!r}::DOUBLE)::BIGINT"


KEY = "trunc(win_mz * 100 + 0.5)::BIGINT"
BLOCK = "trunc(rt / 30)::INT"


# Competition at a locus

_LOCUS = (
    with_("features") + f", p AS (SELECT a.feature_id, a.decoy, a.score AS own, b.feature_id AS other, b.score AS s FROM features a JOIN features b ON floor(a.mz / 24) = floor(b.mz / 24) AND b.rt BETWEEN a.rt - {TOL}::DOUBLE AND a.rt + {TOL}::DOUBLE),"
    " c AS (SELECT feature_id, any_value(decoy) AS decoy, any_value(own) AS own, count(*) - 1 AS n, sum(s) AS total, max(s) FILTER (other <> feature_id) AS best, count(*) FILTER (s > own) AS better FROM p GROUP BY feature_id),"
    " f AS (SELECT feature_id, decoy, CASE WHEN n > 0 THEN own - best ELSE 0 END AS best_delta, ln((abs(own) + 1e-6::DOUBLE) / (abs(total) + 1e-6::DOUBLE)) AS tot_ratio, CASE WHEN n > 0 THEN better::DOUBLE / n ELSE 0 END AS rival_rank, ln(1 + n::DOUBLE) AS n_compet FROM c)"
)


def _competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescore.competitive_features(proxy(spark, sf_dir, "features"), TOL, keep=("decoy",))


@query("competitive_features", _LOCUS + " SELECT feature_id, round(best_delta, 6) AS best_delta, round(tot_ratio, 6) AS tot_ratio, round(rival_rank, 6) AS rival_rank, round(n_compet, 6) AS n_compet FROM f")
def competitive_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_competition(spark, sf_dir).drop("decoy"), *rescore.FEATURE_COLUMNS)


@query("competitive_summary", _LOCUS + " SELECT decoy, round(median(best_delta), 6) AS median_best_delta, round(median(rival_rank), 6) AS median_rival_rank, round(median(exp(n_compet) - 1), 6) AS median_rivals, count(*) AS n FROM f GROUP BY decoy")
def competitive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rescore.competitive_summary(_competition(spark, sf_dir)), "median_best_delta", "median_rival_rank", "median_rivals")


@query("feature_write_back", _LOCUS + " SELECT feature_id, round(best_delta, 6) AS best_delta, round(tot_ratio, 6) AS tot_ratio, round(rival_rank, 6) AS rival_rank, round(n_compet, 6) AS n_compet, round(features.rt, 6) AS rt FROM features LEFT JOIN f USING (feature_id)")
def feature_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = proxy(spark, sf_dir, "features").select("feature_id", F.round("rt", 6).alias("rt"))
    return rounded(rescore.write_back(table, _competition(spark, sf_dir)), *rescore.FEATURE_COLUMNS)


@query(
    "target_decoy_qvalue",
    with_("features") + ", s AS (SELECT score, count(*) FILTER (decoy = 1) AS d, count(*) FILTER (decoy = 0) AS t FROM features GROUP BY score),"
    " r AS (SELECT score, sum(d) OVER w AS d, sum(t) OVER w AS t FROM s WINDOW w AS (ORDER BY score DESC)), f AS (SELECT score, CASE WHEN t > 0 THEN d::DOUBLE / t END AS fdr FROM r),"
    " q AS (SELECT score, fdr, min(fdr) OVER (ORDER BY score ASC) AS q_value FROM f)"
    " SELECT feature_id, round(fdr, 9) AS fdr, round(q_value, 9) AS q_value, 'feature' AS unit FROM features JOIN q USING (score)",
)
def target_decoy_qvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rescore.target_decoy_qvalues(proxy(spark, sf_dir, "features"))
    return rounded(found.select("feature_id", "fdr", "q_value", "unit"), "fdr", "q_value", digits=9)


@query("osw_features", with_("osw_feature", "osw_feature_ms2", "osw_precursor") + ' SELECT f."ID" AS feature_id, round("PRECURSOR_MZ", 6) AS mz, "EXP_RT" AS rt, round("VAR_XCORR_SHAPE", 6) AS score, "DECOY" AS decoy FROM osw_feature f JOIN osw_feature_ms2 ON "FEATURE_ID" = f."ID" JOIN osw_precursor p ON p."ID" = "PRECURSOR_ID"')
def osw_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rescore.osw_features(*(proxy(spark, sf_dir, t) for t in ("osw_feature", "osw_feature_ms2", "osw_precursor"))), "mz", "score")


# Binning and profile


@query("mz_bin", with_("peaks") + f" SELECT {duck_bin('mz')} AS bin, count(*) AS n FROM peaks GROUP BY 1")
def mz_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxy(spark, sf_dir, "peaks").groupBy(binning.mz_bin(F.col("mz")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("window_key", with_("features") + " SELECT feature_id, trunc(mz * 100 + 0.5)::BIGINT AS win_key, floor(mz / 24)::BIGINT AS grid, trunc(rt / 30)::INT AS block FROM features")
def window_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    mz, rt = F.col("mz"), F.col("rt")
    return proxy(spark, sf_dir, "features").select("feature_id", binning.window_key(mz).alias("win_key"), binning.grid_window(mz).alias("grid"), binning.rt_block(rt).alias("block"))


@query("neighbour_probe", with_("peaks") + f", b AS (SELECT DISTINCT {duck_bin('mz')} AS bin FROM peaks), o AS (SELECT unnest([bin - 1, bin, bin + 1]) AS bin FROM b) SELECT o.bin, count(*) AS n FROM o GROUP BY o.bin")
def neighbour_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = proxy(spark, sf_dir, "peaks").select(binning.mz_bin(F.col("mz")).alias("b")).distinct()
    return bins.select(F.explode(binning.neighbours(F.col("b"))).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("spectrum_census", with_("spectra") + " SELECT count(*) FILTER (ms_level = 1) AS n_ms1, count(*) FILTER (ms_level = 2) AS n_ms2, count(*) FILTER (ms_level NOT IN (1, 2)) AS n_other, sum(n_peaks)::BIGINT AS n_peaks, coalesce(bool_or(drift_time <> -1), false) AS has_mobility FROM spectra")
def spectrum_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.spectrum_census(proxy(spark, sf_dir, "spectra"))


@query("window_histogram", with_("spectra") + " SELECT lower, upper, count(*) AS scans, upper - lower AS width FROM spectra WHERE ms_level = 2 GROUP BY lower, upper")
def window_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.window_histogram(proxy(spark, sf_dir, "spectra"))


@query(
    "cycle_time",
    with_("spectra") + ", g AS (SELECT run, scan_index, rt, rt - lag(rt) OVER (PARTITION BY run ORDER BY scan_index) AS gap FROM spectra WHERE ms_level = 1)"
    " SELECT run, round(coalesce(quantile_disc(gap, 0.5 ORDER BY gap DESC), 0), 6) AS cycle_time, arg_min(rt, scan_index) AS first_rt, arg_max(rt, scan_index) AS last_rt, count(*) AS n_ms1 FROM g GROUP BY run"
    .replace("quantile_disc(gap, 0.5 ORDER BY gap DESC)", "list_sort(list(gap) FILTER (gap IS NOT NULL))[(count(gap) // 2 + 1)::BIGINT]"),
)
def cycle_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.cycle_time(proxy(spark, sf_dir, "spectra")), "cycle_time")


_UPPER = "list_sort(list({0}))[(count({0}) // 2 + 1)::BIGINT]"
_BINNED = with_("peaks") + f", b AS (SELECT *, {duck_bin('mz')} AS bin FROM peaks)"
_BY_SCAN = _BINNED + ", o AS (SELECT scan_index, count(*) AS n_peaks, count(DISTINCT bin) AS n_bins, max(bin) - min(bin) + 1 AS span FROM b GROUP BY scan_index HAVING count(*) >= 2)"


@query("occupancy_per_scan", _BY_SCAN + " SELECT scan_index, n_peaks, n_bins, span, round(n_bins::DOUBLE / span, 9) AS fraction FROM o")
def occupancy_per_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.occupancy_by_scan(proxy(spark, sf_dir, "peaks")), "fraction", digits=9)


def _duck_tail(k: str, n: int = 6) -> str:
    from math import comb

    return "(" + " + ".join(f"CASE WHEN {i} >= {k} THEN {comb(n, i)} * pow(p, {i}) * pow(1 - p, {n - i}) ELSE 0 END" for i in range(2, n + 1)) + ")"


@query(
    "binomial_tail",
    _BY_SCAN + f", m AS (SELECT count(*) AS n_scans, {_UPPER.format('n_bins::DOUBLE / span')} AS p_raw, {_UPPER.format('n_bins')} AS median_bins FROM o), w AS (SELECT max(bin) - min(bin) + 1 AS total_bins FROM b),"
    " q AS (SELECT *, least(1.0::DOUBLE, 3 * p_raw) AS p FROM m, w), k AS (SELECT unnest([6, 5, 4, 3, 2]) AS k)"
    f" SELECT n_scans, round(p_raw, 9) AS p_raw, median_bins::BIGINT AS median_bins, total_bins, round(p, 9) AS p, k::INT AS k, round({_duck_tail('k')}, 9) AS pass_chance FROM q, k",
)
def binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.occupancy_summary(proxy(spark, sf_dir, "peaks"))
    return rounded(found.withColumn("median_bins", F.col("median_bins").cast("bigint")), "p_raw", "p", "pass_chance", digits=9)


_CELLS = (
    _BINNED + ", s AS (SELECT max(bin) - min(bin) + 1 AS span FROM b), h AS (SELECT unnest([5.0, 10.0, 30.0, 60.0, 150.0, 300.0, 600.0])::DOUBLE AS half), e AS (SELECT win_mz, min(rt) AS t0, max(rt) AS t1 FROM b GROUP BY win_mz),"
    " c AS (SELECT half, win_mz, floor((rt - t0) / (2 * half))::BIGINT AS cell, t0, t1, bin, scan_index FROM b JOIN e USING (win_mz), h),"
    " o AS (SELECT half, win_mz, cell, count(DISTINCT bin) AS n_bins, count(DISTINCT scan_index) AS scans FROM c WHERE t0 + cell * (2 * half) < t1 GROUP BY half, win_mz, cell)"
)


@query("occupancy_cells", _CELLS + " SELECT win_mz, cell, n_bins, scans, span, round(n_bins::DOUBLE / span, 9) AS occupancy FROM o, s WHERE half = 300")
def occupancy_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.occupancy_by_cell(proxy(spark, sf_dir, "peaks"), 300.0), "occupancy", digits=9)


@query(
    "occupancy_rt_sweep",
    _CELLS + f", m AS (SELECT half, {_UPPER.format('scans')}::DOUBLE AS median_scans, {_UPPER.format('n_bins::DOUBLE / span')} AS p_raw FROM o, s GROUP BY half), q AS (SELECT *, least(1.0::DOUBLE, 3 * p_raw) AS p FROM m)"
    f" SELECT half, median_scans, round(p_raw, 9) AS p_raw, round(p, 9) AS p, round({_duck_tail('3')}, 9) AS pass_chance, round({_duck_tail('3')} * 150000000, 3) AS survivors FROM q",
)
def occupancy_rt_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.occupancy_sweep(proxy(spark, sf_dir, "peaks")).withColumn("median_scans", F.col("median_scans").cast("double"))
    return rounded(rounded(found, "p_raw", "p", "pass_chance", digits=9), "survivors", digits=3)


# Index

_INDEX = with_("peaks") + f", i AS (SELECT {KEY} AS win_key, {BLOCK} AS block, {duck_bin('mz')}::INT AS bin, intensity::FLOAT AS intensity FROM peaks WHERE mz >= 100)"


@query("index_cells", _INDEX + " SELECT win_key, block, count(*) AS n_peaks, count(DISTINCT bin) AS n_bins, round(sum(intensity::DOUBLE), 3) AS intensity FROM i GROUP BY win_key, block")
def index_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = index.cells(index.indexed_peaks(proxy(spark, sf_dir, "peaks")))
    return rounded(cells, "intensity", digits=3)


@query("window_ids", with_("peaks") + f", f AS (SELECT {KEY} AS win_key, min(scan_index) AS first_scan FROM peaks GROUP BY 1) SELECT win_key, first_scan, row_number() OVER (ORDER BY first_scan, win_key) - 1 AS win_id FROM f")
def window_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.window_ids(proxy(spark, sf_dir, "peaks")).withColumn("win_id", F.col("win_id").cast("bigint"))


@query("index_counters", with_("peaks") + f" SELECT count(DISTINCT scan_index) AS n_scans, count(*) FILTER (mz >= 100) AS n_peaks, count(DISTINCT {KEY}) AS n_windows, count(DISTINCT CASE WHEN mz >= 100 THEN ({KEY}, {BLOCK}) END) AS n_cells, 8 * count(*) FILTER (mz >= 100) AS logical_bytes, count(*) FILTER (mz < 100) AS n_below FROM peaks")
def index_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.index_counters(proxy(spark, sf_dir, "peaks"))


@query("cell_bitmap_popcount", _INDEX + " SELECT win_key, block, count(DISTINCT bin) AS n_bins FROM i GROUP BY win_key, block")
def cell_bitmap_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = index.indexed_peaks(proxy(spark, sf_dir, "peaks"))
    halves = [index.cell_bitmaps(at.where(F.col("scan_index") % 2 == r)) for r in (0, 1)]
    return index.popcounts(index.merge_bitmaps(*halves))


@query("bitmap_probe", _INDEX + ", q AS (SELECT DISTINCT win_key, block, unnest([bin, bin + 1]) AS bin FROM i) SELECT win_key, block, bin::INT AS bin, (win_key, block, bin) IN (SELECT (win_key, block, bin) FROM i) AS occupied FROM q")
def bitmap_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = index.indexed_peaks(proxy(spark, sf_dir, "peaks"))
    asked = at.select("win_key", "block", F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("bin")).distinct()
    return index.probe(index.cell_bitmaps(at), asked).select("win_key", "block", "bin", "occupied")


_FRAGMENTS = _INDEX + ", f AS (SELECT feature_id % 997 AS candidate, feature_id AS fragment, (40000 + 2400 * (feature_id % 25))::BIGINT AS win_key, trunc(rt / 30)::INT AS block, " + duck_bin("(mz - 210)") + " AS bin FROM (" + duck_sql("features") + ") z)"


@query("prefilter_k_of_f", _FRAGMENTS + ", o AS (SELECT DISTINCT win_key, block, bin FROM i), h AS (SELECT DISTINCT candidate, fragment FROM f JOIN o ON f.win_key = o.win_key AND abs(f.block - o.block) <= 0 AND abs(f.bin - o.bin) <= 1) SELECT candidate, count(*) AS hits FROM h GROUP BY candidate HAVING count(*) >= 1")
def prefilter_k_of_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments = proxy(spark, sf_dir, "features").select((F.col("feature_id") % 997).alias("candidate"), F.col("feature_id").alias("fragment"), (40000 + 2400 * (F.col("feature_id") % 25)).alias("win_key"), binning.rt_block(F.col("rt")).alias("block"), binning.mz_bin(F.col("mz") - 210).alias("bin"))
    occupied = index.indexed_peaks(proxy(spark, sf_dir, "peaks")).select("win_key", "block", F.col("bin").cast("bigint").alias("bin")).distinct()
    return index.prefilter(fragments, occupied, 1)


@query("prefilter_three", _FRAGMENTS.replace("% 997", "% 31") + ", o AS (SELECT DISTINCT win_key, block, bin FROM i), h AS (SELECT DISTINCT candidate, fragment FROM f JOIN o ON f.win_key = o.win_key AND f.block = o.block AND abs(f.bin - o.bin) <= 1) SELECT candidate, count(*) AS hits FROM h GROUP BY candidate HAVING count(*) >= 3")
def prefilter_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments = proxy(spark, sf_dir, "features").select((F.col("feature_id") % 31).alias("candidate"), F.col("feature_id").alias("fragment"), (40000 + 2400 * (F.col("feature_id") % 25)).alias("win_key"), binning.rt_block(F.col("rt")).alias("block"), binning.mz_bin(F.col("mz") - 210).alias("bin"))
    occupied = index.indexed_peaks(proxy(spark, sf_dir, "peaks")).select("win_key", "block", F.col("bin").cast("bigint").alias("bin")).distinct()
    return index.prefilter(fragments, occupied, 3)


@query(
    "tolerance_gather",
    with_("peaks", "features") + f" SELECT feature_id, scan_index, round(p.mz, 6) AS mz, round(p.rt, 6) AS rt FROM features f JOIN peaks p ON {KEY} = 40000 + 2400 * (feature_id % 25) AND abs(p.mz - (f.mz - 210)) <= (f.mz - 210) * (20.0 / 2 * 1e-6::DOUBLE)",
)
def tolerance_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = proxy(spark, sf_dir, "features").select("feature_id", (F.col("mz") - 210).alias("product_mz"), (40000 + 2400 * (F.col("feature_id") % 25)).alias("win_key"))
    return index.gather(asked, proxy(spark, sf_dir, "peaks")).select("feature_id", "scan_index", F.round("mz", 6).alias("mz"), F.round("rt", 6).alias("rt"))


# Scores of traces

_Z = "WITH " + DUCK_TRACES + ", m AS (SELECT grp, fragment, avg(v) AS mu, stddev_pop(v) AS sd, count(*) AS n FROM x GROUP BY 1, 2), z AS (SELECT grp, fragment, i, CASE WHEN sd > 0 THEN (v - mu) / sd ELSE v - mu END AS v, n FROM x JOIN m USING (grp, fragment))"
_PAIRS = "WITH " + DUCK_TRACES + ", n AS (SELECT grp, fragment, row_number() OVER (PARTITION BY grp ORDER BY fragment) AS k FROM t), p AS (SELECT a.grp, a.fragment AS i, b.fragment AS j FROM n a JOIN n b ON a.grp = b.grp AND b.k = a.k + 1), v AS (SELECT p.grp, p.i, p.j, a.v AS a, b.v AS b FROM p JOIN x a ON a.grp = p.grp AND a.fragment = p.i JOIN x b ON b.grp = p.grp AND b.fragment = p.j AND a.i = b.i)"
_XCORR = _Z + ", d AS (SELECT unnest(range(-2, 3)) AS delay), c AS (SELECT a.grp, a.fragment AS fi, b.fragment AS fj, delay, sum(a.v * b.v) / any_value(a.n) AS value FROM z a JOIN z b ON a.grp = b.grp AND a.fragment <= b.fragment, d WHERE b.i = a.i + delay GROUP BY ALL)"


@query("standardize", _Z + " SELECT grp AS \"group\", fragment, i::INT AS i, round(v, 6) AS v FROM z")
def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = traces(spark, sf_dir).select("group", "fragment", F.posexplode(scoring.standardize(F.col("trace"))).alias("i", "v"))
    return z.select("group", "fragment", (F.col("i") + 1).alias("i"), (F.round("v", 6) + 0.0).alias("v"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).withColumn("other", F.lead("trace").over(W.partitionBy("group").orderBy("fragment"))).withColumn("j", F.lead("fragment").over(W.partitionBy("group").orderBy("fragment"))).where("other IS NOT NULL").withColumnRenamed("fragment", "i")


@query("xcorr", _XCORR + " SELECT grp AS \"group\", fi AS i, fj AS j, delay::INT AS delay, round(value, 6) AS value FROM c WHERE fi < fj")
def xcorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = traces(spark, sf_dir).select("group", "fragment", scoring.standardize(F.col("trace")).alias("z"))
    pairs = z.select("group", F.col("fragment").alias("i"), F.col("z").alias("a")).join(z.select("group", F.col("fragment").alias("j"), F.col("z").alias("b")), "group").where("i < j")
    return pairs.select("group", "i", "j", F.inline(scoring.xcorr_post(F.col("a"), F.col("b"), 2))).withColumn("value", F.round("value", 6) + 0.0)


@query("xcorr_max", _XCORR + ' SELECT grp AS "group", fi AS i, fj AS j, round(max(abs(value)), 6) AS peak FROM c WHERE fi < fj GROUP BY 1, 2, 3')
def xcorr_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.all_pairs_xcorr(traces(spark, sf_dir), 2).where("i < j")
    return found.select("group", "i", "j", F.round(F.abs(F.col("peak.value")), 6).alias("peak"))


@query("allpairs_xcorr", _XCORR + ' SELECT grp AS "group", fi AS i, fj AS j, arg_min(delay, (-round(abs(value), 9), delay))::INT AS delay, round(arg_min(value, (-round(abs(value), 9), delay)), 6) AS value FROM c GROUP BY 1, 2, 3')
def allpairs_xcorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Magnitudes are rounded first: equal peaks at d and -d would else be told apart by their last bits.
    found = index.all_pairs_xcorr(traces(spark, sf_dir), 2, digits=9)
    return found.select("group", "i", "j", F.col("peak.delay").alias("delay"), F.round("peak.value", 6).alias("value"))


@query("spectral_angle", _PAIRS + ' SELECT grp AS "group", i, j, round(CASE WHEN sqrt(sum(a * a)) * sqrt(sum(b * b)) = 0 THEN 0 ELSE acos(greatest(-1, least(1, sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)))))) END, 6) AS angle, bool_or(a <> 0) AND bool_or(b <> 0) AS valid FROM v GROUP BY 1, 2, 3')
def spectral_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("trace"), F.col("other")
    return _pairs(spark, sf_dir).select("group", "i", "j", F.round(scoring.spectral_angle(a, b), 6).alias("angle"), scoring.has_angle(a, b).alias("valid"))


@query("rmsd", _PAIRS + ' SELECT grp AS "group", i, j, round(sqrt(avg((a - b) * (a - b))), 6) AS rmsd FROM v GROUP BY 1, 2, 3')
def rmsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("group", "i", "j", F.round(scoring.rmsd(F.col("trace"), F.col("other")), 6).alias("rmsd"))


@query("norm_manhattan", _PAIRS + ', s AS (SELECT grp, i, j, sum(abs(a)) AS sa, sum(abs(b)) AS sb FROM v GROUP BY 1, 2, 3) SELECT grp AS "group", i, j, round(avg(abs(abs(a) / sa - abs(b) / sb)), 6) AS distance FROM v JOIN s USING (grp, i, j) GROUP BY 1, 2, 3')
def norm_manhattan(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda c: F.transform(c, lambda v: F.abs(v))
    return _pairs(spark, sf_dir).select("group", "i", "j", F.round(scoring.normalized_manhattan(size("trace"), size("other")), 6).alias("distance"))


# Identifications


@query("ids_at_fdr_strict", with_("scored") + " SELECT charge, count(*) AS total, count(*) FILTER (decoy = 0) AS targets FROM scored WHERE q_value < 0.05 GROUP BY charge")
def ids_at_fdr_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = compare.at_threshold(proxy(spark, sf_dir, "scored"), 0.05, inclusive=False)
    return ok.groupBy("charge").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("decoy") == 0).alias("targets"))


@query("ids_at_fdr_inclusive", with_("scored", "mapping", "peptides") + " SELECT DISTINCT unmodified AS seq, charge FROM scored JOIN mapping USING (precursor_id) JOIN peptides USING (peptide_id) WHERE q_value <= 0.05 AND decoy = 0")
def ids_at_fdr_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.identified_peptides(proxy(spark, sf_dir, "scored"), proxy(spark, sf_dir, "mapping"), proxy(spark, sf_dir, "peptides"), 0.05)


@query("report_ids", "SELECT DISTINCT p_name AS seq, (1 + l_linenumber % 4)::INT AS charge FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_tax <= 0.01")
def report_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    report = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.lit(0.0).alias("PG.Q.Value"), F.col("l_discount").alias("Global.Q.Value"), F.col("l_tax").alias("Q.Value"), F.lit("x").alias("PeptideSequence"), F.col("p_name").alias("Peptide.Sequence"), (1 + F.col("l_linenumber") % 4).cast("int").alias("Precursor.Charge"),
    )
    return compare.report_ids(report)


@query("distinct_ids_3level", with_("scored", "mapping", "peptides", "protein_map") + ", ok AS (SELECT DISTINCT precursor_id FROM scored WHERE q_value < 0.01 AND decoy = 0), f AS (SELECT DISTINCT peptide_id FROM mapping WHERE precursor_id IN (SELECT precursor_id FROM ok)) SELECT (SELECT count(*) FROM ok) AS n_precursors, (SELECT count(DISTINCT modified) FROM peptides WHERE peptide_id IN (SELECT peptide_id FROM f)) AS n_peptides, (SELECT count(DISTINCT protein_id) FROM protein_map WHERE peptide_id IN (SELECT peptide_id FROM f)) AS n_proteins")
def distinct_ids_3level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.distinct_ids(*(proxy(spark, sf_dir, t) for t in ("scored", "mapping", "peptides", "protein_map")), q=0.01)


def _id_sets(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return [lines.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("seq")) for flag in ("A", "R")]


_SETS = "WITH a AS (SELECT DISTINCT l_partkey AS seq FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS seq FROM lineitem WHERE l_returnflag = 'R')"


@query("id_overlap", _SETS + " SELECT seq, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT seq, 'a' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT seq, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def id_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _id_sets(spark, sf_dir)
    return compare.shared_ids(a, b).withColumn("side", F.lit("both")).union(compare.only_ids(a, b).withColumn("side", F.lit("a"))).union(compare.only_ids(b, a).withColumn("side", F.lit("b")))


@query("id_jaccard", _SETS + " SELECT count(*) FILTER (a.seq IS NOT NULL AND b.seq IS NOT NULL) AS n_both, count(*) FILTER (b.seq IS NULL) AS n_only_a, count(*) FILTER (a.seq IS NULL) AS n_only_b, count(*) AS n_union, count(*) FILTER (a.seq IS NOT NULL AND b.seq IS NOT NULL)::DOUBLE / nullif(count(*), 0) AS jaccard FROM a FULL JOIN b USING (seq)")
def id_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.overlap(*_id_sets(spark, sf_dir))


@query("length_hist", with_("peptides") + " SELECT length(unmodified)::INT AS len, count(DISTINCT unmodified) AS n FROM peptides GROUP BY 1")
def length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.length_histogram(proxy(spark, sf_dir, "peptides").withColumnRenamed("unmodified", "seq"))


@query("charge_hist", with_("scored") + " SELECT charge, count(*) AS n FROM scored WHERE charge IS NOT NULL GROUP BY charge")
def charge_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.charge_histogram(proxy(spark, sf_dir, "scored"))


# Libraries

_VENDOR = {"PrecursorMz": "Precursor.Mz", "ProductMz": "Product.Mz", "PrecursorCharge": "Precursor.Charge", "ProductCharge": "Fragment.Charge", "LibraryIntensity": "Relative.Intensity", "NormalizedRetentionTime": "RT", "FragmentType": "Fragment.Type", "FragmentSeriesNumber": "Fragment.Series.Number", "TransitionGroupId": "Precursor.Id", "Decoy": "Decoy"}


@query(
    "convert_library",
    with_("transitions") + ' SELECT "TransitionGroupId", "TransitionGroupId" || \'_\' || (row_number() OVER (PARTITION BY "TransitionGroupId" ORDER BY "ProductMz", "TransitionId") - 1)::VARCHAR AS "TransitionId", round("ProductMz", 6) AS "ProductMz", "NormalizedRetentionTime" * 60 AS "NormalizedRetentionTime", 0 AS "Decoy", 1 AS "DetectingTransition", 0 AS "IdentifyingTransition", 1 AS "QuantifyingTransition" FROM transitions WHERE "Decoy" = 0',
)
def convert_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = proxy(spark, sf_dir, "transitions")
    vendor = t.select(*(F.col(c).alias(v) for c, v in _VENDOR.items()), F.col("TransitionGroupId").alias("Stripped.Sequence"), F.lit("P").alias("Protein.Group"), F.struct("ProductMz", "TransitionId").alias("input_order"))
    found = library.convert_library(vendor)
    return found.select("TransitionGroupId", "TransitionId", F.round("ProductMz", 6).alias("ProductMz"), "NormalizedRetentionTime", "Decoy", "DetectingTransition", "IdentifyingTransition", "QuantifyingTransition")


@query(
    "convert_vendor_columns",
    with_("transitions") + ' SELECT "TransitionGroupId", "TransitionGroupId" || \'_\' || (row_number() OVER (PARTITION BY "TransitionGroupId" ORDER BY "ProductMz", "TransitionId") - 1)::VARCHAR AS "TransitionId", "LibraryIntensity", "NormalizedRetentionTime", \'M\' || "TransitionGroupId" AS "ModifiedPeptideSequence", \'A\' AS "ProteinId", \'G\' || "FragmentSeriesNumber"::VARCHAR AS "GeneName", round("ProductMz" / 1000, 6) AS "PrecursorIonMobility", "ProductCharge" FROM transitions WHERE "Decoy" = 0',
)
def convert_vendor_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several names of a column at once: the first in order is taken."""
    t = proxy(spark, sf_dir, "transitions")
    vendor = t.select(
        "PrecursorMz", "ProductMz", "PrecursorCharge", F.lit(9).alias("ProductCharge"), F.col("ProductCharge").alias("FragmentCharge"), F.lit(0.0).alias("LibraryIntensity"),
        F.col("LibraryIntensity").alias("Relative.Intensity"), F.lit(-1.0).alias("iRT"), F.lit(-2.0).alias("RetentionTime"), F.col("NormalizedRetentionTime").alias("Tr_recalibrated"),
        F.lit("x").alias("StrippedPeptide"), F.col("TransitionGroupId").alias("PeptideSequence"), F.concat(F.lit("M"), "TransitionGroupId").alias("FullUniModPeptideName"),
        F.lit("B").alias("ProteinName"), F.lit("A").alias("Protein.Ids"), F.lit("x").alias("GeneName"), F.concat(F.lit("G"), F.col("FragmentSeriesNumber").cast("string")).alias("Genes"),
        F.lit(0.0).alias("IonMobility"), (F.col("ProductMz") / 1000).alias("IM"), F.col("TransitionGroupId").alias("transition_group_id"), F.col("Decoy").alias("decoy"), F.struct("ProductMz", "TransitionId").alias("input_order"),
    )
    found = library.convert_library(vendor, "seconds")
    return rounded(found.select("TransitionGroupId", "TransitionId", "LibraryIntensity", "NormalizedRetentionTime", "ModifiedPeptideSequence", "ProteinId", "GeneName", "PrecursorIonMobility", "ProductCharge"), "PrecursorIonMobility")


@query("library_summary", with_("transitions") + ' SELECT count(*) AS n_transitions, count(DISTINCT "TransitionGroupId") AS n_groups, round(count(*)::DOUBLE / count(DISTINCT "TransitionGroupId"), 9) AS per_group, count(*) FILTER ("Decoy" = 0) AS n_target, count(*) FILTER ("Decoy" = 1) AS n_decoy, min("NormalizedRetentionTime") AS rt_min, max("NormalizedRetentionTime") AS rt_max FROM transitions')
def library_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(library.library_summary(proxy(spark, sf_dir, "transitions")), "per_group", digits=9)


_RANKED = with_("transitions") + ', r AS (SELECT *, row_number() OVER (PARTITION BY "TransitionGroupId" ORDER BY "LibraryIntensity" DESC, "ProductMz", "TransitionId") AS r, count(*) OVER (PARTITION BY "TransitionGroupId") AS n FROM transitions)'


@query("top6_transitions", _RANKED + ' SELECT "TransitionGroupId", "TransitionId", round("ProductMz", 6) AS "ProductMz", "LibraryIntensity" FROM r WHERE r <= 6 AND n >= 6')
def top6_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.detecting(proxy(spark, sf_dir, "transitions")).select("TransitionGroupId", "TransitionId", F.round("ProductMz", 6).alias("ProductMz"), "LibraryIntensity")


_WINDOWS = [(300.0 + 40 * i, 340.0 + 40 * i) for i in range(60)]


@query("restrict_mz", with_("transitions") + ', w AS (SELECT 300 + 40 * i AS lo, 340 + 40 * i AS hi FROM range(60) g(i)) SELECT "TransitionId", round("ProductMz", 6) AS "ProductMz" FROM transitions t WHERE "ProductMz" BETWEEN 350 AND 2000 AND "FragmentType" IN (\'b\', \'y\') AND "ProductCharge" BETWEEN 1 AND 1 AND NOT EXISTS (SELECT 1 FROM w WHERE i_prec >= lo AND i_prec < hi AND "ProductMz" >= lo AND "ProductMz" < hi)'.replace("i_prec", '"PrecursorMz" / 2'))
def restrict_mz(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = proxy(spark, sf_dir, "transitions").withColumn("PrecursorMz", F.col("PrecursorMz") / 2)
    return library.restrict(t, max_charge=1, swaths=spark.createDataFrame(_WINDOWS, "lower double, upper double")).select("TransitionId", F.round("ProductMz", 6).alias("ProductMz"))


@query("append_decoys", with_("transitions") + ' SELECT "TransitionGroupId", "TransitionId", 0 AS "Decoy" FROM transitions UNION ALL SELECT \'DECOY_\' || "TransitionGroupId", \'DECOY_\' || "TransitionId", 1 FROM transitions')
def append_decoys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = proxy(spark, sf_dir, "transitions").select("TransitionGroupId", "TransitionId").withColumn("Decoy", F.lit(0))
    return library.append_decoys(t, t)


# Peptides

_CUT = with_("whole_proteins") + (
    ", c AS (SELECT ordinal, sequence, list_concat([0], list_filter(range(1, length(sequence)), lambda i: sequence[i] IN ('K', 'R') AND sequence[i + 1] <> 'P'), [length(sequence)]) AS cuts FROM whole_proteins WHERE length(sequence) > 0),"
    " a AS (SELECT ordinal, sequence, cuts, unnest(range(1, len(cuts))) AS i FROM c), b AS (SELECT ordinal, sequence, cuts, i, unnest(range(1, 3)) AS n FROM a),"
    " p AS (SELECT ordinal, cuts[i] AS start, sequence[cuts[i] + 1:cuts[i + n]] AS peptide FROM b WHERE i + n <= len(cuts)), q AS (SELECT * FROM p WHERE length(peptide) BETWEEN 7 AND 30)"
)


@query("tryptic_digest", _CUT + " SELECT ordinal, start::INT AS start, peptide FROM q")
def tryptic_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.tryptic_peptides(all_proteins(spark, sf_dir)).select("ordinal", "start", "peptide")


@query("peptide_validity", _CUT + " SELECT peptide, regexp_full_match(peptide, '[ACDEFGHIKLMNPQRSTVWY]+') AS valid, count(*) AS n FROM q GROUP BY 1, 2")
def peptide_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = digest.tryptic_peptides(all_proteins(spark, sf_dir))
    return p.groupBy("peptide", digest.is_valid_precursor(F.col("peptide"), F.lit(2)).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("first_protein_dedup", _CUT + ", v AS (SELECT * FROM q WHERE regexp_full_match(peptide, '[ACDEFGHIKLMNPQRSTVWY]+')), z AS (SELECT *, unnest([2, 3]) AS charge FROM v) SELECT peptide, charge::INT AS charge, arg_min('P' || ordinal::VARCHAR, (ordinal, start)) AS protein FROM z GROUP BY peptide, charge")
def first_protein_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.precursors(all_proteins(spark, sf_dir), policy=None).select(F.col("modseq").alias("peptide"), "charge", "protein")


_MINI = "regexp_replace(upper(p_name) || 'MCM', '[^ACDEFGHIKLMNPQRSTVWY]+', ''{0})"


def _mini(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cleaned names of parts as peptides."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.expr(_MINI.format("")).alias("peptide")).distinct()


_DUCK_MINI = f"WITH p AS (SELECT DISTINCT {_MINI.format(', ' + chr(39) + 'g' + chr(39))} AS peptide FROM part)"


@query(
    "peptidoforms",
    _DUCK_MINI + ", s AS (SELECT peptide, list_concat(list_filter(range(1, length(peptide) + 1), lambda i: peptide[i] = 'M'), [0]) AS slots FROM p), m AS (SELECT peptide, slots, unnest(range(0, (1 << len(slots))::BIGINT)) AS mask FROM s),"
    " k AS (SELECT peptide, list_filter(slots, lambda x, i: (mask >> (i - 1)::BIGINT) & 1 = 1) AS pick FROM m WHERE bit_count(mask) <= 2)"
    " SELECT DISTINCT peptide, CASE WHEN list_contains(pick, 0) THEN '.(UniMod:1)' ELSE '' END || array_to_string(list_transform(range(1, length(peptide) + 1), lambda i: peptide[i] || CASE WHEN peptide[i] = 'C' THEN '(UniMod:4)' WHEN list_contains(pick, i) THEN '(UniMod:35)' ELSE '' END), '') AS form FROM k",
)
def peptidoforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mini(spark, sf_dir).select("peptide", F.explode(digest.peptidoforms(F.col("peptide"))).alias("form"))


@query("prefix_suffix_groups", with_("whole_proteins") + ", a AS (SELECT sequence, unnest(range(0, length(sequence) - 7)) AS start FROM whole_proteins WHERE length(sequence) >= 8), b AS (SELECT sequence, start, unnest(range(8, 13)) AS n FROM a), c AS (SELECT sequence[start + 1:start + n] AS pep FROM b WHERE start + n <= length(sequence)) SELECT 'p:' || left(pep, 5) AS u, 's:' || right(pep, 5) AS v, count(*) AS peptides FROM c GROUP BY 1, 2")
def prefix_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percolation.group_edges(all_proteins(spark, sf_dir), 5)


@query("percolation")
def percolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percolation.percolate(all_proteins(spark, sf_dir), 5)


_DUCK_MASS = "CASE c " + " ".join(f"WHEN '{r}' THEN {m!r}::DOUBLE" for r, m in chemistry.RESIDUES.items()) + " END"
_RES = _DUCK_MINI + f", r AS (SELECT peptide, i, {_DUCK_MASS} AS m FROM (SELECT peptide, unnest(range(1, length(peptide) + 1)) AS i, unnest(string_split(peptide, '')) AS c FROM p))"


@query("precursor_mz", _RES + f", z AS (SELECT unnest([1, 2, 3]) AS charge) SELECT peptide, charge::INT AS charge, round((sum(m) + {chemistry.WATER!r}::DOUBLE + charge * {chemistry.PROTON!r}::DOUBLE) / charge, 6) AS mz FROM r, z GROUP BY peptide, charge")
def precursor_mz(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _mini(spark, sf_dir).withColumn("charge", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return p.select("peptide", "charge", F.round(chemistry.precursor_mz(chemistry.residue_masses(F.col("peptide")), F.col("charge")), 6).alias("mz"))


_IONS = _RES + (
    ", n AS (SELECT peptide, length(peptide) AS n FROM p), s AS (SELECT peptide, n, unnest(range(1, n)) AS series FROM n), z AS (SELECT unnest([1, 2]) AS charge),"
    f" b AS (SELECT peptide, 'b' AS type, series, charge, n, (sum(m) + charge * {chemistry.PROTON!r}::DOUBLE) / charge AS mz FROM s JOIN r USING (peptide), z WHERE i <= series GROUP BY peptide, series, charge, n),"
    f" y AS (SELECT peptide, 'y' AS type, series, charge, n, (sum(m) + {chemistry.WATER!r}::DOUBLE + charge * {chemistry.PROTON!r}::DOUBLE) / charge AS mz FROM s JOIN r USING (peptide), z WHERE i > n - series GROUP BY peptide, series, charge, n), ions AS (SELECT * FROM b UNION ALL SELECT * FROM y)"
)


def _ions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mini(spark, sf_dir).select("peptide", F.inline(chemistry.fragment_ions(chemistry.residue_masses(F.col("peptide")), F.lit(2))))


@query("fragment_ions", _IONS + " SELECT peptide, type, series::INT AS series, charge::INT AS charge, round(mz, 6) AS mz FROM ions")
def fragment_ions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ions(spark, sf_dir), "mz")


@query("fragment_channel_index", _IONS + " SELECT DISTINCT type, series::INT AS series, charge::INT AS charge, n::INT AS n, ((CASE WHEN type = 'b' THEN series - 1 ELSE n - 1 - series END) * 8 + CASE WHEN type = 'b' THEN charge - 1 ELSE charge + 1 END)::INT AS idx FROM ions")
def fragment_channel_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = chemistry.fragment_index(F.col("type"), F.col("series"), F.col("charge"), F.length("peptide"))
    return _ions(spark, sf_dir).select("type", "series", "charge", F.length("peptide").alias("n"), at.alias("idx")).distinct()


@query("transition_ids", _IONS + " SELECT peptide, type, series::INT AS series, charge::INT AS charge, peptide || '_' || (row_number() OVER (PARTITION BY peptide ORDER BY round(mz, 6), type, series, charge) - 1)::VARCHAR AS id FROM ions")
def transition_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(W.partitionBy("peptide").orderBy(F.round("mz", 6), "type", "series", "charge")) - 1
    return _ions(spark, sf_dir).select("peptide", "type", "series", "charge", F.concat_ws("_", "peptide", number.cast("string")).alias("id"))


@query(
    "inverse_mobility",
    with_("features") + f", m AS (SELECT feature_id, mz, CASE WHEN feature_id % 10 = 0 THEN 0 ELSE 300 + score * 200 END AS ccs, 1 + feature_id % 3 AS z FROM features) SELECT feature_id, round(CASE WHEN ccs > 0 THEN ccs * sqrt(mz * z * {chemistry.N2_MASS}::DOUBLE / (mz * z + {chemistry.N2_MASS}::DOUBLE)) / (z * {chemistry.MASON_SCHAMP}::DOUBLE) ELSE -1 END, 6) AS k0 FROM m",
)
def inverse_mobility(spark: SparkSession, sf_dir: str) -> DataFrame:
    ccs = F.when(F.col("feature_id") % 10 == 0, 0.0).otherwise(300 + F.col("score") * 200)
    return proxy(spark, sf_dir, "features").select("feature_id", F.round(chemistry.inverse_mobility(ccs, F.col("mz"), 1 + F.col("feature_id") % 3), 6).alias("k0"))


@query(
    "modx_elements",
    _DUCK_MINI + ", s AS (SELECT peptide, unnest(range(1, length(peptide) + 1)) AS position FROM p), e AS (SELECT peptide, position, unnest(CASE peptide[position] WHEN 'M' THEN [{'e': 'O', 'n': 1}] WHEN 'C' THEN [{'e': 'C', 'n': 2}, {'e': 'H', 'n': 3}, {'e': 'N', 'n': 1}, {'e': 'O', 'n': 1}] ELSE [] END) AS x FROM s) SELECT peptide, position::INT AS position, x.e AS element, x.n::INT AS count FROM e",
)
def modx_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.filter(F.split("peptide", ""), lambda c: c != "")
    at = F.filter(F.transform(letters, lambda c, i: F.struct(c.alias("c"), (i + 1).alias("i"))), lambda x: x["c"].isin("M", "C"))
    mods = F.array_join(F.transform(at, lambda x: F.when(x["c"] == "M", "Oxidation@M").otherwise("Carbamidomethyl@C")), ";")
    sites = F.array_join(F.transform(at, lambda x: x["i"].cast("string")), ";")
    return _mini(spark, sf_dir).select("peptide", F.inline(chemistry.element_rows(mods, sites)))


# Libraries from peptides, in SQL. A form is its peptide and the places it modifies (0 is the N-terminus).

_SWAPPED = "CASE right(peptide, 1) WHEN 'K' THEN 'R' WHEN 'R' THEN 'K' ELSE right(peptide, 1) END"


def _decoys_sql(forms: str) -> str:
    """CTEs from ``forms`` (form, peptide, pick): ``chosen`` (form, peptide, pick, perm, decoy), the first shuffle that differs enough."""
    token = "peptide[i] || CASE WHEN mods AND peptide[i] = 'C' THEN '(UniMod:4)' WHEN list_contains(pick, i) THEN '(UniMod:35)' ELSE '' END"
    return (
        f", da AS (SELECT form, peptide, pick, mods, unnest(range(0, 10)) AS seed FROM {forms}),"
        " db AS (SELECT form, peptide, pick, mods, seed, unnest(range(1, length(peptide))) AS i FROM da),"
        f" dc AS (SELECT form, peptide, any_value(pick) AS pick, any_value(mods) AS mods, seed, list(i ORDER BY md5(form || ':' || (i - 1)::VARCHAR || ':' || seed::VARCHAR)) AS perm, string_agg({token}, '' ORDER BY md5(form || ':' || (i - 1)::VARCHAR || ':' || seed::VARCHAR)) AS body FROM db GROUP BY form, peptide, seed),"
        f" dd AS (SELECT *, (len(list_filter(range(1, length(peptide)), lambda j: peptide[perm[j]] = peptide[j])) + CASE WHEN {_SWAPPED} = right(peptide, 1) THEN 1 ELSE 0 END)::DOUBLE / length(peptide) AS same,"
        f" CASE WHEN list_contains(pick, 0) THEN '.(UniMod:1)' ELSE '' END || body || {_SWAPPED} || CASE WHEN mods AND {_SWAPPED} = 'C' THEN '(UniMod:4)' WHEN list_contains(pick, length(peptide)) THEN '(UniMod:35)' ELSE '' END AS decoy FROM dc),"
        " chosen AS (SELECT form, peptide, any_value(pick) AS pick, arg_min(perm, seed) AS perm, arg_min(decoy, seed) AS decoy FROM dd WHERE same <= 0.7::DOUBLE GROUP BY form, peptide)"
    )


@query("decoy_sequences", _DUCK_MINI + ", f AS (SELECT peptide AS form, peptide, []::BIGINT[] AS pick, false AS mods FROM p)" + _decoys_sql("f") + " SELECT peptide, decoy FROM chosen")
def decoy_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.decoy_sequences(_mini(spark, sf_dir))


def _mass_sql(residue: str) -> str:
    return _DUCK_MASS.replace("CASE c ", f"CASE {residue} ", 1)


_MOD = {k: f"{v!r}::DOUBLE" for k, v in chemistry.MODIFICATIONS.items()}
_HASH = "('0x' || left(md5(form || '|' || charge::VARCHAR || '|' || {0}), 7))::BIGINT % 10000"
#: From ``pep`` (peptide, protein): forms, the stub's intensities, all ions (``lib``), and the six best of each group in the range (``best``).
_ASSEMBLY = (
    ", sl AS (SELECT peptide, protein, list_concat(list_filter(range(1, length(peptide) + 1), lambda i: peptide[i] = 'M'), [0])[1:20] AS slots FROM pep), su AS (SELECT peptide, unnest(slots) AS x, unnest(range(1, len(slots) + 1)) AS i FROM sl),"
    " pk AS (SELECT peptide, []::BIGINT[] AS pick FROM sl UNION ALL SELECT peptide, [x] FROM su UNION ALL SELECT a.peptide, [a.x, b.x] FROM su a JOIN su b ON a.peptide = b.peptide AND a.i < b.i),"
    " fo AS (SELECT peptide, protein, pick, length(peptide) AS n, true AS mods, CASE WHEN list_contains(pick, 0) THEN '.(UniMod:1)' ELSE '' END || array_to_string(list_transform(range(1, length(peptide) + 1), lambda i: peptide[i] || CASE WHEN peptide[i] = 'C' THEN '(UniMod:4)' WHEN list_contains(pick, i) THEN '(UniMod:35)' ELSE '' END), '') AS form FROM pk JOIN sl USING (peptide)),"
    " re AS (SELECT form, n, i, " + _mass_sql("peptide[i]") + f" + CASE WHEN peptide[i] = 'C' THEN {_MOD['4']} WHEN list_contains(pick, i) THEN {_MOD['35']} ELSE 0 END + CASE WHEN i = 1 AND list_contains(pick, 0) THEN {_MOD['1']} ELSE 0 END AS m FROM (SELECT form, n, peptide, pick, unnest(range(1, n + 1)) AS i FROM fo)),"
    " cu AS (SELECT form, n, i, sum(m) OVER (PARTITION BY form ORDER BY i) AS part, sum(m) OVER (PARTITION BY form) AS whole FROM re),"
    f" io AS (SELECT form, n, 'b' AS type, i AS series, part AS mass, (i - 1) * 8 AS place FROM cu WHERE i < n UNION ALL SELECT form, n, 'y', n - i, whole - part + {chemistry.WATER!r}::DOUBLE, (i - 1) * 8 + 2 FROM cu WHERE i < n),"
    f" ch AS (SELECT form, type, series, unnest([1, 2]) AS z, mass, place FROM io), cz AS (SELECT form, charge, type, series, z, (mass + z * {chemistry.PROTON!r}::DOUBLE) / z AS mz, place + z - 1 AS idx FROM ch, (SELECT unnest([2, 3]) AS charge)),"
    " va AS (SELECT *, CASE WHEN idx = 0 THEN 0::FLOAT ELSE ((" + _HASH.format("idx::VARCHAR") + " + 1) / 10001.0::DOUBLE)::FLOAT END AS v FROM cz), vt AS (SELECT *, max(v) OVER (PARTITION BY form, charge) AS top FROM va),"
    " lib AS (SELECT form, charge, type, series, z, mz, v::DOUBLE / top::DOUBLE AS intensity, row_number() OVER (PARTITION BY form, charge ORDER BY round(mz, 6), type, series, z) - 1 AS k FROM vt WHERE v > 0),"
    " ra AS (SELECT *, row_number() OVER (PARTITION BY form, charge ORDER BY intensity DESC, round(mz, 6), form || '_' || charge::VARCHAR || '_' || k::VARCHAR) AS r, count(*) OVER (PARTITION BY form, charge) AS c FROM lib WHERE mz BETWEEN 350 AND 2000),"
    " best AS (SELECT form, peptide, protein, charge, type, series, z, mz, intensity, k FROM ra JOIN fo USING (form) WHERE r <= 6 AND c >= 6)"
)
_ROW = "{0} || form || '_' || charge::VARCHAR AS \"TransitionGroupId\", {0} || form || '_' || charge::VARCHAR || '_' || k::VARCHAR AS \"TransitionId\", round({1}, 3) AS \"ProductMz\", round(intensity, 6) AS \"LibraryIntensity\", {0} || protein AS \"ProteinId\", {2} AS \"PeptideSequence\""
_COLUMNS = ("TransitionGroupId", "TransitionId", "ProductMz", "LibraryIntensity", "ProteinId", "PeptideSequence")


@query("library_assembly", _CUT + ", pep AS (SELECT peptide, arg_min('P' || ordinal::VARCHAR, (ordinal, start)) AS protein FROM q WHERE regexp_full_match(peptide, '[ACDEFGHIKLMNPQRSTVWY]+') GROUP BY peptide)" + _ASSEMBLY + " SELECT " + _ROW.format("''", "mz", "peptide") + " FROM best")
def library_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = digest.precursors(all_proteins(spark, sf_dir))
    made = library.assemble_best(found, library.stub_predictor)
    return rounded(rounded(made.select(*_COLUMNS), "ProductMz", digits=3), "LibraryIntensity")


@query(
    "library_with_decoys",
    _DUCK_MINI + ", pep AS (SELECT peptide, 'UNKNOWN' AS protein FROM p)" + _ASSEMBLY + ", tf AS (SELECT DISTINCT form, peptide, pick, mods FROM fo JOIN best USING (form, peptide))" + _decoys_sql("tf")
    + ", dr AS (SELECT form, decoy, length(peptide) AS n, j, " + _mass_sql("CASE WHEN j < length(peptide) THEN peptide[perm[j]] ELSE " + _SWAPPED + " END")
    + f" + CASE WHEN (CASE WHEN j < length(peptide) THEN peptide[perm[j]] ELSE {_SWAPPED} END) = 'C' THEN {_MOD['4']} WHEN list_contains(pick, CASE WHEN j < length(peptide) THEN perm[j] ELSE length(peptide) END) THEN {_MOD['35']} ELSE 0 END + CASE WHEN j = 1 AND list_contains(pick, 0) THEN {_MOD['1']} ELSE 0 END AS m"
    " FROM (SELECT *, unnest(range(1, length(peptide) + 1)) AS j FROM chosen)), dm AS (SELECT form, decoy, n, j, sum(m) OVER (PARTITION BY form ORDER BY j) AS part, sum(m) OVER (PARTITION BY form) AS whole FROM dr),"
    f" dz AS (SELECT b.*, d.decoy, CASE WHEN b.type = 'b' THEN (d.part + z * {chemistry.PROTON!r}::DOUBLE) / z ELSE (d.whole - d.part + {chemistry.WATER!r}::DOUBLE + z * {chemistry.PROTON!r}::DOUBLE) / z END AS dmz FROM best b JOIN dm d ON b.form = d.form AND d.j = CASE WHEN b.type = 'b' THEN b.series ELSE d.n - b.series END)"
    + " SELECT " + _ROW.format("''", "mz", "peptide") + ", 0 AS \"Decoy\" FROM best UNION ALL SELECT " + _ROW.format("'DECOY_'", "dmz", "regexp_replace(decoy, '\\.?\\(UniMod:[0-9]+\\)', '', 'g')") + ", 1 FROM dz",
)
def library_with_decoys(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = _mini(spark, sf_dir).select("peptide", F.explode(digest.peptidoforms(F.col("peptide"))).alias("modseq"), F.lit(None).cast("string").alias("protein"))
    found = forms.withColumn("charge", F.explode(F.sequence(F.lit(2), F.lit(3))))
    made = library.with_decoys(library.assemble(found, library.stub_predictor))
    return rounded(rounded(made.select(*_COLUMNS, "Decoy"), "ProductMz", digits=3), "LibraryIntensity")


@query("stream_index", _INDEX + " SELECT win_key, block, count(*) AS n_peaks, min(bin) AS min_bin, max(bin) AS max_bin, round(sum(intensity::DOUBLE), 3) AS intensity FROM i GROUP BY win_key, block")
def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from uuid import uuid4

    from peakloom.plans.proxies import spark_sql

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"index_{uuid4().hex}"
    running = start_index(spark.sql(spark_sql("peaks"), events=events), name)
    running.awaitTermination()
    return rounded(read_index(spark, name), "intensity", digits=3)

from peakloom.plans import roundtrips, search  # noqa: E402, F401  register their queries too
