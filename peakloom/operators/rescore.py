"""Competition of candidates at one locus: same isolation window, near in retention time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakloom.functions.binning import grid_window
from peakloom.operators.competition import rivals
from peakloom.operators.quantiles import below, medians
from peakloom.plans.durable import durable, durable_table
from peakloom.sources.sqlite import read_sqlite, update_sqlite

FEATURE_COLUMNS = ("best_delta", "tot_ratio", "rival_rank", "n_compet")


def competitive_features(df: DataFrame, rt_tol: float = 15.0, width: float = 24.0, keep: tuple[str, ...] = (), blocks_of: float = 64.0, most: int = 500_000) -> DataFrame:
    """``df`` (feature_id, mz, rt, score, decoy) with four features of each candidate among its rivals.

    Rivals are the other candidates of the ``width``-Th cell within ``rt_tol`` seconds, both ends included, targets and
    decoys in one pool. ``best_delta``: own score less the best rival's, 0 without rivals. ``tot_ratio``: log of own
    over the locus's summed score, self included. ``rival_rank``: share of rivals that are strictly better.
    ``n_compet``: log1p of the number of rivals. A candidate without score, m/z or retention time (null or not a number) has
    null features and is nobody's rival. Repeated rows are rivals of each other.

    A window has few cells, so each is cut into retention-time blocks of ``blocks_of`` tolerances; those of more than ``most``
    candidates are cut further (``competition.rivals``).
    """
    there = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    whole = F.coalesce(there("mz") & there("rt") & there("score"), F.lit(False))
    of = df.select("feature_id", *keep, "mz", "rt", "score")
    found = rivals(of.where(whole), grid_window(F.col("mz"), width), F.col("rt"), F.col("score"), rt_tol, blocks_of, most)
    others, own = F.col("__n") - 1, F.col("score")
    features = found.select(
        "feature_id", *keep,
        F.when(others > 0, own - F.col("__best")).otherwise(F.lit(0.0)).alias("best_delta"),
        F.log((F.abs(own) + 1e-6) / (F.abs("__total") + 1e-6)).alias("tot_ratio"),
        F.when(others > 0, F.col("__better") / others).otherwise(F.lit(0.0)).alias("rival_rank"),
        F.log1p(others.cast("double")).alias("n_compet"),
    )
    lacking = of.where(~whole).select("feature_id", *keep, *(F.lit(None).cast("double").alias(c) for c in FEATURE_COLUMNS))
    return features.unionByName(lacking)


def competitive_summary(features: DataFrame) -> DataFrame:
    """Interpolated medians by decoy status, exact and without a group in one task."""
    rivals = features.select("decoy", F.col("best_delta").alias("median_best_delta"), F.col("rival_rank").alias("median_rival_rank"), F.expm1("n_compet").alias("median_rivals"))
    return medians(rivals, ["decoy"], ["median_best_delta", "median_rival_rank", "median_rivals"], rows="n")


def osw_features(feature: DataFrame, feature_ms2: DataFrame, precursor: DataFrame, score: str = "VAR_XCORR_SHAPE") -> DataFrame:
    """Features with the chosen score of the MS2 table and their precursor: (feature_id, mz, rt, score, decoy). A score that
    the table lacks is an error that lists its columns."""
    if score not in feature_ms2.columns:
        raise ValueError(f"no score {score}; the table has {', '.join(feature_ms2.columns)}")
    f = feature.select(F.col("ID").alias("feature_id"), F.col("PRECURSOR_ID").alias("precursor_id"), F.col("EXP_RT").alias("rt"))
    m = feature_ms2.select(F.col("FEATURE_ID").alias("feature_id"), F.col(score).alias("score"))
    p = precursor.select(F.col("ID").alias("precursor_id"), F.col("PRECURSOR_MZ").alias("mz"), F.col("DECOY").alias("decoy"))
    return f.join(m, "feature_id").join(p, "precursor_id").select("feature_id", "mz", "rt", "score", "decoy")


#: The columns of the MS2 table that hold the features, in the order of ``FEATURE_COLUMNS``.
OSW_COLUMNS = ("VAR_LOCUS_BEST_DELTA", "VAR_LOCUS_TOT_RATIO", "VAR_LOCUS_RANK", "VAR_LOCUS_N_COMPET")


def rescore_osw(spark: SparkSession, path: str, score: str = "VAR_XCORR_SHAPE", rt_tol: float = 15.0) -> DataFrame:
    """Read a scored run's SQLite file, add the competitive features to its MS2 table (those there are replaced), and
    return the summary by decoy status."""
    tables = [read_sqlite(spark, path, t) for t in ("FEATURE", "FEATURE_MS2", "PRECURSOR")]
    # The file is read before it is written.
    found = durable(competitive_features(osw_features(*tables, score), rt_tol, keep=("decoy",)))
    renamed = found.select("feature_id", *(F.col(c).alias(o) for c, o in zip(FEATURE_COLUMNS, OSW_COLUMNS, strict=True)))
    update_sqlite(renamed, path, "FEATURE_MS2", "FEATURE_ID", OSW_COLUMNS, "feature_id")
    return competitive_summary(found)


def write_back(table: DataFrame, features: DataFrame, id_col: str = "feature_id") -> DataFrame:
    """``table`` with the feature columns, replaced where ``features`` has the row and kept as they were elsewhere."""
    fresh = features.select(F.col(id_col).alias("__id"), *(F.col(c).alias(f"__{c}") for c in FEATURE_COLUMNS))
    old = lambda c: F.col(c) if c in table.columns else F.lit(None).cast("double")
    joined = table.join(fresh, table[id_col] == F.col("__id"), "left")
    rest = [c for c in table.columns if c not in FEATURE_COLUMNS]
    return joined.select(*rest, *(F.when(F.col("__id").isNotNull(), F.col(f"__{c}")).otherwise(old(c)).alias(c) for c in FEATURE_COLUMNS))


def target_decoy_qvalues(df: DataFrame, score: str = "score", decoy: str = "decoy", unit: str = "feature", ranges: int = 64) -> DataFrame:
    """``df`` with ``fdr``, ``q_value`` and the declared error ``unit``: decoys over targets at the score or better, and
    the least of these over all scores that are no better.

    Scores are counted first (one row for each distinct score); running sums go over that table in ranges of scores,
    each summed alone and offset by the totals of better ranges. Ties share a value.
    """
    # Kept, as approximate cuts differ from one evaluation to the next: sums and offsets must be of the same ranges.
    at = durable_table(df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("__s")).agg(F.sum((F.col(decoy) == 1).cast("bigint")).alias("d"), F.sum((F.col(decoy) == 0).cast("bigint")).alias("t")), "qvalue-scores")
    cuts = F.percentile_approx("__s", F.array(*(F.lit(i / ranges) for i in range(1, ranges))), F.lit(10_000))
    part = at.crossJoin(F.broadcast(durable(at.agg(cuts.alias("cuts"))))).withColumn("r", below(F.col("cuts"), F.col("__s"), ranges - 1)).drop("cuts")
    sums = part.groupBy("r").agg(F.sum("d").alias("rd"), F.sum("t").alias("rt"))
    better = W.orderBy(F.desc("r")).rowsBetween(W.unboundedPreceding, -1)
    base = sums.select("r", F.coalesce(F.sum("rd").over(better), F.lit(0)).alias("d0"), F.coalesce(F.sum("rt").over(better), F.lit(0)).alias("t0"))
    within = W.partitionBy("r").orderBy(F.col("__s").desc())
    run = part.join(F.broadcast(base), "r").withColumn("fdr", F.try_divide((F.col("d0") + F.sum("d").over(within)).cast("double"), (F.col("t0") + F.sum("t").over(within)).cast("double")))
    low = run.groupBy("r").agg(F.min("fdr").alias("m"))
    after = low.select("r", F.min("m").over(W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)).alias("later"))
    # Running from the worst score up: a frame that reaches to the end is gone through anew for each row.
    worse = W.partitionBy("r").orderBy("__s").rowsBetween(W.unboundedPreceding, 0)
    q = run.join(F.broadcast(after), "r").withColumn("q_value", F.least(F.min("fdr").over(worse), F.col("later")))
    return df.join(q.select("__s", "fdr", "q_value"), df[score] == F.col("__s"), "left").drop("__s").withColumn("unit", F.lit(unit))


