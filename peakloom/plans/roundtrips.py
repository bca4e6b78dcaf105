"""Queries that write a format to the shared folder, read it back and go on with what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.operators import digest, profile, rescore
from peakloom.plans.durable import place
from peakloom.plans.proxies import proxy
from peakloom.plans.queries import _DUCK_MINI, _mini, query, rounded, with_
from peakloom.sources import mzml, ranges, text
from peakloom.sources.sqlite import read_sqlite, write_sqlite
from peakloom.streaming.cells import drain


@query("fasta_roundtrip", with_("whole_proteins") + " SELECT protein, sequence FROM whole_proteins WHERE sequence <> ''")
def fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "fasta")
    record = F.concat(F.lit(">"), "protein", F.lit(" of a document\n"), F.regexp_replace("sequence", "(.{60})", "$1\n"))
    proxy(spark, sf_dir, "whole_proteins").where("sequence IS NOT NULL").select(record.alias("value")).write.text(path)
    return text.read_fasta(spark, path).select("protein", "sequence")


@query("peptide_list", _DUCK_MINI + ", z AS (SELECT unnest([1, 2, 3]) AS charge) SELECT peptide, charge::INT AS charge FROM p, z")
def peptide_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "peptides")
    charged = _mini(spark, sf_dir).withColumn("charge", F.explode(F.sequence(F.lit(1), F.lit(3))))
    charged.select(F.lit("-").alias("Note"), F.col("charge").alias("PrecursorCharge"), F.col("peptide").alias("PeptideSequence")).write.csv(path, sep="\t", header=True)
    return text.read_peptides(spark, path).select("peptide", "charge")


_SCANS = (
    with_("peaks") + ", s AS (SELECT scan_index, min(rt) AS rt, min(win_mz) AS win_mz, (1 + scan_index % 3)::INT AS ms_level, count(*) AS n_peaks, sum(mz) AS mz, sum(intensity) AS intensity FROM peaks GROUP BY scan_index)"
)


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of the proxy's peaks: levels 1 to 3, one window each with unequal sides."""
    scans = proxy(spark, sf_dir, "peaks").groupBy("scan_index").agg(F.min("rt").alias("rt"), F.min("win_mz").alias("win_mz"), F.sort_array(F.collect_list(F.struct("mz", "intensity"))).alias("peaks"))
    window = F.struct(F.col("win_mz").alias("mz"), F.lit(10.0).alias("iso_lower"), F.lit(14.0).alias("iso_upper"))
    return scans.select("scan_index", (1 + F.col("scan_index") % 3).cast("int").alias("ms_level"), "rt", F.lit(-1.0).alias("drift_time"), F.array(window).alias("precursors"), "peaks")


_FRAGMENTS = _SCANS + " SELECT scan_index, round(rt, 6) AS rt, win_mz, win_mz - 10 AS lower, win_mz + 14 AS upper, n_peaks::INT AS n_peaks, round(mz, 6) AS mz, round(intensity, 6) AS intensity FROM s WHERE ms_level = 2"


def _fragments(spectra: DataFrame) -> DataFrame:
    read = profile.isolation_bounds(profile.fragment_scans(spectra))
    total = lambda c: F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p[c])
    return rounded(read.select("scan_index", "rt", "win_mz", "lower", "upper", F.size("peaks").alias("n_peaks"), total("mz").alias("mz"), total("intensity").alias("intensity")), "rt", "mz", "intensity")


@query("mzml_roundtrip", _FRAGMENTS)
def mzml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "mzml")
    mzml.write_mzml(_spectra(spark, sf_dir), path)
    return _fragments(mzml.read_mzml(spark, path))


@query("mzml_ranges", _FRAGMENTS)
def mzml_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files, read by ranges of bytes."""
    path = place(spark, "mzml")
    mzml.write_mzml(_spectra(spark, sf_dir), path)
    return _fragments(ranges.read_ranges(spark, path))


@query("mzml_range_stream", _SCANS + " SELECT ms_level, count(*) AS spectra, sum(n_peaks)::BIGINT AS peaks FROM s GROUP BY ms_level")
def mzml_range_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by level over a stream that goes through each file; a batch leaves its sums, which are added at the end."""
    path, to = place(spark, "mzml"), place(spark, "counts")
    mzml.write_mzml(_spectra(spark, sf_dir), path)
    sums = lambda spectra: spectra.groupBy("ms_level").agg(F.count(F.lit(1)).alias("spectra"), F.sum(F.size("peaks").cast("bigint")).alias("peaks"))
    write = lambda batch, i: sums(batch).write.mode("overwrite").parquet(f"{to}/batch={i}")
    write(mzml.read_mzml(spark, path).where("false"), -1)  # what a stream without data leaves
    drain(ranges.stream_ranges(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", place(spark, "stream")).start())
    return spark.read.parquet(to).groupBy("ms_level").agg(F.sum("spectra").alias("spectra"), F.sum("peaks").alias("peaks"))


@query("mzml_stream_counts", _SCANS + " SELECT count(*) AS spectra, sum(n_peaks)::BIGINT AS peaks FROM s WHERE ms_level = 2")
def mzml_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, to = place(spark, "mzml"), place(spark, "counts")
    mzml.write_mzml(_spectra(spark, sf_dir), path)
    counts = mzml.parse_counts(mzml.stream_mzml(spark, path, 4))
    write = lambda batch, _: batch.write.mode("overwrite").parquet(to)
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", place(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(to)


_OSW = (
    "WITH features AS (SELECT s_suppkey AS feature_id, 400.0::DOUBLE + 7 * s_nationkey AS mz, s_acctbal AS rt, ((s_suppkey * 7919) % 100)::DOUBLE / 100 AS score FROM supplier),"
    " p AS (SELECT a.feature_id, a.score AS own, b.feature_id AS other, b.score AS s FROM features a JOIN features b ON floor(a.mz / 24) = floor(b.mz / 24) AND b.rt BETWEEN a.rt - 600 AND a.rt + 600),"
    " c AS (SELECT feature_id, any_value(own) AS own, count(*) - 1 AS n, sum(s) AS total, max(s) FILTER (other <> feature_id) AS best, count(*) FILTER (s > own) AS better FROM p GROUP BY feature_id)"
)


@query(
    "sqlite_roundtrip",
    _OSW + " SELECT feature_id, round(own, 6) AS score, round(CASE WHEN n > 0 THEN own - best ELSE 0 END, 6) AS best_delta, round(ln((abs(own) + 1e-6::DOUBLE) / (abs(total) + 1e-6::DOUBLE)), 6) AS tot_ratio,"
    " round(CASE WHEN n > 0 THEN better::DOUBLE / n ELSE 0 END, 6) AS rival_rank, round(ln(1 + n::DOUBLE), 6) AS n_compet FROM c",
)
def sqlite_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored run as an SQLite file, rescored in place and read again. Such a file has one writer, so the smallest tables
    stand for it, and the shared folder must be one that SQLite can open."""
    path = place(spark, "run").removeprefix("file:") + ".osw"
    supplier, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    tables = {
        "FEATURE": supplier.select(F.col("s_suppkey").alias("ID"), F.col("s_nationkey").alias("PRECURSOR_ID"), F.col("s_acctbal").alias("EXP_RT")),
        "FEATURE_MS2": supplier.select(F.col("s_suppkey").alias("FEATURE_ID"), (((F.col("s_suppkey") * 7919) % 100).cast("double") / 100).alias("VAR_XCORR_SHAPE")),
        "PRECURSOR": nation.select(F.col("n_nationkey").alias("ID"), (400.0 + 7 * F.col("n_nationkey")).alias("PRECURSOR_MZ"), F.lit(2).alias("CHARGE"), (F.col("n_nationkey") % 2).alias("DECOY")),
    }
    for name, rows in tables.items():
        write_sqlite(rows, path, name)
    rescore.rescore_osw(spark, path, "VAR_XCORR_SHAPE", 600.0).collect()
    again = read_sqlite(spark, path, "FEATURE_MS2")
    names = dict(zip(rescore.OSW_COLUMNS, rescore.FEATURE_COLUMNS, strict=True))
    found = again.select(F.col("FEATURE_ID").alias("feature_id"), F.col("VAR_XCORR_SHAPE").alias("score"), *(F.col(o).alias(c) for o, c in names.items()))
    return rounded(found, "score", *rescore.FEATURE_COLUMNS)


@query("peptide_charges", _DUCK_MINI + ", v AS (SELECT peptide FROM p WHERE length(peptide) >= 2) SELECT peptide, 2::INT AS charge FROM v")
def peptide_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peptides that may be precursors at a charge."""
    return _mini(spark, sf_dir).withColumn("charge", F.lit(2)).where(digest.is_valid_precursor(F.col("peptide"), F.col("charge")))
