"""Identifications at an error rate, and their overlap between engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of report columns, in order; the first present is taken.
Q_ALIASES = ("Q.Value", "Global.Q.Value", "PG.Q.Value")
SEQUENCE_ALIASES = ("Stripped.Sequence", "Peptide.Sequence", "PeptideSequence")
CHARGE_ALIASES = ("Precursor.Charge",)


def at_threshold(scores: DataFrame, q: float = 0.01, inclusive: bool = True) -> DataFrame:
    """Rows at the q-value threshold; engines' reports include it, the counts of peak groups do not."""
    return scores.where(F.col("q_value") <= q if inclusive else F.col("q_value") < q)


def report_ids(report: DataFrame, q: float = 0.01) -> DataFrame:
    """Distinct (seq, charge) of a report at ``q``, columns found by alias; the charge is null where there is none."""
    from peakloom.operators.library import resolve

    names = {"q_value": Q_ALIASES, "seq": SEQUENCE_ALIASES, "charge": CHARGE_ALIASES}
    found = resolve(report, names, ("q_value", "seq"))
    if "charge" not in found.columns:
        found = found.withColumn("charge", F.lit(None).cast("int"))
    return at_threshold(found, q).select("seq", "charge").distinct()


def scored_features(score: DataFrame, feature: DataFrame, precursor: DataFrame) -> DataFrame:
    """Scores with their feature's precursor: (feature_id, q_value, precursor_id, charge, decoy)."""
    return score.join(feature, "feature_id").join(precursor, "precursor_id").select("feature_id", "q_value", "precursor_id", "charge", "decoy")


def identified_peptides(scored: DataFrame, mapping: DataFrame, peptide: DataFrame, q: float = 0.01) -> DataFrame:
    """Distinct (seq, charge) of targets at ``q`` (inclusive)."""
    ok = at_threshold(scored, q).where("decoy = 0")
    return ok.join(mapping, "precursor_id").join(peptide, "peptide_id").select(F.col("unmodified").alias("seq"), "charge").distinct()


def distinct_ids(scored: DataFrame, mapping: DataFrame, peptide: DataFrame, proteins: DataFrame | None = None, q: float = 0.01) -> DataFrame:
    """Distinct precursors, modified peptides and proteins of targets under ``q`` (strict); -1 proteins without that table."""
    ok = at_threshold(scored, q, inclusive=False).where("decoy = 0").select("precursor_id").distinct()
    found = mapping.join(ok, "precursor_id", "left_semi").select("peptide_id").distinct()
    counts = ok.agg(F.count(F.lit(1)).alias("n_precursors"))
    modified = peptide.join(found, "peptide_id", "left_semi").agg(F.count_distinct("modified").alias("n_peptides"))
    if proteins is None:
        return counts.crossJoin(F.broadcast(modified)).withColumn("n_proteins", F.lit(-1).cast("bigint"))
    n = proteins.join(found, "peptide_id", "left_semi").agg(F.count_distinct("protein_id").alias("n_proteins"))
    return counts.crossJoin(F.broadcast(modified)).crossJoin(F.broadcast(n))


def overlap(a: DataFrame, b: DataFrame, key: str = "seq") -> DataFrame:
    """Sizes of the intersection, the differences and the union of two sets, and their Jaccard index (null if both are empty)."""
    both = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full_outer")
    counts = both.agg(F.count_if(F.expr("a = 1 AND b = 1")).alias("n_both"), F.count_if(F.expr("b IS NULL")).alias("n_only_a"), F.count_if(F.expr("a IS NULL")).alias("n_only_b"), F.count(F.lit(1)).alias("n_union"))
    return counts.withColumn("jaccard", F.try_divide("n_both", "n_union"))


def shared_ids(a: DataFrame, b: DataFrame, key: str = "seq") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def only_ids(a: DataFrame, b: DataFrame, key: str = "seq") -> DataFrame:
    return a.select(key).subtract(b.select(key))


def length_histogram(ids: DataFrame) -> DataFrame:
    """Distinct sequences by length."""
    return ids.select("seq").distinct().groupBy(F.length("seq").alias("len")).agg(F.count(F.lit(1)).alias("n")).orderBy("len")


def charge_histogram(ids: DataFrame) -> DataFrame:
    """Rows by charge, those without one left out."""
    return ids.where("charge IS NOT NULL").groupBy("charge").agg(F.count(F.lit(1)).alias("n")).orderBy("charge")


def gate(counts: DataFrame, condition: str) -> None:
    """Stop the job unless the single row of ``counts`` meets a SQL condition."""
    if not counts.where(condition).take(1):
        raise RuntimeError(f"the gate is not met: {condition}")
