"""FASTA and tab-separated sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PRECURSOR_SCHEMA = ("PeptideSequence", "PrecursorCharge")


def numbered(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """Dense numbers in file order: rows are numbered within their input partition and offset by the partitions before."""
    at = df.withColumn("__m", F.monotonically_increasing_id()).withColumn("__p", F.spark_partition_id())
    sizes = at.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__m0"))
    before = sizes.select("__p", "__m0", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__b"))
    # A row for each input partition.
    return at.join(F.broadcast(before), "__p").withColumn(name, F.col("__b") + F.col("__m") - F.col("__m0")).drop("__m", "__p", "__m0", "__b")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, protein, sequence) by record: the id is the header's first word; lines are stripped and joined as they are.
    Records without residues are dropped; text in front of the first header is a record without id."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    value = F.regexp_replace("value", r"\r", "")
    whole = F.when(F.col("__first") & ~value.startswith(">"), F.concat(F.lit("\n"), value)).otherwise(F.regexp_replace(value, "^>", ""))
    records = numbered(raw, "__o").withColumn("__first", F.col("__o") == 0).select("__o", whole.alias("r"))
    head = F.regexp_extract("r", r"^([^\n]*)", 1)
    body = F.array_join(F.transform(F.split(F.regexp_extract("r", r"(?s)^[^\n]*\n(.*)$", 1), "\n"), lambda x: F.trim(x)), "")
    named = records.select("__o", F.regexp_extract(head, r"^(\S*)", 1).alias("protein"), body.alias("sequence")).where("sequence <> ''")
    return named.select(F.col("__o").alias("ordinal"), "protein", "sequence")


def read_peptides(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, peptide, charge) of a tab-separated list with a header. Columns are found by name and others ignored;
    blank lines are skipped; a row without a whole charge of 1 or more or with a sequence that is not canonical stops the
    job with its line."""
    table = spark.read.csv(path, sep="\t", header=True, quote="")
    if missing := [c for c in PRECURSOR_SCHEMA if c not in table.columns]:
        raise ValueError(f"no column {', '.join(missing)} in {path}; it has {', '.join(table.columns)}")
    rows = numbered(table).select("ordinal", F.col("PeptideSequence").alias("peptide"), F.col("PrecursorCharge").alias("c"))
    charge = F.when(F.col("c").rlike(r"^\s*[+-]?[0-9]+$"), F.trim("c").cast("int"))
    bad = charge.isNull() | (charge < 1) | F.col("peptide").isNull() | ~F.col("peptide").rlike("^[ACDEFGHIKLMNPQRSTVWY]{2,}$")
    message = F.concat(F.lit(f"{path}:"), (F.col("ordinal") + 2).cast("string"), F.lit(": bad precursor "), F.coalesce("peptide", F.lit("")), F.lit(" "), F.coalesce("c", F.lit("")))
    return rows.select("ordinal", F.when(bad, F.raise_error(message).cast("string")).otherwise(F.col("peptide")).alias("peptide"), charge.alias("charge"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by suffix, else tab-separated text with a header; text rows get their ``input_order``."""
    if path.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    return numbered(spark.read.csv(path, sep="\t", header=True, inferSchema=True), "input_order")
