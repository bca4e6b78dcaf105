"""A corpus pipeline in five stages: language, near-duplicates, personal data, mixing, pieces.

Each stage takes the documents that the one before kept and returns a DataFrame; ``run`` writes each as Parquet in the
shared folder and reads it again, so that a lost executor costs at most a stage. All stages but the last return the
columns of ``documents``. Null and empty texts have no language and are rejected by the first stage; repeated rows are
near-duplicates of each other; an empty table passes through every stage; other columns are carried along unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm import langid, mixing, pieces, pii, simhash
from peakloom.plans.durable import durable_table, scratch


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language the model knows, with that language as ``lang``; rejected ones go."""
    found = langid.annotate(docs, langid.fit_on(docs))
    return found.where(~F.col("rejected")).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least ``doc_id``, by the fingerprints and the
    distance of ``op4_simhash``."""
    return simhash.one_of_each_group(docs, words=4)


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by the kind in brackets; ``n_chars`` follows the text."""
    clean = pii.redact(docs, pii.fit_on(docs))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: the files, read by name, interleave the sources at their weights."""
    mixed = mixing.mix(docs)
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids, and the digest of what they decode to."""
    return pieces.encode_decode(docs, pieces.piece_model())


STAGES = [
    ("language", language_stage),
    ("near_duplicates", duplicate_stage),
    ("personal_data", private_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: Learned models, fingerprints and the tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage writes on its way goes when its result is kept
            docs = durable_table(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
