import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 997} and{i % 31}" for i in range(9000))
#: Null, empty, blank, wordless, repeated, long and odd texts, ties, and a null id.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "#*$ 123"), (5, "one two three four five"), (5, "one two three four five"), (6, "one two three four five"), (7, LONG),
    (8, "ÄÖ ß é 日本 🙂\nline\nline\nline"), (9, "▁▁ a  b ▁c \r\n"), (10, "mail a@b.co now 1.2.3.4 call +1 (017) 555-7713 card 4111 1111 1111 1111"), (None, "no id here at all, truly"), (12, "x" * 5000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward rows, with further columns whose names clash with results."""
    rows = [(i, t, None, None if i == 1 else f"s{(i or 0) % 3}", len(t or "")) for i, t in ODD]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumn("score", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("spans", F.lit("clash")).withColumn("fp", F.lit(0.5)).withColumn("words", F.lit(2))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
