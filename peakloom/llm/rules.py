"""Line-first cleaning with quality rules, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.common import documents, let

#: A line made of one of these has no sentence of its own.
NAVIGATION = (
    r"(?i)^\W*+(home|menu|search|log ?in|log ?out|sign ?(in|up)|register|next|previous|back|share|subscribe|sitemap|contact( us)?"
    r"|about( us)?|skip to content|read more|click here|cart|checkout|print|download|english|deutsch|español|français)"
    r"(?:\W++(home|menu|search|log ?in|log ?out|sign ?(in|up)|register|next|previous|back|share|subscribe|sitemap|contact|about"
    r"|us|more|here|cart|checkout|print|download|english|deutsch|español|français))*+\W*+$"
)
#: What a text must hold, in lower case, for a line of boilerplate: plain searches, after which most texts are done.
BOILERPLATE_HINT = (
    "all rights reserved", "copyright", "terms of", "terms and conditions", "privacy policy", "cookie", "powered by", "licensed", "lorem ipsum",
    "enable javascript", "unsubscribe", "alle rechte vorbehalten", "todos los derechos reservados", "tous droits r",
)
BOILERPLATE = (
    r"(?iu)(all rights reserved|copyright (©|\(c\)|\d{4})|terms (of (use|service)|and conditions)|privacy policy|cookie(s| policy)"
    r"|powered by|licensed under|this work is licensed|lorem ipsum|enable javascript|unsubscribe|alle rechte vorbehalten"
    r"|todos los derechos reservados|tous droits réservés)"
)
#: An end of a sentence, with what may close it.
END = r"[.!?\x{2026}:;\x{3002}\x{FF01}\x{FF1F}][\x22\x27)\]\x{BB}\x{201C}\x{201D}\x{2019}]*$"
BULLET = r"^[\x20\x09]*(?:[-*+\x{2022}\x{25CF}\x{25AA}\x{2023}\x{2013}\x{00B7}]|[0-9]{1,3}[.)])[\x20\x09]"
#: Fewer words than this make no sentence without an end.
SCRAP = r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){1,4}$"
WINDOW = 5


def words_of(text: Column) -> Column:
    """Runs free of ASCII white space."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def line_fails(line: Column, hinted: Column) -> Column:
    """Whether a line with a word is removed, whatever its length.

    Punctuation: it is cut off by three dots, or has no end of a sentence and begins as a list's item or has fewer than
    five words. Navigation: it has nothing but menu words, or three bars. Boilerplate: it has a legal or technical
    phrase (asked only where the text is ``hinted``). And lines that are hardly letters, mostly symbols, or all capitals.
    """

    def judged(trimmed: Column) -> Column:
        packed = F.regexp_replace(line, r"[\x20\x09-\x0D]+", "")
        return let(
            F.struct(packed.alias("p"), trimmed.rlike(END).alias("ended")),
            lambda x: (~x["ended"] & (trimmed.rlike(SCRAP) | line.rlike(BULLET)))
            | trimmed.endswith("...")
            | trimmed.endswith("\u2026")
            | (hinted & line.rlike(BOILERPLATE))
            | (2 * F.length(F.regexp_replace(x["p"], r"[^\p{L}]+", "")) < F.length(x["p"]))
            | (8 * F.length(F.regexp_replace(x["p"], r"[^#*$%&|<>{}\[\]=\\^~_!]+", "")) > F.length(x["p"]))
            | x["p"].rlike(r"\|[^|]*+\|[^|]*+\|")
            | ((F.length(x["p"]) > 3) & ~x["p"].rlike(r"\p{Ll}") & x["p"].rlike(r"\p{Lu}"))
            | line.rlike(NAVIGATION),
        )

    return let(F.regexp_replace(line, r"[\x20\x09-\x0D]++$", ""), judged)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: float = 0.5, few_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """One row for each document: the counts below, ``cleaned`` (the text without removed lines), ``lost`` (share of the
    characters in words that went with them), ``base_failed`` and ``kept``.

    Lines are split at \\n. A line with a word is removed if ``line_fails`` says so or an earlier line equals it. A
    document is kept unless ``base_failed`` (fewer than ``few_words`` words, or over ``repeat_percent`` in a hundred of
    them in a 5-word window found twice or more) or more than ``most_lost`` of it was removed. Null texts have no word
    and fail. Everything is counted within the row, without a shuffle, on whole texts; a null id, repeated rows and an
    empty table are taken as they are, and other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(id_col, text.alias("text"))
    base = base.withColumn("words", words_of(F.col("text"))).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    window = F.transform(starts, lambda i: F.xxhash64(*(F.get(F.col("hashes"), i + k) for k in range(WINDOW))))
    base = base.withColumn("windows", window)
    # Most texts repeat no window; only the others are sorted.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    base = base.withColumn(
        "sorted",
        F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    base = base.withColumn(
        "starts",
        F.array_sort(
            F.transform(
                F.filter(
                    F.transform("sorted", lambda x, j: F.struct(x["i"].alias("i"), ((x["h"] == F.get(F.col("sorted"), j - 1)["h"]) | (x["h"] == F.get(F.col("sorted"), j + 1)["h"])).alias("again"))),
                    lambda x: F.coalesce(x["again"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.transform("starts", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("starts"), j + 1) - p, F.lit(WINDOW))))
    base = base.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x))
    base = base.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    base = base.withColumn("distinct_lines", F.array_distinct("lines"))
    low = F.lower("text")
    base = base.withColumn("hinted", reduce(lambda a, b: a | b, (low.contains(p) for p in BOILERPLATE_HINT)))
    base = base.withColumn("good_lines", F.filter("distinct_lines", lambda x: ~line_fails(x, F.col("hinted"))))
    chars = lambda c: F.length(F.regexp_replace(c, r"[\x20\x09-\x0D]+", "")).cast("bigint")
    joined = F.array_join("good_lines", "\n")
    found = base.select(
        id_col,
        n.cast("bigint").alias("n_words"),
        chars(F.col("text")).alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size("distinct_lines")).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        joined.alias("cleaned"),
        chars(joined).alias("good_chars"),
    )
    lost = F.when(F.col("word_chars") > 0, 1 - F.col("good_chars") / F.col("word_chars")).otherwise(F.lit(1.0))
    failed = (F.col("n_words") < few_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return found.withColumn("lost", lost).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("lost") <= most_lost)).drop("good_chars")


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(documents(spark, sf_dir)).drop("cleaned")
