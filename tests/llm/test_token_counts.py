"""Prefix counts against the tokenizers library, prefix by prefix."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from peakloom.llm import tokencounts


@pytest.fixture(scope="module")
def library():
    model = Tokenizer.from_file(tokencounts.bpe_model())
    return lambda text: len(model.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def table():
    return tokencounts.PrefixTable(tokencounts.bpe_model())


def hold(table, library, texts, limit=5):
    n, fit, each = table.count(pa.array(texts, pa.string()), limit, True)
    for text, tokens, chars, counts in zip(texts, n.tolist(), fit.tolist(), each, strict=True):
        want = [library(text[:i]) for i in range(1, len(text) + 1)]
        assert counts.tolist() == want, text
        assert tokens == (want[-1] if want else 0)
        assert chars == max((i for i, x in enumerate(want, 1) if x <= limit), default=0)


def test_every_prefix(table, library):
    hold(table, library, ["", "a", "hello world", "  a   b\n\n c\t\td ", "don't we'll they've x're 'rest 'love '' 're", "日本語 テキスト é x 🙂🙂", " a", " \n", "x" * 300, "=" * 200])
    hold(table, library, ["a<|endoftext|>b <|endoftext|", "<|endoftext|><|endoftext|>", " \n<|endoftext|> x", "<|endoftext<|endoftext|>"])
    rng = random.Random(1)
    for letters in ("ab' \n", "'relvstmd \"", "a1! \t\r\n", "the cat sat on ings ", "日é 　 x🙂", "=-_  ", "aaaa ", "<|endoftext|> x"):
        hold(table, library, ["".join(rng.choice(letters) for _ in range(rng.randint(1, 24))) for _ in range(150)])


def test_tables_that_start_anew(table, library, monkeypatch):
    monkeypatch.setattr(tokencounts, "TABLE_CHARS", 50)
    hold(table, library, ["the cat sat on the mat", "one two three four five six seven eight nine ten"])
    hold(table, library, ["another text that fills the table again", "the cat sat"])


def test_other_models_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        tokencounts.PrefixTable(public_tokenizers.path("word_bpe_49k.json"))


def test_count_prefixes(spark, odd, empty, library):
    path = tokencounts.bpe_model()
    got = tokencounts.count_prefixes(odd, path, 512).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert len(got) == odd.count()
    for r in got:
        text = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], len(r["prefix_tokens"])) == (len(text.encode()), library(text), len(text))
        assert r["fit_chars"] == max((i for i, x in enumerate(r["prefix_tokens"], 1) if x <= 512), default=0)
    assert tokencounts.count_prefixes(empty, path).count() == 0


def test_questions_to_stored_counts(spark, docs, library):
    counted = tokencounts.count_prefixes(docs, tokencounts.bpe_model())
    some = counted.join(docs.select("doc_id", "text"), "doc_id").where("doc_id < 20").select("text", tokencounts.tokens_of_first(100).alias("a"), tokencounts.tokens_of_first(0).alias("b"), tokencounts.chars_within(40).alias("c"))
    for r in some.collect():
        assert (r["a"], r["b"]) == (library(r["text"][:100]), 0)
        assert library(r["text"][: r["c"]]) <= 40 and all(library(r["text"][:i]) > 40 for i in range(r["c"] + 1, min(r["c"] + 12, len(r["text"]) + 1)))
    cut = tokencounts.truncate(docs.where("doc_id < 50"), counted, 64)
    assert cut.columns == docs.columns and cut.count() == 50
    assert all(library(r["text"]) <= 64 for r in cut.collect())
    assert tokencounts.truncate(docs.where("doc_id = 3"), counted.where("doc_id <> 3"), 1).first()["text"] == docs.where("doc_id = 3").first()["text"]


def test_query(spark, library):
    from peakloom.llm.queries import queries

    got = queries()["op11_token_counts"](spark, "/root/testdata/sf0.001")
    assert got.dtypes[:4] == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()}
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = library(texts[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 512)
