"""The pipeline's stages, each against a brute-force version on its own input, and on awkward rows."""

import hashlib
from collections import Counter

import duckdb
import pytest
import sentencepiece

import corpus_pipeline
from peakloom.llm import langid, mixing, pieces
from peakloom.llm.queries import MIXING_SQL
from tests.llm.test_text_operators import base, slow_components, slow_fingerprint

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def key(r):
    return tuple(str(r[c]) for c in COLUMNS)


def test_stages(spark, docs):
    given = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, given, DATA).cache()
        before, after = given.collect(), out.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == COLUMNS
        if name == "language":
            model = langid.fit_on(given)
            want = Counter((r["doc_id"], p) for r in before for p, s in [model.predict(r["text"])] if p != "und" and s >= model.reject_below)
            assert Counter((r["doc_id"], r["lang"]) for r in after) == want
        elif name == "near_duplicates":
            groups = slow_components([(r["doc_id"], slow_fingerprint(r["text"])) for r in before])
            assert sorted(r["doc_id"] for r in after) == sorted({c for _, _, c in groups})
        elif name == "personal_data":
            text = {r["doc_id"]: r["text"] for r in after}
            assert len(after) == len(before)
            for r in before:
                spans = [x.split(":") for x in base(r["text"]).split(",") if x]
                if not spans:
                    assert text[r["doc_id"]] == r["text"]
                assert all(r["text"][int(a) : int(e)] not in text[r["doc_id"]] for _, a, e in spans)
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "mixing":
            assert Counter(map(key, before)) == Counter(map(key, after))
            order = {r["doc_id"]: r["mix_position"] for r in mixing.mix(given).collect()}
            assert [order[r["doc_id"]] for r in after] == sorted(order.values())
        else:
            model = sentencepiece.SentencePieceProcessor(model_file=pieces.piece_model())
            want = {r["doc_id"]: model.encode(r["text"]) for r in before}
            assert {r["doc_id"]: r["ids"] for r in after} == want
            assert all(r["decoded_sha256"] == hashlib.sha256(model.decode(want[r["doc_id"]]).encode()).hexdigest() for r in after)
        given = out
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()) == sorted(r["doc_id"] for r in given.collect())


def test_awkward_rows(spark, odd, empty):
    for df in (odd, empty):
        given = df
        for name, stage in corpus_pipeline.STAGES:
            given = stage(spark, given, DATA)
            if name == "language":
                given = df  # with one language only nothing is learned here; go on with all rows
            rows = given.collect()
        assert len(rows) <= df.count()


def test_language_stage_without_languages(spark, odd, empty):
    for df in (odd, empty):
        assert corpus_pipeline.language_stage(spark, df, DATA).collect() == []
    rows = langid.annotate(odd, langid.fit_on(odd)).collect()
    assert len(rows) == odd.count() and all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in rows)


def test_mixing_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    want = sorted(con.execute(MIXING_SQL).fetchall())
    got = mixing.op8_mixing(spark, DATA).select("doc_id", "source", "mix_block", "mix_slot", "mix_position").collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("name", ["op1_quality", "op2_toxicity", "op3_pii", "op4_simhash", "op5_sentencepiece", "op6_language", "op7_rules", "op9_media", "op10_substrings"])
def test_registered_columns(spark, name):
    import __spark_entry__ as entry

    columns = {
        "op1_quality": "doc_id held_out score predicted", "op2_toxicity": "doc_id held_out score predicted", "op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op4_simhash": "doc_id fingerprint component_id", "op5_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256", "op6_language": "doc_id held_out lang_pred score",
        "op7_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op9_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op10_substrings": "doc_id n_bytes n_removed n_spans kept_sha256",
    }
    got = entry.queries()[name](spark, DATA)
    assert set(columns[name].split()) <= set(got.columns) and got.count() == 200
