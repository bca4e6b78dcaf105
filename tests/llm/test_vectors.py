"""Hard negatives and vector codes against brute force and their SQL."""

import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.llm import codebooks, negatives
from peakloom.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int, rank string, score double, uid int, block int, key string"


def table(spark, rows):
    """With further columns whose names clash with results."""
    return spark.createDataFrame([(*r, "clash", 0.5, 1, 2, "clash") for r in rows], SCHEMA)


def awkward(n=260, width=8, seed=5):
    rng = random.Random(seed)
    centres = [[rng.uniform(-0.4, 0.4) for _ in range(width)] for _ in range(4)]
    rows = [(i * 3 - 60, [float(np.float32(c + rng.gauss(0, 0.1))) for c in centres[rng.randrange(4)]], rng.randrange(3)) for i in range(n)]
    rows += [(10_001, None, 1), (10_002, [0.1] * (width - 1) + [None], 1), (10_003, [float("nan")] * width, 1), (10_004, [float("inf")] * width, 0), (10_005, rows[1][1], None), (None, rows[2][1], 2)]
    rows += [(10_010, rows[4][1], rows[4][2])] * 3 + [(10_011, rows[4][1], 0), (10_012, [0.0] * width, 1), (10_013, [0.25] * (width // 2), 2), (10_020, [], 0)]
    return rows


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows, step):
    able = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and whole(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (anchor, v, label) in enumerate(able):
        if anchor % step:
            continue
        scores = sorted((-dot(v, w), i, y) for b, (i, w, y) in enumerate(able) if b != a)
        for s, positive, _ in [x for x in scores if x[2] == label][:5]:
            good = [(-t, i) for t, i, y in scores if y != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(anchor, positive, k, i, -s, t) for k, (t, i) in enumerate(good, 1)]
    return sorted(out)


def test_negatives(spark, monkeypatch):
    rows = awkward()
    want = brute_negatives(rows, 5)
    assert len(want) > 100
    got = negatives.mine(table(spark, rows), F.col("vec_id") % 5 == 0).collect()
    assert sorted(map(tuple, got)) == want
    monkeypatch.setattr(negatives, "ROWS", 37)
    monkeypatch.setattr(negatives, "ANCHORS", 11)
    monkeypatch.setattr(negatives, "SIDE", 2)
    got = negatives.mine(table(spark, rows), F.col("vec_id") % 5 == 0).collect()
    assert sorted(map(tuple, got)) == want


def test_negatives_of_few_and_large(spark):
    none = negatives.mine(table(spark, []), F.col("vec_id") % 5 == 0)
    assert none.count() == 0 and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert negatives.mine(table(spark, [(0, [1.0], 1)]), F.col("vec_id") == 0).count() == 0
    assert negatives.mine(table(spark, [(0, [], 1), (1, [], 1), (2, [], 0)]), F.col("vec_id") == 0).count() == 1
    rows = [(i, [1000.0 * (i % 7), -500.0 * i], i % 2) for i in range(40)]
    assert sorted(map(tuple, negatives.mine(table(spark, rows), F.col("vec_id") % 4 == 0).collect())) == brute_negatives(rows, 4)


def brute_codes(rows, parts, entries, rounds):
    able = [(i, y, [math.floor(256 * x) for x in v]) for i, v, y in rows if whole(v)]
    width = max(1, -(-max(len(v) for _, _, v in able) // parts))
    able = [(i, y, v + [0] * (parts * width - len(v))) for i, y, v in able]
    last = lambda x: (x is None, 0 if x is None else x)
    source = {id(r): v for r, (_, v, _) in zip(able, [r for r in rows if whole(r[1])], strict=True)}
    first = sorted(able, key=lambda r: (last(r[0]), last(r[1]), source[id(r)]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[cut(v, p) for _, _, v in first] for p in range(parts)]
    near = lambda v: [min(range(len(books[p])), key=lambda e: (gap(cut(v, p), books[p][e]), e)) for p in range(parts)]
    for _ in range(rounds):
        codes = [near(v) for _, _, v in able]
        for p in range(parts):
            of = defaultdict(list)
            for code, (_, _, v) in zip(codes, able, strict=True):
                of[code[p]].append(cut(v, p))
            for e, xs in of.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, y, near(v), sum(gap(cut(v, p), books[p][c]) for p, c in enumerate(near(v)))) for i, y, v in able], digest


@pytest.mark.parametrize(("n", "width", "parts", "entries", "rounds"), [(260, 8, 4, 8, 2), (200, 10, 4, 64, 3), (5, 8, 16, 64, 2)])
def test_codes(spark, n, width, parts, entries, rounds):
    rows = awkward(n, width) if n > 5 else awkward(8, width)[:6]
    want, digest = brute_codes(rows, parts, entries, rounds)
    got = codebooks.encode(table(spark, rows), parts=parts, entries=entries, rounds=rounds).collect()
    order = lambda r: str(r)
    assert sorted([(r["vec_id"], r["label"], r["code"], r["error"]) for r in got], key=order) == sorted(want, key=order)
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_codes_of_none_and_same(spark):
    assert codebooks.encode(table(spark, [])).count() == 0
    assert codebooks.encode(table(spark, [(1, None, 0)])).count() == 0
    got = codebooks.encode(table(spark, [(i, [0.5] * 16, None) for i in range(70)]), parts=4).collect()
    assert len(got) == 70 and all(r["code"] == [0] * 4 and r["error"] == 0 for r in got)
    assert codebooks.encode(table(spark, [(1, [], 0)]), parts=4).first()["code"] == [0] * 4


def test_pruned_assignments():
    """Bounds leave the assignment that of a full search, with ties, and spare most distances."""
    rng = np.random.default_rng(2)
    for spread, unit in ((2, 1), (60, 1), (60, 7), (4000, 1)):
        books = rng.integers(-spread, spread, (3, 16, 4))
        x = np.repeat(books.transpose(1, 0, 2), 40, axis=0) + rng.integers(-spread // 20 - 1, spread // 20 + 2, (640, 3, 4))
        bounds = codebooks.Bounds(spread * 2, 4)
        bounds.unit = max(bounds.unit, unit)
        at = codebooks.nearest(x, books, bounds)
        measured = 0
        for _ in range(3):
            new = books + rng.integers(-spread // 50 - 1, spread // 50 + 2, books.shape)
            *at, n = codebooks.moved(*at, x, books, new, bounds)
            books, measured = new, measured + n
            d = codebooks.squared(x, books)
            assert (at[0] == d.argmin(axis=2)).all()
            assert (at[1] >= bounds.upper(d.min(axis=2))).all() and (at[2] <= bounds.lower(d)).all()
        assert spread == 2 or measured < 3 * d.size / 2


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_vector_codes"])
def test_queries(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{DATA}/embeddings.parquet')")
    got = queries()[name](spark, DATA)
    want = con.execute(oracle_sql()[name]).df()
    assert got.columns == list(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.itertuples(index=False, name=None))


def test_label_errors_with_nulls(spark, tmp_path):
    rows = [(i, [float(i % 5) / 9] * 16, None if i % 3 == 0 else i % 4) for i in range(90)]
    table(spark, rows).select("vec_id", "embedding", "label").write.parquet(str(tmp_path / "embeddings.parquet"))
    labels = {i: y for i, _, y in rows}
    got = queries()["op13_vector_codes"](spark, str(tmp_path)).collect()
    sums = defaultdict(int)
    for r in got:
        sums[labels[r["vec_id"]]] += r["error"]
    assert len(got) == 90 and all(r["label_error"] == sums[labels[r["vec_id"]]] for r in got)
