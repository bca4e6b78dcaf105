"""Competition against a slow reading: blocks in one task, crowded blocks in pieces, crowds at one place or one score."""

import math
import random
import time

import numpy as np
import pytest

from peakloom.operators import competition, rescore

SCHEMA = "feature_id bigint, mz double, rt double, score double, decoy int, more string"


def slow(rows, tol):
    found = {}
    for i, (f, mz, rt, s, *_) in enumerate(rows):
        near = [r[3] for j, r in enumerate(rows) if j != i and math.floor(r[1] / 24) == math.floor(mz / 24) and rt - tol <= r[2] <= rt + tol]
        found[f] = (s - max(near) if near else 0.0, math.log((abs(s) + 1e-6) / (abs(sum(near) + s) + 1e-6)), sum(x > s for x in near) / len(near) if near else 0.0, math.log1p(len(near)))
    return found


def crowd(n):
    rng = random.Random(8)
    places = [lambda: rng.uniform(0, 400), lambda: 120.0, lambda: float(rng.randint(0, 30)) * 15]
    scores = [lambda: rng.random(), lambda: 0.5, lambda: float(rng.randint(0, 5))]
    return [(i, 500.0 + 24 * rng.choice((0, 0, 0, 1)), rng.choice(places)(), rng.choice(scores)(), i % 2, "x") for i in range(n)]


def test_helpers():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 64, 65):
        s = rng.integers(0, 9, n).astype(float)
        low = rng.integers(0, n + 1, 200)
        high = np.minimum(low + rng.integers(0, n + 1, 200), n)
        own = rng.integers(-1, 10, 200).astype(float)
        assert competition.better_in(s, low, high, own).tolist() == [int((s[a:b] > x).sum()) for a, b, x in zip(low, high, own)]
        assert competition.highest_in(s, low, high).tolist() == [max(s[a:b], default=-math.inf) for a, b in zip(low, high)]


@pytest.mark.parametrize("most", [13, 60, 10_000])
def test_crowded_blocks(spark, most):
    rows = crowd(500)
    got = rescore.competitive_features(spark.createDataFrame(rows, SCHEMA), keep=("more",), blocks_of=8.0, most=most).collect()
    want = slow(rows, 15.0)
    assert len(got) == len(want) and {r["more"] for r in got} == {"x"}
    for r in got:
        assert tuple(r[c] for c in rescore.FEATURE_COLUMNS) == pytest.approx(want[r["feature_id"]], abs=1e-9)


def test_repeats_and_nulls(spark):
    rows = [(1, 500.0, 1.0, 0.5, 0, "a")] * 2 + [(None, 500.0, 1.0, 0.7, 0, None), (2, None, 1.0, 0.9, 0, "a"), (3, 500.0, None, 0.9, 0, "a"), (4, 500.0, 1.0, float("nan"), 0, "a")]
    got = sorted(rescore.competitive_features(spark.createDataFrame(rows, SCHEMA)).collect(), key=str)
    full = [r for r in got if r["n_compet"] is not None]
    assert len(got) == 6 and [r["feature_id"] for r in full] == [1, 1, None]
    assert full[0]["best_delta"] == pytest.approx(-0.2) and full[0]["rival_rank"] == 0.5 and full[2]["best_delta"] == pytest.approx(0.2)


def test_a_hundred_thousand_at_one_locus(spark):
    df = spark.range(100_000).selectExpr("id AS feature_id", "500D AS mz", "(id % 1000) / 100D AS rt", "pmod(hash(id), 100000) / 1e5 AS score", "0 AS decoy")
    begin = time.time()
    row = rescore.competitive_features(df).selectExpr("min(n_compet)", "max(n_compet)", "min(rival_rank)", "count(*)").first()
    assert row[0] == row[1] == pytest.approx(math.log(100_000)) and row[2] == 0 and row[3] == 100_000
    assert time.time() - begin < 60
