"""Semi-supervised scoring against a plain numpy version, and on planted peak groups."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators import discriminant as dm
from peakloom.operators import quantiles, rescore

SCORES = ("s1", "s2", "s3", "s4")
SCHEMA = "precursor_id bigint, group_id bigint, decoy int, " + ", ".join(f"{c} double" for c in SCORES)


def planted(n=600, seed=1, gaps=True):
    """Precursors of three peak groups; half of the targets are there, in their second group."""
    rng, rows = random.Random(seed), []
    for p in range(n):
        decoy = p % 2
        for g in range(3):
            real = not decoy and p % 4 == 0 and g == 1
            x = [rng.gauss(2.6 * real, 1), rng.gauss(2.0 * real, 1), rng.gauss(2.0 * real, 2), rng.gauss(0, 1)]
            x[3] += x[0] * 0.7
            rows.append((p, p * 3 + g, decoy, *(None if gaps and rng.random() < 0.02 else v for v in x)))
    return rows


def brute(rows, fold, options):
    """Weights by fold, from the definition."""
    x = np.array([[np.nan if v is None else v for v in r[3:]] for r in rows])
    z = np.nan_to_num((x - np.nanmean(x, axis=0)) / np.nanstd(x, axis=0))
    out = []
    for f in range(options.folds):
        at = [i for i, r in enumerate(rows) if fold[r[0]] != f]
        w = np.r_[1.0, np.zeros(len(SCORES))]
        for r in range(options.rounds):
            best = {}
            for i in at:
                key = (-(z[i] @ w[:-1] + w[-1]), rows[i][1])
                if rows[i][0] not in best or key < best[rows[i][0]][0]:
                    best[rows[i][0]] = key, i
            chosen = sorted((k[0], i) for k, i in best.values())
            decoys, keep = 0, 0
            for n, (_, i) in enumerate(chosen, 1):
                decoys += rows[i][2]
                if decoys <= (options.fdr if r else options.first_fdr) * (n - decoys):
                    keep = n
            bad, good = z[[i for _, i in chosen if rows[i][2]]], z[[i for _, i in chosen[:keep] if not rows[i][2]]]
            if min(len(bad), len(good)) < len(SCORES) + 2:
                continue
            pooled = ((len(bad) - 1) * np.cov(bad.T) + (len(good) - 1) * np.cov(good.T)) / (len(bad) + len(good) - 2)
            v = np.linalg.solve(pooled + options.ridge * np.trace(pooled) / len(pooled) * np.eye(len(pooled)), good.mean(axis=0) - bad.mean(axis=0))
            w = np.r_[v, -v @ bad.mean(axis=0)] / np.sqrt(v @ np.cov(bad.T) @ v)
        out.append(w)
    return np.array(out), z


def test_weights_and_scores(spark):
    rows, options = planted(), dm.Learning(rounds=3)
    df = spark.createDataFrame(rows, SCHEMA)
    fold = {r[0]: r[1] for r in df.select("precursor_id", dm.fold_of("precursor_id", 3)).distinct().collect()}
    model = dm.learn(df, SCORES, "s1", options=options)
    want, z = brute(rows, fold, options)
    assert model.weights == pytest.approx(want, rel=1e-6, abs=1e-8)
    got = {r["group_id"]: r["d_score"] for r in dm.score(df, model).collect()}
    assert [got[r[1]] for r in rows] == pytest.approx([float(v @ want[fold[r[0]]][:-1] + want[fold[r[0]]][-1]) for r, v in zip(rows, z, strict=True)], rel=1e-6, abs=1e-8)


def test_more_is_found_than_by_one_score(spark):
    rows = planted(3000, gaps=False)
    df = spark.createDataFrame(rows, SCHEMA)
    found = dm.score_groups(df, SCORES, "s1").collect()
    assert len(found) == 3000 and {r["unit"] for r in found} == {"peak group"}
    ok = [r for r in found if not r["decoy"] and r["q_value"] <= 0.05]
    true = [r for r in ok if r["precursor_id"] % 4 == 0 and r["group_id"] % 3 == 1]
    alone = dm.score_groups(df, ("s1",), "s1", options=dm.Learning(rounds=0)).where("decoy = 0 AND q_value <= 0.05").count()
    assert len(true) > 0.85 * len(ok) and len(ok) > 1.5 * alone


def test_awkward_groups(spark):
    assert dm.score_groups(spark.createDataFrame([], SCHEMA), SCORES, "s1").count() == 0
    same = [(p, p * 2 + g, p % 2, 1.0, None, float("nan"), 2.0) for p in range(20) for g in range(2)] + [(99, 990, None, 1.0, 1.0, 1.0, 1.0), (0, 0, 0, 1.0, None, None, 2.0)]
    got = dm.score_groups(spark.createDataFrame(same, SCHEMA).withColumn("x", F.lit("clash")).withColumn("set", F.lit(1)), SCORES, "s1").collect()
    assert sorted((r["precursor_id"], r["group_id"]) for r in got) == [(p, p * 2) for p in range(20)]
    with pytest.raises(ValueError, match="none of"):
        dm.learn(spark.createDataFrame(same, SCHEMA), SCORES, "s9")


def test_sums_at_or_better(spark):
    rng = random.Random(4)
    rows = [(g, float(rng.randrange(40)) if rng.random() < 0.95 else None, rng.randrange(3)) for g in (0, 1, 1, 1) for _ in range(200)]
    want = defaultdict(lambda: [0, 0])
    for g, v, _ in rows:
        if v is not None:
            want[g, v] = [sum(n for h, u, n in rows if h == g and u is not None and u >= v), sum(h == g and u is not None and u >= v for h, u, _ in rows)]
    for ranges in (1, 2, 8):
        got = quantiles.at_or_better(spark.createDataFrame(rows, "g int, v double, n int"), ["g"], "v", {"n": F.col("n"), "rows": F.lit(1)}, ranges).collect()
        assert {(r["g"], r["value"]): [r["n"], r["rows"]] for r in got} == dict(want)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_qvalues_grow_with_the_rows(spark):
    """No frame reaches to the end of its rows, as such a one is gone through anew for each; values against a plain version."""
    rng = random.Random(8)
    rows = [(i, rng.random() if i % 5 else round(rng.random(), 2), i % 2) for i in range(3000)] + [(9999, None, 0)]
    got = rescore.target_decoy_qvalues(spark.createDataFrame(rows, "id int, score double, decoy int"), ranges=7)
    assert "unboundedpreceding" in plan(got).lower() and "unboundedfollowing" not in plan(got).lower()
    fdr, want, least = {}, {}, float("inf")
    for s in {r[1] for r in rows} - {None}:
        d, t = (sum(r[2] == x and r[1] is not None and r[1] >= s for r in rows) for x in (1, 0))
        fdr[s] = d / t if t else None
    for s in sorted(fdr):
        least = min(least, float("inf") if fdr[s] is None else fdr[s])
        want[s] = least
    assert all((r["fdr"], r["q_value"]) == ((fdr[r["score"]], want[r["score"]]) if r["score"] is not None else (None, None)) for r in got.collect())


def test_places_among_cuts(spark):
    cuts = sorted([1.0, 1.0, 2.5, 4.0, 4.0, 4.0, 9.0] + [10.0 + i for i in range(30)])
    df = spark.range(100).select((F.col("id") / 2).alias("v"))
    for n in (0, 1, 2, 7, 8, 37):
        some = F.array(*map(F.lit, cuts[:n]))
        assert {r[0]: r[1] for r in df.select("v", quantiles.below(some, F.col("v"), n)).collect()} == {v / 2: sum(c < v / 2 for c in cuts[:n]) for v in range(100)}


def test_least_passing_value(spark):
    """Rates that pass, fail and pass again going down, ties, a group in which none passes."""
    rng, rows = random.Random(6), [(2, float(i), 1) for i in range(20)] + [(1, None, 0)]
    for g in (0, 1):
        rows += [(g, float(rng.randrange(300)) / 4, int(rng.random() < (0.02 if v % 97 < 60 else 0.3))) for v in range(700)]
    for rate in (0.0, 0.08, 0.15, 2.0):
        want = {}
        for g in (0, 1, 2):
            of = [(v, b) for h, v, b in rows if h == g and v is not None]
            ok = [v for v in {v for v, _ in of} if sum(b for u, b in of if u >= v) <= rate * sum(1 - b for u, b in of if u >= v)]
            want |= {g: min(ok)} if ok else {}
        for ranges in (1, 3, 40):
            got = quantiles.least_passing(spark.createDataFrame(rows, "g int, v double, b int"), ["g"], "v", F.col("b"), 1 - F.col("b"), rate, ranges).collect()
            assert {r["g"]: r["least"] for r in got} == want, (rate, ranges)


def test_crowded_precursors(spark, monkeypatch):
    """Precursors in many rows and pieces give what whole ones give, by ids that are text; whole ones are not shuffled in a round."""
    rows = [*planted(200), *((p, 10_000 + p * 40 + g, p % 2, 0.1 * g, None, g % 3 - 1.0, float(g == 20)) for p in (0, 1, 7) for g in range(30))]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("group_id", F.format_string("g%06d", "group_id"))
    weights = np.arange(15).reshape(3, 5) / 7 - 1
    order = lambda found: sorted(map(str, found.collect()))
    whole = dm._training(df, SCORES, "precursor_id", "group_id", "decoy", 3)
    want = {own: order(dm._bests(whole, weights, own)) for own in (False, True)}
    assert not whole.crowded and "Exchange" not in plan(dm._bests(whole, weights)) and len(want[True]) == 200 and len(want[False]) == 400
    monkeypatch.setattr(dm, "MOST_GROUPS", 2)
    monkeypatch.setattr(dm, "MOST_DEALT", 8)
    cut = dm._training(df, SCORES, "precursor_id", "group_id", "decoy", 3)
    assert cut.crowded and cut.rows.agg(F.max(F.size("groups"))).first()[0] == 2
    assert {own: order(dm._bests(cut, weights, own)) for own in (False, True)} == want
