"""Calibration against planted drifts, sensitivity against counting, and the stored index."""

import random
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators import calibrate, index, sensitivity


def brute_isotonic(v, w):
    """The min-max formula."""
    mean = lambda a, b: sum(x * y for x, y in zip(v[a : b + 1], w[a : b + 1], strict=True)) / sum(w[a : b + 1])
    return [max(min(mean(a, b) for b in range(i, len(v))) for a in range(i + 1)) for i in range(len(v))]


def test_monotone():
    rng = random.Random(3)
    for _ in range(60):
        v, w = zip(*[(float(rng.randrange(9)), float(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))], strict=True)
        assert calibrate.monotone(list(v), list(w)) == pytest.approx(brute_isotonic(v, w))
    assert calibrate.monotone([], []) == []


def test_alignment(spark):
    rng = random.Random(4)
    truth = lambda x: 300 + 18 * x + 4 * x**2 / 30
    rows = [(x, truth(x) + rng.gauss(0, 3)) for x in (rng.uniform(-20, 90) for _ in range(3000))] + [(rng.uniform(-20, 90), rng.uniform(0, 4000)) for _ in range(200)]
    rows += [(None, 1.0), (float("nan"), 1.0), (1.0, float("inf")), (2.0, None)]
    found = calibrate.align(spark.createDataFrame(rows, "predicted double, observed double"), 2.0)
    assert list(found.y) == sorted(found.y) and list(found.x) == sorted(found.x)
    asked = [x / 7 - 30 for x in range(900)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in asked], "x double").coalesce(1).select(found.observed(F.col("x"))).collect()]
    slope = [(found.y[1] - found.y[0]) / (found.x[1] - found.x[0]), (found.y[-1] - found.y[-2]) / (found.x[-1] - found.x[-2])]
    plain = lambda x: found.y[0] + slope[0] * (x - found.x[0]) if x < found.x[0] else found.y[-1] + slope[1] * (x - found.x[-1]) if x > found.x[-1] else float(np.interp(x, found.x, found.y))
    assert got == pytest.approx([plain(x) for x in asked], abs=1e-6)
    assert np.median([abs(g - truth(x)) for g, x in zip(got, asked, strict=True) if -18 < x < 88]) < 4
    none = calibrate.align(spark.createDataFrame([], "predicted double, observed double"), 2.0)
    assert spark.range(1).select(none.observed(F.lit(5.0))).first()[0] == 5.0
    with pytest.raises(ValueError, match="larger width"):
        calibrate.align(spark.range(10_002).select(F.col("id").cast("double").alias("predicted"), F.lit(1.0).alias("observed")), 1.0)


def test_mass_drift(spark):
    rng = random.Random(5)
    rows = []
    for i in range(4000):
        rt, mz = rng.uniform(0, 3600), rng.uniform(200, 1800)
        error = rng.uniform(-60, 60) if i % 6 == 0 else 4 - 0.001 * rt + 0.003 * mz + rng.gauss(0, 0.5)
        rows.append((mz * (1 + error * 1e-6), mz, rt))
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0), (1.0, 0.0, 1.0)], "mz double, theoretical_mz double, rt double")
    drift = calibrate.mass_drift(df)
    assert (drift.offset, drift.by_rt, drift.by_mz) == pytest.approx((4, -0.001, 0.003), abs=0.1)
    assert abs(drift.by_rt + 0.001) < 5e-5 and abs(drift.by_mz - 0.003) < 1e-4 and 0.4 < drift.deviation < 0.75
    clean = df.where("mz IS NOT NULL AND theoretical_mz > 0").select("*", drift.corrected(F.col("mz"), F.col("rt")).alias("c"))
    off = [abs(r["c"] - r["theoretical_mz"]) / r["theoretical_mz"] * 1e6 for r in clean.collect()]
    assert sum(x <= drift.width() / 2 for x in off) > 0.82 * len(off)
    assert calibrate.mass_drift(df.limit(0)) == calibrate.Drift(0.0, 0.0, 0.0, 0.0)
    peaks = df.where("mz IS NOT NULL").select(F.monotonically_increasing_id().alias("scan_index"), "rt", F.lit(500.0).alias("win_mz"), drift.corrected(F.col("mz"), F.col("rt")).alias("mz"), F.lit(1.0).alias("intensity"))
    asked = spark.createDataFrame([(i, 50000, m) for i, (_, m, _) in enumerate(rows[:300])], "id int, win_key bigint, product_mz double")
    assert index.gather(asked, peaks, drift.width()).select("id").distinct().count() > 240


def test_curves(spark):
    rng = random.Random(6)
    fragments = [(c, f, 1, 0, 10 * (f + 1)) for c in range(60) for f in range(6)]
    kept = {(1, 0, 10 * (f + 1) + d) for f in range(6) for d in (rng.choice((-1, 0, 1, 3)),)}
    moved = [(c, f, 1 if c % 4 else 2, b, x) for c, f, _, b, x in fragments]
    hits = Counter({c: 0 for c in range(60)})
    for c, _, w, b, x in moved:
        hits[c] += any((w, b, x + d) in kept for d in (-1, 0, 1))
    strata = [(c, c % 3, None if c % 5 == 0 else "m") for c in range(60)]
    of = sensitivity.hit_counts(spark.createDataFrame(moved, "candidate int, fragment int, win_key int, block int, bin int"), spark.createDataFrame(list(kept), "win_key int, block int, bin int"))
    assert {r["candidate"]: r["hits"] for r in of.collect()} == dict(hits)
    got = {(r["stratum"], r["level"], r["k"]): r for r in sensitivity.curves(spark.createDataFrame(strata, "candidate int, charge int, mods string"), of, ("charge", "mods"), 0.3).collect()}
    assert len(got) == 6 * (1 + 3 + 2)
    for (stratum, level, k), r in got.items():
        mine = [c for c, z, m in strata if stratum == "all" or (str(z) if stratum == "charge" else m) == level]
        assert (r["n"], r["passed"]) == (len(mine), sum(hits[c] >= k for c in mine))
        assert r["expected"] == pytest.approx(sum(comb(6, i) * 0.3**i * 0.7 ** (6 - i) for i in range(k, 7)))


def test_stored_index(spark, tmp_path):
    rng = random.Random(7)
    at = spark.createDataFrame([(rng.randrange(8), rng.randrange(5), rng.randrange(50), 1.0) for _ in range(2000)], "win_key bigint, block int, bin int, intensity float")
    path = str(tmp_path / "index")
    index.store_index(at, path)
    asked = spark.createDataFrame([(c, f, 2 + c % 2, c % 5, (7 * f + c) % 60) for c in range(30) for f in range(4)], "candidate int, fragment int, win_key bigint, block int, bin bigint")
    want = index.prefilter(asked, at.select("win_key", "block", F.col("bin").cast("bigint").alias("bin")).distinct(), 2)
    got = index.prefilter_stored(asked, path, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    pruned = index.stored_index(spark, path, asked)
    assert {f.split("win_key=")[1].split("/")[0] for f in pruned.inputFiles()} >= {"2", "3"}
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "win_key" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # Windows that nothing asks for are not even opened: without them the answer is the same.
    import shutil

    for w in range(8):
        if w not in (2, 3):
            for f in (tmp_path / "index" / f"win_key={w}").glob("*.parquet"):
                f.write_bytes(b"unreadable")
    assert sorted(map(tuple, index.prefilter_stored(asked, path, 2).collect())) == sorted(map(tuple, want.collect()))
    assert index.prefilter_stored(asked.limit(0), path, 2).count() == 0
    shutil.rmtree(path)
