"""Peak groups and their scores against plain numpy versions."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators import extract, index


def brute_smooth(x):
    w = {0: 6.0, 1: 4.0, 2: 1.0}
    near = lambda i: [(x[i + d], w[abs(d)]) for d in range(-2, 3) if 0 <= i + d < len(x)]
    return [sum(v * k for v, k in near(i)) / sum(k for _, k in near(i)) for i in range(len(x))]


def brute_peaks(s):
    """From the definition: between valleys (the last of equal low points), the first highest point."""
    cuts, falling = [0], False
    for i in range(1, len(s)):
        if falling and s[i] > s[i - 1]:
            cuts.append(i - 1)
            falling = False
        elif s[i] < s[i - 1]:
            falling = True
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(s) - 1], strict=True):
        # A valley belongs to the peaks on both sides, but is the apex of the second only.
        apex = max(range(a + (a > 0), b + 1), key=lambda i: (s[i], -i)) if b > a or not a else a
        if s[apex] > 0:
            out.append((a, apex, b, s[apex]))
    return out


def brute_scores(points, traces, library, delay):
    s = brute_smooth(np.sum(traces, axis=0).tolist())
    rows = []
    for k, (a, apex, b, h) in enumerate(sorted(brute_peaks(s), key=lambda p: (-p[3], p[1]))):
        inside = [i for i in range(a, b + 1) if s[i] >= 0.05 * h]
        a, b = inside[0], inside[-1]
        cut = np.array(traces)[:, a : b + 1]
        area, n = cut.sum(axis=1), b - a + 1
        z = [(c - c.mean()) / (c.std() if c.std() > 0 else 1.0) for c in cut]
        best = []
        for i in range(len(z)):
            for j in range(i + 1, len(z)):
                at = [(d, sum(z[i][t] * z[j][t + d] for t in range(n) if 0 <= t + d < n) / n) for d in range(-delay, delay + 1)]
                best.append(min(at, key=lambda x: (-round(abs(x[1]), 9), x[0])))
        delays = [abs(d) for d, _ in best]
        lib = np.array(library)
        norm = math.sqrt(area @ area) * math.sqrt(lib @ lib)
        share = lambda v: v / v.sum() if v.sum() > 0 else v
        rows.append((k, points[a], points[apex], points[b], np.mean(delays) + np.std(delays) if delays else None, np.mean([v for _, v in best]) if best else None, math.acos(min(1, max(-1, area @ lib / norm))) if norm else 0.0,
                     np.abs(share(area) - share(lib)).mean(), math.sqrt(((share(area) - share(lib)) ** 2).mean()), math.log(area.sum()), float(n)))
    return rows


def test_peaks(spark):
    rng = random.Random(2)
    cases = [[], [0.0], [3.0], [1.0, 2.0, 1.0], [1.0, 1.0, 1.0], [0.0, 0.0, 2.0, 2.0, 0.0, 0.0, 1.0], [3.0, 2.0, 1.0], [1.0, 2.0, 3.0], [2.0, 1.0, 1.0, 2.0]]
    cases += [[float(rng.choice((0, 0, 1, 2, 3, 5))) for _ in range(rng.randint(1, 12))] for _ in range(150)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x array<double>")
    got = {r["i"]: r for r in df.select("i", extract.peaks(F.col("x")).alias("p"), extract.smoothed(F.col("x")).alias("s")).collect()}
    for i, c in enumerate(cases):
        assert [tuple(p) for p in got[i]["p"]] == (brute_peaks(c) if c else []), c
        assert got[i]["s"] == pytest.approx(brute_smooth(c))


def test_extract_and_score(spark):
    rng = random.Random(3)
    library, gathered, want = [], [], {}
    for g in range(40):
        centre, n = rng.uniform(4, 20), rng.randint(1, 6)
        traces = defaultdict(float)
        for f in range(n):
            library.append((g, f"f{f}", 1.0 / (f + 1)))
            for t in range(24):
                if rng.random() < 0.9 and not (g % 5 == 0 and f == 1):
                    v = 100 / (f + 1) * math.exp(-((t - centre) ** 2) / 4) + rng.random()
                    for part in (v / 2, v / 2):  # several peaks at a point add up
                        gathered.append((g, f"f{f}", float(t), part))
                    traces[f, t] = v
        points = sorted({t for _, t in traces})
        if points:
            want[g] = brute_scores([float(t) for t in points], [[traces[f, t] for t in points] for f in range(n)], [1.0 / (f + 1) for f in range(n)], 3)
    library.append((99, "none", 1.0))
    got = defaultdict(list)
    found = extract.extract_and_score(spark.createDataFrame(gathered, "group int, fragment string, rt double, intensity double"), spark.createDataFrame(library, "group int, fragment string, intensity double"))
    for r in found.orderBy("group", "peak").collect():
        got[r["group"]].append((r["peak"], r["rt_left"], r["rt_apex"], r["rt_right"], *(r[c] for c in extract.SCORES)))
    assert set(got) == set(want)
    for g, rows in want.items():
        assert len(got[g]) == len(rows)
        for a, b in zip(got[g], rows, strict=True):
            assert a[:4] == b[:4]
            assert [x for x in a if x is not None] == pytest.approx([x for x in b if x is not None], abs=1e-6)


def test_gather_by_blocks_of_retention_time(spark):
    rng = random.Random(5)
    peaks = [(i, rng.uniform(0, 400), 500.0, 100 + rng.randrange(40) * 0.001, 1.0) for i in range(3000)]
    asked = [(i, 50000, 100 + rng.randrange(40) * 0.001, rng.uniform(0, 400)) for i in range(60)]
    t, p = spark.createDataFrame(asked, "id int, win_key bigint, product_mz double, rt_apex double"), spark.createDataFrame(peaks, "scan_index int, rt double, win_mz double, mz double, intensity double")
    for width in (0.0, 7.0, 100.0, 5000.0):
        got = sorted((r["id"], r["scan_index"]) for r in index.gather(t, p, rt_width=width).collect())
        assert got == sorted((i, s) for i, _, m, a in asked for s, rt, _, mz, _ in peaks if abs(mz - m) <= m * 1e-5 and abs(rt - a) <= width / 2)


def test_candidates_that_ask_the_same(spark):
    rows = [(c, f, 100.0 + f, 1.0 + (c % 3 == 2)) for c in range(12) for f in range(1 + c % 2)]
    of = extract.alike(spark.createDataFrame(rows, "candidate int, fragment int, mz double, intensity double"), ("mz", "intensity"), "candidate")
    asks = {c: tuple(r[1:] for r in rows if r[0] == c) for c in range(12)}
    assert {r["candidate"]: r["of"] for r in of.collect()} == {c: min(o for o in asks if asks[o] == asks[c]) for c in asks}


def test_one_is_extracted_for_all_that_ask_the_same(spark, monkeypatch):
    """Of the 1500 candidates of sf0.01 300 differ in what they ask, and points of a run are added up before they are met."""
    from peakloom.plans import search

    seen, gather = [], index.gather
    monkeypatch.setattr(search.index, "gather", lambda t, p, **how: (seen.append((t, p)), gather(t, p, **how))[1])
    found = search.extract_and_score(spark, "/root/testdata/sf0.01")
    (asked, points), = seen
    assert asked.select("candidate").distinct().count() == 300
    assert points.count() == points.select("win_mz", "rt", "mz").distinct().count()
    assert found.select("candidate").distinct().count() == 1500


def test_empty(spark):
    none = spark.createDataFrame([], "group int, fragment string, rt double, intensity double")
    assert extract.extract_and_score(none, spark.createDataFrame([(1, "a", 1.0)], "group int, fragment string, intensity double")).count() == 0
