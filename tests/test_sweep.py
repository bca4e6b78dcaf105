"""Nested components and the percolation sweep against union-find."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from peakloom.operators import graph, percolation


def find(parent, x):
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def test_nested_components(spark):
    rng = random.Random(6)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.randrange(4)) for _ in range(70)] + [("a", "a", 1), ("n1", "n2", 3), ("n1", "n2", 0)]
    got = {}
    for r in graph.nested_components(spark.createDataFrame(edges, "u string, v string, step int"), 5).collect():
        got.setdefault(r["step"], {})[r["node"]] = r["component"]
    for step in range(5):
        parent = {}
        for u, v, s in edges:
            if s <= step:
                parent[find(parent, u)] = find(parent, v)
        assert set(got[step]) == set(parent)
        names = {}
        for node in parent:
            names.setdefault(got[step][node], set()).add(find(parent, node))
        assert all(len(x) == 1 for x in names.values()) and len(names) == len({find(parent, x) for x in parent})


def brute(proteins, k, n):
    parent, weight = {}, Counter()
    for ordinal, _, s in proteins:
        for size in range(8, 13):
            for i in range(len(s or "") - size + 1) if ordinal < n else ():
                u, v = "p" + s[i : i + k], "s" + s[i + size - k : i + size]
                parent[find(parent, u)] = find(parent, v)
                weight[u] += 1
    sizes = Counter()
    for u, w in weight.items():
        sizes[find(parent, u)] += w
    total = sum(sizes.values())
    largest = max(sizes.values()) / total if total else 0.0
    return total, len(sizes), pytest.approx(largest), "PERCOLATED" if largest > 0.5 else "large" if largest > 0.1 else "fragmented"


def test_sweep(spark):
    rng = random.Random(7)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    proteins = [(i, f"P{i}", "".join(rng.choice(letters) for _ in range(rng.choice((0, 5, 9, 30, 60))))) for i in range(40)] + [(41, "Q", None)]
    proteins[8] = (8, "R", proteins[9][2] + proteins[3][2])
    df = spark.createDataFrame(proteins, "ordinal bigint, protein string, sequence string")
    ks, subsets = (2, 3, 5, 8), (5, 10, 25, 1000)
    got = {(r["k"], r["n_proteins"]): (r["n_peptides"], r["n_components"], r["largest"], r["verdict"]) for r in percolation.sweep(df, ks, subsets).collect()}
    assert got == {(k, n): brute(proteins, k, n) for k in ks for n in subsets}
    one = percolation.percolate(df.where(F.col("ordinal") < 25), 3).first()
    assert got[3, 25] == (one["n_peptides"], one["n_components"], pytest.approx(one["largest"]), one["verdict"])
    none = percolation.sweep(df.limit(0), (3,), (5, 10)).collect()
    assert [(r["n_peptides"], r["n_components"], r["largest"], r["verdict"]) for r in none] == [(0, 0, 0.0, "fragmented")] * 2
    with pytest.raises(ValueError, match="exceed"):
        percolation.sweep(df, (9,))


def test_groups_as_numbers(spark):
    """Groups counted as numbers against windows as strings, other characters and long sequences included."""
    from peakloom.operators.digest import windows

    rng = random.Random(8)
    seqs = ["".join(rng.choice("ABYZ") for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3, "ABAB*ABABZé𝄞YZABABABAB" * 2, "abABABABAB", "", None]
    df = spark.createDataFrame(list(enumerate(seqs)), "ordinal bigint, sequence string")
    for k in (1, 3, 6, 7, 8):
        got = {(r["u"], r["v"]): r["peptides"] for r in percolation.group_edges(df, k).collect()}
        want = Counter((f"p:{p[:k]}", f"s:{p[-k:]}") for (p,) in windows(df).select("peptide").collect())
        assert got == want, k


def test_thinned_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(380)] + [(5, 5), (500, 500), (1, None)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    whole = {r["node"]: r["component"] for r in graph.connected_components(df).collect()}
    assert {r["node"]: r["component"] for r in graph.connected_components(df, thin=0).collect()} == whole


def test_contracted_components(spark, tmp_path):
    """components by contraction, to the end and with a rest for one task; tables of the rounds do not stay."""
    rng = random.Random(11)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, 400 + i) for i in range(50)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7), (1, None)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    whole = {r["node"]: r["component"] for r in graph.connected_components(df.where("u <> v")).collect()}
    for small in (0, 60, 10**6):
        got = {r["node"]: r["component"] for r in graph.contracted_components(df, small=small).collect()}
        assert set(got) == set(whole) and len(set(zip(got.values(), (whole[x] for x in got)))) == len(set(got.values())) == len(set(whole.values()))
    assert graph.contracted_components(df.limit(0)).count() == 0


def test_forest(spark):
    """a task tells trees and weights in place of its edges: no more edges than groups, whatever the windows."""
    rng = random.Random(12)
    seqs = ["".join(rng.choice("ACDE") for _ in range(rng.randint(0, 300))) for _ in range(200)] + [None]
    df = spark.createDataFrame([(s, i % 2) for i, s in enumerate(seqs)], "sequence string, step int").coalesce(1)
    for k in (3, 6):
        rows = percolation.forest(df, (k,), 8, 12).collect()
        groups = {(r["step"], x) for r in rows for x in (r["u"], r["v"]) if x is not None}
        assert sum(r["v"] is not None for r in rows) < len(groups)
        assert sum(r["w"] or 0 for r in rows) == sum(max(0, len(s or "") - n + 1) for s in seqs for n in range(8, 13))
        assert percolation.percolate(df, k).first()[1:4] == brute([(0, "", s) for s in seqs], k, 1)[:3]


def test_windows_are_dealt_packed(spark, monkeypatch):
    """what is dealt takes a few bytes a letter, not five edges; in small chunks and pieces the edges are the same."""
    rng = random.Random(14)
    words = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWYBZ") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    seqs = ["".join(rng.choice(words) for _ in range(300)) for _ in range(400)]
    df = spark.createDataFrame([(s,) for s in [*seqs, "AC\0DEFGHIKLMNPQRST*VWYACDEFG", "ACDEFGH", None]], "sequence string").withColumn("ordinal", F.lit(0)).coalesce(1)
    size = percolation._packed_windows(df, 5, 8, 12).select(F.sum(F.length("codes"))).first()[0]
    assert size < 5 * sum(map(len, seqs))
    few = df.where("length(sequence) < 1400")
    want = {(r["u"], r["v"]): r["peptides"] for r in percolation.group_edges(few, 5).collect()}
    for name, value in (("CHUNK", 5000), ("AT_ONCE", 7), ("PIECE", 1000), ("PARTS", 3)):
        monkeypatch.setattr(percolation, name, value)
    assert {(r["u"], r["v"]): r["peptides"] for r in percolation.group_edges(few, 5).collect()} == want
    counted = Counter()
    for (s,) in few.where("sequence is not null").select("sequence").collect():
        for n in range(8, 13):
            for i in range(len(s) - n + 1):
                counted["p:" + s[i : i + 5], "s:" + s[i + n - 5 : i + n]] += 1
    assert want == counted


def test_sweep_query_is_whole(spark, tmp_path):
    """F8: every k, and proteins beyond the last subset."""
    from peakloom.plans.search import percolation_sweep

    rng = random.Random(13)
    texts = [(n, "".join(rng.choice("acdefg") for _ in range(30))) for n in (0, 300, 30_000, 40_000)] + [(None, "acdefghikl")]
    spark.createDataFrame([(*t, "en", "s", 30) for t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["k"], r["n_proteins"]): r["n_peptides"] for r in percolation_sweep(spark, str(tmp_path)).collect()}
    each = sum(30 - n + 1 for n in range(8, 13))
    assert got == {(k, n): w for k in range(3, 9) for n, w in ((200, each), (1000, 2 * each), (5000, 2 * each), (20594, 2 * each), (5, 4 * each + 6))}
