"""Scalar and array functions against published values and brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peakloom.functions import binning, chemistry, scoring
from peakloom.operators import digest

A, B = [0.0, 1.0, 3.0, 5.0, 2.0, 0.0], [1.0, 3.0, 5.0, 2.0, 0.0, 0.0]


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string' if isinstance(v, str) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first()["x"]


def test_standardize(spark):
    got = one(spark, scoring.standardize(F.col("a")), a=A)
    assert got == pytest.approx([-1.03479296, -0.47036043, 0.65850461, 1.78736965, 0.09407209, -1.03479296], abs=1e-5)
    assert one(spark, scoring.standardize(F.col("a")), a=[2.0, 2.0]) == [0.0, 0.0]
    assert spark.sql("SELECT CAST(array() AS array<double>) a").select(scoring.standardize(F.col("a"))).first()[0] == []


def test_xcorr(spark):
    got = one(spark, scoring.xcorr(F.col("a"), F.col("b"), 2), a=A, b=B)
    assert [r["delay"] for r in got] == [-2, -1, 0, 1, 2]
    assert [r["value"] for r in got] == pytest.approx([0.15634218, 0.8215339, 0.4159292, -0.567846, -0.7374631], abs=1e-5)
    best = one(spark, scoring.xcorr_max(scoring.xcorr(F.col("a"), F.col("b"), 2)), a=A, b=B)
    assert (best["delay"], round(best["value"], 5)) == (-1, 0.82153)
    flat = one(spark, scoring.xcorr_max(scoring.xcorr(F.col("a"), F.col("b"), 2)), a=[1.0] * 4, b=[2.0] * 4)
    assert (flat["delay"], flat["value"]) == (-2, 0.0)


def test_distances(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, scoring.normalized_manhattan(a, b), a=A, b=B) == pytest.approx(0.15151515, abs=1e-5)
    assert one(spark, scoring.rmsd(a, b), a=A, b=B) == pytest.approx(1.91485421551, abs=1e-5)
    assert one(spark, scoring.rmsd(a, b), a=A, b=[1.0]) is None


@pytest.mark.parametrize(
    ("a", "b", "angle"),
    [
        ([0.6608937, 0.0726909, 0.40912141], [0.52081914, 0.71088, 0.0175557], 0.9449782659258582),
        ([0.58858475, 0.08963515, 0.08578046], [0.76180969, 0.72763536, 0.50090751], 0.6547156284689354),
        ([1.0, 0.0], [0.0, 1.0], math.pi / 2),
        ([1.0, 2.0], [1.0, 2.0], 0.0),
        ([0.0, 0.0], [1.0, 2.0], 0.0),
    ],
)
def test_spectral_angle(spark, a, b, angle):
    assert one(spark, scoring.spectral_angle(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(angle, abs=1e-5)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.floats(-50, 50), st.floats(-50, 50)), min_size=2, max_size=12))
def test_against_numpy(spark, pairs):
    a, b = ([float(round(x, 3)) for x in side] for side in zip(*pairs, strict=True))
    row = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(scoring.rmsd(F.col("a"), F.col("b")), scoring.xcorr_post(F.col("a"), F.col("b"), 2)).first()
    assert row[0] == pytest.approx(math.sqrt(np.mean((np.array(a) - b) ** 2)), abs=1e-6)
    for r in row[1]:
        d = r["delay"]
        expected = sum(a[i] * b[i + d] for i in range(len(a)) if 0 <= i + d < len(a)) / len(a)
        assert r["value"] == pytest.approx(expected, abs=1e-6)


def test_bins(spark):
    values = [100.0, 250.0, 500.0, 501.0, 1234.5, 1999.0, 99.9999, 90.0]
    rows = spark.createDataFrame([(v,) for v in values], "mz double").select(binning.mz_bin(F.col("mz"))).collect()
    got = [r[0] for r in rows]
    assert got == [int(math.log(v / 100) * (1 / math.log1p(20e-6))) for v in values]
    assert got[0] == 0 and got[6] == 0 and got[7] < 0 and got[2] < got[3]


def test_upper_median(spark):
    def median(xs):
        return spark.createDataFrame([(float(x),) for x in xs], "x double").agg(binning.upper_median("x")).first()[0]

    assert [median(x) for x in ([], [5], [3, 1, 2], [1, 2, 3, 4])] == [0, 5, 2, 3]


def test_binomial_tail(spark):
    got = one(spark, binning.binomial_tail(F.col("p"), 3, 6), p=0.3)
    assert got == pytest.approx(sum(math.comb(6, i) * 0.3**i * 0.7 ** (6 - i) for i in range(3, 7)))


def test_peptidoforms(spark):
    forms = one(spark, digest.peptidoforms(F.col("p")), p="AMCK")
    assert len(forms) == 4 and all("UniMod:4)" in f for f in forms)
    assert sum("UniMod:35" in f for f in forms) == 2 and sum("UniMod:1)" in f for f in forms) == 2
    assert len(one(spark, digest.peptidoforms(F.col("p"), digest.ModPolicy(max_var=0)), p="AMCK")) == 1
    assert len(one(spark, digest.peptidoforms(F.col("p")), p="M" * 8)) == 1 + 9 + 36


def test_masses(spark):
    m = one(spark, chemistry.precursor_mz(chemistry.residue_masses(F.col("p")), F.lit(2)), p="PEPTIDEK")
    assert m == pytest.approx(464.7347, abs=1e-3)
    form = one(spark, chemistry.total(chemistry.form_masses(F.col("p"))), p=".(UniMod:1)AM(UniMod:35)C(UniMod:4)K")
    plain = one(spark, chemistry.total(chemistry.residue_masses(F.col("p"))), p="AMCK")
    assert form - plain == pytest.approx(42.01056468 + 15.99491462 + 57.02146372)


@pytest.mark.parametrize(
    ("mods", "sites", "expected"),
    [
        ("Oxidation@M", "2", {(2, "O", 1)}),
        ("Carbamidomethyl@C", "8", {(8, "C", 2), (8, "H", 3), (8, "N", 1), (8, "O", 1)}),
        ("Acetyl@Protein_N-term", "0", {(0, "C", 2), (0, "H", 2), (0, "O", 1)}),
        ("Oxidation@M;Oxidation@M", "2;4", {(2, "O", 1), (4, "O", 1)}),
        ("Phospho@S", "1", {(1, "H", 1), (1, "O", 3), (1, "P", 1)}),
        ("", "", set()),
    ],
)
def test_elements(spark, mods, sites, expected):
    rows = one(spark, chemistry.element_rows(F.col("m"), F.col("s")), m=mods, s=sites)
    assert {tuple(r) for r in rows} == expected


def test_long_arrays_cost_in_proportion(spark):
    """Values are bound once: a cubic form would take 64 times as long for four times the length."""
    import time

    def seconds(n):
        df = spark.range(200).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i * F.col("id") % 97).cast("double")).alias("x")).cache()
        df.count()
        run = lambda: df.select(scoring.standardize(F.col("x")).alias("z"), scoring.normalized_manhattan(F.col("x"), F.reverse("x")).alias("m"), scoring.xcorr_max(scoring.xcorr(F.col("x"), F.reverse("x"), 2)).alias("c")).write.format("noop").mode("overwrite").save()
        run()
        best = []
        for _ in range(3):
            began = time.perf_counter()
            run()
            best.append(time.perf_counter() - began)
        df.unpersist()
        return min(best)

    assert seconds(1200) < 12 * seconds(300) + 0.5


def test_xcorr_beyond_the_length(spark):
    got = one(spark, scoring.xcorr_post(F.col("a"), F.col("b"), 3), a=[1.0, 2.0], b=[3.0, 4.0])
    assert [r["value"] for r in got] == [0.0, 0.0, 3.0, 5.5, 2.0, 0.0, 0.0]
    assert one(spark, scoring.xcorr_post(F.col("a"), F.col("b"), 3), a=[1.0, 2.0], b=[3.0]) is None


def test_ions_of_short_forms(spark):
    assert one(spark, F.transform(chemistry.fragment_ions(chemistry.residue_masses(F.col("s")), F.lit(2)), lambda x: x["mz"]), s="A") == []
    assert one(spark, chemistry.fragment_ions(chemistry.residue_masses(F.col("s")), F.lit(2)), s="") == []
    got = one(spark, chemistry.fragment_ions(chemistry.form_masses(F.col("s")), F.lit(1)), s="AC(UniMod:4)K")
    masses = [chemistry.RESIDUES["A"], chemistry.RESIDUES["C"] + 57.02146372, chemistry.RESIDUES["K"]]
    assert [(r["type"], r["series"]) for r in got] == [("b", 1), ("b", 2), ("y", 1), ("y", 2)]
    assert [r["mz"] for r in got] == pytest.approx([sum(masses[:k]) + chemistry.PROTON for k in (1, 2)] + [sum(masses[-k:]) + chemistry.WATER + chemistry.PROTON for k in (1, 2)])
