"""Operators on the published fixtures and on edge cases."""

import math
import os
import random
import sqlite3
from collections import Counter

import pytest
from pyspark.sql import functions as F

from peakloom.operators import compare, digest, graph, index, library, percolation, quantiles, rescore
from peakloom.plans import durable
from peakloom.sources import mzml, sqlite, text

FEATURES = [(1, 500.0, 100.0, 0.9, 0), (2, 500.0, 105.0, 0.5, 0), (3, 500.0, 110.0, 0.3, 1), (4, 500.0, 5000.0, 0.4, 0), (5, 900.0, 200.0, 0.7, 0), (6, 900.0, 205.0, 0.2, 1), (7, 900.0, 9000.0, 0.6, 0)]
SCHEMA = "feature_id bigint, mz double, rt double, score double, decoy int"


def test_competition(spark):
    got = {r["feature_id"]: r for r in rescore.competitive_features(spark.createDataFrame(FEATURES, SCHEMA)).collect()}
    assert [round(got[i]["best_delta"], 9) for i in (1, 2, 4, 5, 6)] == [0.4, -0.4, 0, 0.5, -0.5]
    assert (got[1]["rival_rank"], got[3]["rival_rank"]) == (0, 1)
    assert [got[i]["n_compet"] for i in (1, 4, 7)] == pytest.approx([math.log(3), 0, 0])
    assert got[1]["tot_ratio"] > got[2]["tot_ratio"]


def test_competition_ties_edges_and_nulls(spark):
    rows = [(1, 500.0, 0.0, 0.5, 0), (2, 500.0, 15.0, 0.5, 1), (3, 500.0, 30.0, None, 0), (4, 500.0, 30.5, 0.1, 0)]
    got = {r["feature_id"]: r for r in rescore.competitive_features(spark.createDataFrame(rows, SCHEMA), blocks_of=2.0).collect()}
    assert len(got) == 4 and got[1]["best_delta"] == 0 and got[1]["n_compet"] == pytest.approx(math.log(2))
    assert got[3]["best_delta"] is None and got[4]["n_compet"] == 0
    assert rescore.competitive_features(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_do_not_change_competition(spark):
    rows = [(i, 500.0 + i % 3 * 24, float(i * 7919 % 1000), float(i * 31 % 17), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    small, large = ({r["feature_id"]: tuple(round(x, 9) for x in r[1:]) for r in rescore.competitive_features(df, blocks_of=b).collect()} for b in (1.0, 1e6))
    assert small == large


def test_qvalues(spark):
    rows = [(i, 0.0, 0.0, s, d) for i, (s, d) in enumerate([(5.0, 0), (4.0, 0), (3.0, 1), (2.0, 0), (1.0, 1)])]
    got = {r["feature_id"]: round(r["q_value"], 6) for r in rescore.target_decoy_qvalues(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: 0, 1: 0, 2: round(1 / 3, 6), 3: round(1 / 3, 6), 4: round(2 / 3, 6)}


def test_bitmap_edges(spark):
    bins = [0, 63, 64, 5000, 32766, 32767, 32768, 32769, 64]
    at = spark.createDataFrame([(1, 0, b) for b in bins] + [(0, 1, 7)], "win_key bigint, block int, bin int")
    maps = index.cell_bitmaps(at)
    counts = {(r["win_key"], r["block"]): r["n_bins"] for r in index.popcounts(maps).collect()}
    assert counts == {(1, 0): len(set(bins)), (0, 1): 1}
    asked = spark.createDataFrame([(1, 0, b) for b in [0, 1, 62, 63, 64, 4999, 5000, 32767, 32768, 32770]], "win_key bigint, block int, bin int")
    got = {r["bin"]: r["occupied"] for r in index.probe(maps, asked).collect()}
    assert {b for b, on in got.items() if on} == {0, 63, 64, 5000, 32767, 32768}


def test_bitmaps_are_not_broadcast(spark):
    """nearly empty bitmaps are small in a shuffle and 4 kB each in the driver."""
    cells = spark.range(3000).selectExpr("id AS win_key", "0 AS block", "CAST(id * 13 % 70000 AS INT) AS bin")
    asked = cells.unionByName(cells.withColumn("bin", F.col("bin") + 1)).unionByName(cells.limit(1).withColumn("bin", F.lit(None).cast("int")))
    found = index.probe(index.cell_bitmaps(cells), asked)
    rows = found.collect()
    assert len(rows) == 6001 and sum(r["occupied"] for r in rows) == 3000
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_conversion(spark):
    schema = "`Precursor.Mz` double, `Product.Mz` double, `Precursor.Charge` int, `Fragment.Charge` int, `Relative.Intensity` double, RT double, `Stripped.Sequence` string, `Modified.Sequence` string, `Protein.Group` string, `Fragment.Type` string, `Fragment.Series.Number` int, `Precursor.Id` string, Decoy int"
    rows = [(500.1, mz, 2, 1, i, 30.5, "SLYNTVATL", "SLYNTVATL", "P12345", t, s, "SLYNTVATL2", d) for mz, i, t, s, d in ((301.2, 1.0, "y", 3, 0), (402.3, 0.5, "y", 4, 0), (501.4, 0.2, "b", 5, 1))]
    got = library.convert_library(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 2 and {r["NormalizedRetentionTime"] for r in got} == {1830.0} and {r["Decoy"] for r in got} == {0}
    assert {r["TransitionId"] for r in got} == {"SLYNTVATL2_0", "SLYNTVATL2_1"}
    assert library.convert_library(spark.createDataFrame(rows, schema), "seconds").first()["NormalizedRetentionTime"] == 30.5
    with pytest.raises(ValueError, match="the table has"):
        library.convert_library(spark.createDataFrame([(1,)], "a int"))


def test_digest(spark):
    proteins = spark.createDataFrame([(0, "TESTPROT", "ELVISKLIVESRNOWK"), (1, "B", "KPLIVESRAA"), (2, "C", "")], "ordinal bigint, protein string, sequence string")
    options = digest.DigestOptions(missed=0, min_len=4, max_len=30, min_charge=2, max_charge=2)
    got = digest.precursors(proteins, options, policy=None).collect()
    assert {(r["modseq"], r["protein"]) for r in got} == {("ELVISK", "TESTPROT"), ("LIVESR", "TESTPROT"), ("KPLIVESR", "B")}


def test_digest_of_long_sequences(spark):
    rng, letters = random.Random(3), "ACDEFGHIKLMNPQRSTVWY"
    texts = ["", "K", "KP", "RKPKRP", *("".join(rng.choice(letters) for _ in range(n)) for n in (7, 8, 11, 12, 255, 256, 257, 263, 264, 268, 512, 519, 5000, 100_000)), None]
    proteins = spark.createDataFrame([(i, f"P{i}", t) for i, t in enumerate(texts)], "ordinal bigint, protein string, sequence string")
    want, wide = [], Counter()
    for k, t in enumerate(texts):
        n = len(t or "")
        ends = [0, *(i for i in range(1, n) if t[i - 1] in "KR" and t[i] != "P"), n] if n else []
        want += [(k, a, t[a:b]) for i, a in enumerate(ends[:-1]) for b in ends[i + 1 : i + 3] if 7 <= b - a <= 30]
        wide.update((k, s, t[s : s + m]) for s in range(n) for m in range(8, 13) if s + m <= n)
    got = digest.tryptic_peptides(proteins).select("ordinal", "start", "peptide")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert Counter(map(tuple, digest.windows(proteins).collect())) == wide
    # Structs are made in one transform: no row carries a sequence or all its parts beside one peptide.
    for df in (got, digest.windows(proteins)):
        made = [line.strip(" :+-") for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line]
        assert [line for line in made if not line.startswith("Generate posexplode(arrays_zip(cut")] == made[:1] and made[0].startswith("Generate inline")


def test_library(spark):
    proteins = spark.createDataFrame([(0, "P", "SAMPLEMCKPEPTIDEKELVISK")], "ordinal bigint, protein string, sequence string")
    lib = library.assemble(digest.precursors(proteins), library.stub_predictor)
    rows = lib.collect()
    assert tuple(lib.columns) == library.COLUMNS and len(rows) >= 12
    assert all(r["ProductMz"] > 0 and 0 < r["LibraryIntensity"] <= 1 for r in rows)
    tops = {}
    for r in rows:
        tops[r["TransitionGroupId"]] = max(tops.get(r["TransitionGroupId"], 0), r["LibraryIntensity"])
    assert set(tops.values()) == {1.0}
    lines = sorted(r[0] for r in library.library_lines(lib).collect())
    assert lines == sorted(r[0] for r in library.library_lines(lib.repartition(3)).collect())
    counts = {r[0]: r[1] for r in library.detecting(lib).groupBy("TransitionGroupId").count().collect()}
    assert set(counts.values()) <= {6}


def test_best_transitions_are_chosen_in_place(spark):
    """The same rows as by the single steps, and no exchange for them."""
    proteins = spark.createDataFrame([(0, "P0", "MKTAYIAKQRMSTNNACDEFGHIKLMMVVR"), (1, "P1", "AAAAAAAAAAKGGGGGGGR")], "ordinal int, protein string, sequence string")
    forms = digest.precursors(proteins).localCheckpoint()
    got = library.assemble_best(forms, library.stub_predictor)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = library.detecting(library.restrict(library.assemble(forms, library.stub_predictor)))
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and len(rows) > 50


def test_ions_are_made_once(spark):
    """no filter in front of the exploding makes predictions and ions again."""
    forms = spark.createDataFrame([("SAMPLEM(UniMod:35)CK", 2, "SAMPLEMCK", "P")], "modseq string, charge int, peptide string, protein string").localCheckpoint()
    for made in (library.assemble, library.assemble_best):
        plan = made(forms, library.stub_predictor)._jdf.queryExecution().optimizedPlan().toString()
        assert "Filter" not in plan and "Generate explode" in plan
    assert library.assemble(forms.limit(0), library.stub_predictor).count() == 0


def test_decoys(spark):
    got = library.decoy_sequences(spark.createDataFrame([("PEPTIDEK",), ("AAAAAAAK",)], "peptide string")).collect()
    assert [r["peptide"] for r in got] == ["PEPTIDEK"]
    assert got[0]["decoy"][-1] == "R" and sorted(got[0]["decoy"][:-1]) == sorted("PEPTIDE")


def test_decoys_are_tried_once_for_each_peptide(spark):
    """Not for every row: no shuffle stands below the step that makes the peptides distinct."""
    rows = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "PEPTIDEK").otherwise("AAAAAAAK").alias("peptide"))
    got = library.decoy_sequences(rows)
    assert "md5" not in got._jdf.queryExecution().optimizedPlan().toString() and got.count() == 1


def test_overlap(spark):
    a = spark.createDataFrame([("SLYNTVATL", 2), ("KIFGSLAFL", 2), ("GILGFVFTL", 1)], "seq string, charge int")
    b = spark.createDataFrame([("SLYNTVATL", 2), ("GILGFVFTL", 1), ("NLVPMVATV", 2)], "seq string, charge int")
    r = compare.overlap(a, b).first()
    assert (r["n_both"], r["n_only_a"], r["n_only_b"], r["jaccard"]) == (2, 1, 1, 0.5)
    assert compare.overlap(a.limit(0), b.limit(0)).first()["jaccard"] is None


def test_thresholds(spark):
    df = spark.createDataFrame([(0.01,), (0.009,)], "q_value double")
    assert compare.at_threshold(df).count() == 2 and compare.at_threshold(df, inclusive=False).count() == 1


def test_percolation(spark):
    def run(seqs, k=3):
        return percolation.percolate(spark.createDataFrame(list(enumerate(seqs)), "ordinal bigint, sequence string"), k).first()

    two = run(["ACDEFGHI", "KLMNPQRS"])
    assert (two["n_peptides"], two["n_components"], two["largest"], two["verdict"]) == (2, 2, 0.5, "large")
    assert run(["SLYNTVATLY"])["n_peptides"] == 6
    none = run(["AC"])
    assert (none["n_peptides"], none["n_components"], none["largest"]) == (0, 0, 0.0)
    with pytest.raises(ValueError):
        run(["ACDEFGHI"], 9)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (200, 200), (102, 100), (100, 101)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and got[200] == 200
    assert graph.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_fasta(spark, tmp_path):
    path = tmp_path / "x.fasta"
    path.write_text(">P1 first\nELVISK\n  LIVESR \n>P2\n>P3 third\r\nacDE\r\n")
    got = [(r["protein"], r["sequence"]) for r in text.read_fasta(spark, str(path)).orderBy("ordinal").collect()]
    assert got == [("P1", "ELVISKLIVESR"), ("P3", "acDE")]


def test_peptide_list(spark, tmp_path):
    good, bad = tmp_path / "a.tsv", tmp_path / "b.tsv"
    good.write_text("x\tPrecursorCharge\tPeptideSequence\n1\t2\tPEPTIDEK\n\n2\t 3\tSLYNTVATL\n")
    assert {(r["peptide"], r["charge"]) for r in text.read_peptides(spark, str(good)).collect()} == {("PEPTIDEK", 2), ("SLYNTVATL", 3)}
    bad.write_text("PeptideSequence\tPrecursorCharge\nPEPTIDEK\t2x\n")
    with pytest.raises(Exception, match="b.tsv:2"):
        text.read_peptides(spark, str(bad)).collect()


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.osw")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE FEATURE_MS2 (FEATURE_ID INTEGER, SCORE REAL, NAME TEXT)")
        db.executemany("INSERT INTO FEATURE_MS2 VALUES (?, ?, ?)", [(i, i / 2, f"n{i}") for i in range(20)])
    df = sqlite.read_sqlite(spark, path, "FEATURE_MS2", 3)
    assert df.count() == 20 and df.agg(F.sum("SCORE")).first()[0] == 95
    feats = df.select("FEATURE_ID", (F.col("SCORE") * 2).alias("VAR_NEW"))
    for _ in range(2):
        assert sqlite.update_sqlite(feats, path, "FEATURE_MS2", "FEATURE_ID", ("VAR_NEW",)) == 20
    assert sqlite.read_sqlite(spark, path, "FEATURE_MS2").agg(F.sum("VAR_NEW")).first()[0] == 190


def test_sqlite_writer(spark, tmp_path):
    """Whole or not at all, and the same when it is run again."""
    path = str(tmp_path / "y.osw")
    rows = spark.range(500).select(F.col("id"), (F.col("id") / 4).alias("x"), F.concat(F.lit("n"), "id").alias("name")).repartition(7)
    for _ in range(2):
        sqlite.write_sqlite(rows, path, "T")
    assert sqlite.read_sqlite(spark, path, "T").count() == 500
    fresh = rows.select("id", (F.col("x") + 1).alias("x"), (F.col("id") * 2.0).alias("y")).where("id >= 100").unionByName(spark.range(9000, 9005).select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    for _ in range(2):
        assert sqlite.update_sqlite(fresh, path, "T", "id", ("x", "y")) == 400
    want = [(i, i / 4 + (i >= 100), f"n{i}", i * 2.0 if i >= 100 else None) for i in range(500)]
    assert sorted(map(tuple, sqlite.read_sqlite(spark, path, "T").collect())) == want
    broken = fresh.select("id", "x", F.when(F.col("id") == 333, F.raise_error(F.lit("planted")).cast("double")).otherwise(F.col("y") + 1).alias("y"))
    with pytest.raises(Exception, match="planted"):
        sqlite.update_sqlite(broken, path, "T", "id", ("x", "y"))
    assert sorted(map(tuple, sqlite.read_sqlite(spark, path, "T").collect())) == want
    assert sqlite.update_sqlite(fresh.limit(0), path, "T", "id", ("x",)) == 0
    assert os.listdir(tmp_path) == ["y.osw"]


def test_mzml(spark, tmp_path):
    import base64
    import zlib

    import numpy as np

    enc = lambda x, t, z: base64.b64encode(zlib.compress(np.array(x, t).tobytes()) if z else np.array(x, t).tobytes()).decode()
    cv = lambda a, v="", u="": f'<cvParam cvRef="MS" accession="{a}" value="{v}" unitAccession="{u}"/>'
    arrays = lambda m, i: f'<binaryDataArrayList count="2"><binaryDataArray>{cv(mzml.MZ_ARRAY)}{cv(mzml.FLOAT64)}{cv(mzml.ZLIB)}<binary>{enc(m, "<f8", True)}</binary></binaryDataArray><binaryDataArray>{cv(mzml.INTENSITY_ARRAY)}{cv("MS:1000521")}<binary>{enc(i, "<f4", False)}</binary></binaryDataArray></binaryDataArrayList>'
    scan = lambda t: f'<scanList count="1"><scan>{cv(mzml.START, t, mzml.MINUTE)}</scan></scanList>'
    pre = f'<precursorList count="1"><precursor><isolationWindow>{cv(mzml.TARGET, 500.5)}{cv(mzml.LOWER, 12)}{cv(mzml.UPPER, 12)}</isolationWindow></precursor></precursorList>'
    body = f'<spectrum index="0">{cv(mzml.LEVEL, 1)}{scan(0.5)}{arrays([], [])}</spectrum><spectrum index="1">{cv(mzml.LEVEL, 2)}{scan(0.51)}{pre}{arrays([100.5, 200.25], [1, 2])}</spectrum>'
    path = tmp_path / "x.mzML"
    path.write_text(f'<?xml version="1.0"?><mzML><run><spectrumList count="2">{body}</spectrumList></run></mzML>')
    one, two = mzml.read_mzml(spark, str(path)).orderBy("scan_index").collect()
    assert (one["ms_level"], one["rt"], one["peaks"], one["precursors"], one["drift_time"]) == (1, 30.0, [], [], -1.0)
    assert [(p["mz"], p["intensity"]) for p in two["peaks"]] == [(100.5, 1.0), (200.25, 2.0)]
    assert tuple(two["precursors"][0]) == (500.5, 12.0, 12.0)


def test_gather_and_traces(spark):
    peaks = spark.createDataFrame([(1, 10.0, 500.0, 300.0, 5.0, 0.8), (1, 10.0, 500.0, 300.0029, 7.0, 0.8), (1, 10.0, 500.0, 300.004, 9.0, 0.8), (2, 40.0, 500.0, 300.001, 2.0, 1.2), (2, 40.0, 600.0, 300.0, 3.0, 0.8)], "scan_index bigint, rt double, win_mz double, mz double, intensity double, im double")
    asked = spark.createDataFrame([(1, 1, 50000, 300.0, 12.0, 0.8), (1, 2, 50000, 700.0, 12.0, 0.8)], "group int, fragment int, win_key bigint, product_mz double, rt_apex double, im_apex double")
    assert index.gather(asked, peaks).count() == 3
    assert index.gather(asked, peaks, rt_width=10.0).count() == 2
    assert index.gather(asked, peaks, im_width=0.2).count() == 2
    got = index.traces(index.gather(asked, peaks)).collect()
    assert [(r["fragment"], r["trace"]) for r in got] == [(1, [12.0, 2.0])]


def test_cells_hold_no_lists(spark):
    rows = [(1, 0, i % 50, 0.5, i) for i in range(20_000)] + [(2, 0, 7, 1.0, 0)]
    got = index.cells(spark.createDataFrame(rows, "win_key bigint, block int, bin int, intensity float, scan_index bigint"))
    assert not [f for f in got.schema if f.dataType.typeName() in ("array", "map")]
    assert sorted(map(tuple, got.collect())) == [(1, 0, 20_000, 50, 10_000.0), (2, 0, 1, 1, 1.0)]


def test_stream_leaves_no_memory_table(spark, tmp_path):
    from peakloom.streaming.index import read_index, start_index

    schema = "mz double, intensity double, win_mz double, rt double, scan_index bigint"
    spark.createDataFrame([(500.0, 2.0, 400.0, float(i), i) for i in range(60)], schema).write.parquet(str(tmp_path / "in"))
    (tmp_path / "none").mkdir()
    for folder, want in (("in", [(40000, 0, 30, 60.0), (40000, 1, 30, 60.0)]), ("none", [])):
        start_index(spark.readStream.schema(schema).parquet(str(tmp_path / folder)), f"cells_{folder}").awaitTermination()
        assert not spark.catalog.tableExists(f"cells_{folder}")
        assert sorted(tuple(r) for r in read_index(spark, f"cells_{folder}").select("win_key", "block", "n_peaks", "intensity").collect()) == want


def test_windowed_stream(spark, tmp_path):
    from peakloom.streaming.index import windowed_cells

    spark.sql("SELECT CAST(1 AS BIGINT) win_key, timestamp_seconds(id * 10) ts FROM range(60)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("win_key bigint, ts timestamp").parquet(str(tmp_path / "in"))
    running = windowed_cells(stream).writeStream.outputMode("append").format("memory").queryName("cells_by_time").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    running.awaitTermination()
    rows = spark.table("cells_by_time").collect()
    assert rows and {r["n_peaks"] for r in rows} == {3}


def test_aliases_in_order(spark):
    """Where several names of a column are there, the first in order is taken."""
    wide = spark.createDataFrame([(0.5, 0.001, 0.0, "A", "B", 2)], "`Global.Q.Value` double, `Q.Value` double, `PG.Q.Value` double, PeptideSequence string, `Peptide.Sequence` string, `Precursor.Charge` int")
    assert [tuple(r) for r in compare.report_ids(wide).collect()] == [("B", 2)]
    schema = "iRT double, RetentionTime double, Tr_recalibrated double, PrecursorMz double, ProductMz double, PrecursorCharge int, LibraryIntensity double, StrippedPeptide string, ProteinName string, `Protein.Ids` string, IonMobility double, IM double, Genes string"
    row = library.convert_library(spark.createDataFrame([(1.0, 2.0, 3.0, 500.0, 400.0, 2, 1.0, "PEPTIDEK", "B", "A", 0.5, 0.9, "G")], schema), "seconds").first()
    assert (row["NormalizedRetentionTime"], row["ProteinId"], row["PrecursorIonMobility"], row["GeneName"]) == (3.0, "A", 0.9, "G")


def test_exact_medians(spark):
    rng = random.Random(4)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in [rng.choice([rng.random(), 1.0, 2.0]) for _ in range(rng.choice([1, 2, 999, 1000]))]] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for upper in (False, True):
        got = {r["g"]: r["v"] for r in quantiles.medians(df, ["g"], ["v"], upper).collect()}
        for g in ("a", "b", None, "c"):
            v = sorted(x for k, x in rows if k == g and x is not None)
            want = None if not v else v[len(v) // 2] if upper else (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
            assert got[g] == want
    whole = sorted(x for _, x in rows if x is not None)
    assert quantiles.medians(df, [], ["v"], True).first()["v"] == whole[len(whole) // 2]


def test_bitmaps_over_batches(spark):
    """A cell's bits may lie in several batches; no aggregate holds a bitmap for every cell."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(w, b, x) for w in (1, 2) for b in (0, 1, 2) for x in range(0, 70_000, 7001 + w)]
        at = spark.createDataFrame(rows * 2, "win_key bigint, block int, bin int")
        maps = index.merge_bitmaps(*(index.cell_bitmaps(at.where(F.pmod("bin", F.lit(2)) == r)) for r in (0, 1)))
        assert "bitmap_construct_agg" not in maps._jdf.queryExecution().toString() and "bitmap_or_agg" not in maps._jdf.queryExecution().toString()
        got = [(r["win_key"], r["block"], (r["bucket"] - 1) * 32768 + 8 * i + j) for r in maps.collect() for i, byte in enumerate(r["bits"]) for j in range(8) if byte >> j & 1]
        assert sorted(got) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cuts_are_evaluated_once(spark, monkeypatch):
    """Approximate cuts can come out otherwise when they are evaluated again: here they do, and no result may change."""
    real = F.percentile_approx
    moved = F.udf(lambda cuts: sorted(c + random.uniform(-90, 90) for c in cuts), "array<double>")
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda *a: moved(real(*a)))
    df = spark.range(0, 20_000, 1, 8).select((F.col("id") % 5).alias("g"), (F.xxhash64("id") % 600 / 1.0).alias("v"))
    want = {r["g"]: r["v"] for r in df.groupBy("g").agg(F.median("v").alias("v")).collect()}
    assert {r["g"]: r["v"] for r in quantiles.medians(df, ["g"], ["v"]).collect()} == want
    above = {(r["g"], r["value"]): r["n"] for r in quantiles.at_or_better(df, ["g"], "v", {"n": F.lit(1)}).collect()}
    counts = df.groupBy("g", "v").count().collect()
    assert above == {(r["g"], r["v"]): sum(o["count"] for o in counts if o["g"] == r["g"] and o["v"] >= r["v"]) for r in counts}


def test_modified_decoys(spark):
    forms = [(".(UniMod:1)AC(UniMod:4)DEFGHM(UniMod:35)K",), ("AAAAK",)]
    got = {r[0]: r[1] for r in library.decoy_sequences(spark.createDataFrame(forms, "peptide string")).collect()}
    assert list(got) == [forms[0][0]]
    decoy = got[forms[0][0]]
    assert decoy.startswith(".(UniMod:1)") and decoy.endswith("R") and "C(UniMod:4)" in decoy and "M(UniMod:35)" in decoy


def test_reannotation(spark):
    proteins = spark.createDataFrame([(0, "P", "SAMPLEMCKPEPTIDEKELVISK")], "ordinal bigint, protein string, sequence string")
    lib = library.assemble(digest.precursors(proteins), library.stub_predictor)
    moved = lib.withColumn("ProductMz", lib["ProductMz"] + 0.01)
    mz = {r["TransitionId"]: r["ProductMz"] for r in lib.collect()}
    back = library.reannotate(moved).collect()
    assert len(back) == len(mz) and sum(abs(r["ProductMz"] - mz[r["TransitionId"]]) < 1e-9 for r in back) > 0.95 * len(mz)
    assert library.reannotate(lib.withColumn("ProductMz", lib["ProductMz"] + 0.31)).count() < len(mz) / 4


def test_restriction_by_windows(spark):
    rng = random.Random(2)
    rows = [(f"t{i}", rng.uniform(300, 900), rng.uniform(340, 900), "y", 1) for i in range(500)]
    windows = [(300.0 + 25.5 * i, 327.0 + 25.5 * i) for i in range(24)]
    got = library.restrict(spark.createDataFrame(rows, "TransitionId string, PrecursorMz double, ProductMz double, FragmentType string, ProductCharge int"), swaths=spark.createDataFrame(windows, "lower double, upper double"))
    want = {i for i, p, f, _, _ in rows if f >= 350 and not any(a <= p < b and a <= f < b for a, b in windows)}
    assert {r[0] for r in got.select("TransitionId").collect()} == want


def test_frequent_nodes(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5100)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert {got[i] for i in range(3000)} == {0} and {got[i] for i in range(5000, 5101)} == {5000}


def test_missing_score(spark):
    f = spark.createDataFrame([(1, 2, 3.0)], "ID bigint, PRECURSOR_ID bigint, EXP_RT double")
    m = spark.createDataFrame([(1, 0.5)], "FEATURE_ID bigint, VAR_A double")
    with pytest.raises(ValueError, match="VAR_A"):
        rescore.osw_features(f, m, f, "VAR_B")


def test_scratch_tables_go(spark):
    """What is written in a scratch block is gone after it, what is kept stays."""
    path = lambda df: df.inputFiles()[0].removeprefix("file://")
    with durable.scratch(spark):
        gone, kept = (durable.durable_table(spark.range(3).toDF("id"), "t", keep=k) for k in (False, True))
        paths = [path(gone), path(kept)]
        assert all(map(os.path.exists, paths)) and gone.count() == 3
    assert [os.path.exists(p) for p in paths] == [False, True] and kept.count() == 3


def test_gate(spark):
    counts = spark.createDataFrame([(7999, 9000)], "total bigint, targets bigint")
    compare.gate(counts, "total >= 8000 OR targets >= 8000")
    with pytest.raises(RuntimeError, match="gate"):
        compare.gate(counts, "total >= 8000")


def test_sweep_over_the_first_proteins(spark):
    rng = random.Random(5)
    proteins = spark.createDataFrame([(i, "".join(rng.choice("ACDEFGHIKL") for _ in range(30))) for i in range(12)], "ordinal bigint, sequence string")
    got = {(r["k"], r["n_proteins"]): r["n_peptides"] for r in percolation.sweep(proteins, (3, 8), (4, 12)).collect()}
    each = sum(30 - n + 1 for n in range(8, 13))
    assert got == {(k, n): each * n for k in (3, 8) for n in (4, 12)}


def test_library_files(spark, tmp_path):
    """A library is written in one order whatever its partitions, and read again by the suffix of its path."""
    proteins = spark.createDataFrame([(0, "P", "SAMPLEMCKPEPTIDEKELVISK")], "ordinal bigint, protein string, sequence string")
    lib = library.assemble(digest.precursors(proteins), library.stub_predictor).cache()

    def lines(df, name):
        library.write_library(df, str(tmp_path / name))
        return [line for f in sorted((tmp_path / name).glob("part-*")) for line in f.read_text().splitlines() if not line.startswith("PrecursorMz")]

    first = lines(lib, "a.tsv")
    assert first == lines(lib.repartition(5), "b.tsv") and len(first) == lib.count()
    back = text.read_table(spark, str(tmp_path / "a.tsv"))
    assert set(library.COLUMNS) <= set(back.columns) and back.count() == len(first)
    named = lib.withColumn("GeneName", F.when(F.col("ProductCharge") == 1, "GENE"))
    assert lines(named, "d.tsv") == [f"{x}\tGENE" if x.split("\t")[3] == "1" else f"{x}\t" for x in first]
    assert "GeneName" in text.read_table(spark, str(tmp_path / "d.tsv")).columns
    lib.write.parquet(str(tmp_path / "c.parquet"))
    assert text.read_table(spark, str(tmp_path / "c.parquet")).columns == list(library.COLUMNS)
