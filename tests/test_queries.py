"""Every registered query that has SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from peakloom.operators import digest, library
from peakloom.plans.proxies import all_proteins, proxy
from peakloom.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(df):
    text = lambda x: "" if x is None or (isinstance(x, float) and math.isnan(x)) else format(x + 0.0, ".9g") if isinstance(x, float) else str(x)
    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_library_of_all_proteins(spark):
    proteins = proxy(spark, DATA, "proteins")
    want = library.detecting(library.restrict(library.assemble(digest.precursors(proteins), library.stub_predictor)))
    got = QUERIES["library_assembly"](spark, DATA)
    assert {r[0] for r in want.select("TransitionId").collect()} <= {r[0] for r in got.select("TransitionId").collect()}
    assert {r[0] for r in got.select("ProteinId").collect()} & {r[0] for r in proteins.where("ordinal >= 50").select("protein").collect()}


def test_library_of_long_documents(spark):
    long = all_proteins(spark, DATA).join(proxy(spark, DATA, "proteins"), "ordinal", "left_anti")
    assert all_proteins(spark, DATA).count() == 200 and long.count() == 80
    seen = {r[0] for r in QUERIES["library_assembly"](spark, DATA).select("PeptideSequence").collect()}
    assert seen & {r[0] for r in digest.tryptic_peptides(long).select("peptide").collect()} - {r[0] for r in digest.tryptic_peptides(proxy(spark, DATA, "proteins")).select("peptide").collect()}


def test_decoys_of_whole_names(spark, tmp_path):
    spark.createDataFrame([(1, "peptidesequence lake"), (2, "vanity peptidesequence lake")], "p_partkey bigint, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    rows = QUERIES["decoy_sequences"](spark, str(tmp_path)).collect()
    assert {r["peptide"] for r in rows} == {"PEPTIDESEQENCELAKEMCM", "VANITYPEPTIDESEQENCELAKEMCM"}
    assert all(sorted(r["decoy"]) == sorted(r["peptide"]) for r in rows)


def test_percolation_of_all_proteins(spark):
    n = sum(max(0, len(r[0]) - k + 1) for r in all_proteins(spark, DATA).select("sequence").collect() for k in range(8, 13))
    assert QUERIES["percolation"](spark, DATA).first()["n_peptides"] == n
