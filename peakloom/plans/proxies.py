"""Domain relations over the driver's tables. Each is one SQL text for Spark and one for DuckDB; they differ in the
engines' spelling only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SECONDS = {"spark": "timestampdiff(MICROSECOND, TIMESTAMP '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP)) / 1e6D", "duck": "date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts::TIMESTAMP) / 1e6::DOUBLE"}


def _sql(text: str, engine: str) -> str:
    spark = engine == "spark"
    return (
        text.replace("{seconds}", SECONDS[engine]).replace("{double}", "D" if spark else "::DOUBLE").replace("{idiv}", "div" if spark else "//")
    )


#: name -> (tables, text)
PROXIES = {
    "features": (
        ["events"],
        "SELECT event_id AS feature_id, 300 + value AS mz, {seconds} AS rt, CAST((event_id * 7919) % 100 AS DOUBLE) / 100.0{double} AS score, CAST(event_id % 2 AS INT) AS decoy FROM {events}",
    ),
    "spectra": (
        ["events"],
        "SELECT 'run' || CAST(user_id % 3 AS VARCHAR(9)) AS run, event_id AS scan_index, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 2 ELSE 3 END AS ms_level, {seconds} AS rt,"
        " CASE WHEN event_id % 7 = 0 THEN 0.8{double} ELSE -1.0{double} END AS drift_time, CAST(1 + event_id % 5 AS BIGINT) AS n_peaks,"
        " 400.0{double} + 24 * (user_id % 25) - 12 AS lower, 400.0{double} + 24 * (user_id % 25) + 12 AS upper FROM {events}",
    ),
    "peaks": (
        ["events"],
        "SELECT event_id {idiv} 4 AS scan_index, {seconds} AS rt, 400.0{double} + 24 * (user_id % 25) AS win_mz, 90 + value AS mz, value AS intensity FROM {events}",
    ),
    "transitions": (
        ["lineitem"],
        'SELECT 300 + l_extendedprice / 50 AS "PrecursorMz", 300 + l_extendedprice / 50 AS "ProductMz", CAST(2 AS INT) AS "PrecursorCharge", CAST(1 + l_linenumber % 2 AS INT) AS "ProductCharge",'
        ' l_quantity / 50 AS "LibraryIntensity", CAST(l_orderkey % 120 AS DOUBLE) AS "NormalizedRetentionTime",'
        " CASE WHEN l_returnflag = 'R' THEN 'y' ELSE 'b' END AS \"FragmentType\", CAST(l_linenumber AS INT) AS \"FragmentSeriesNumber\","
        ' CAST(l_orderkey AS VARCHAR(20)) AS "TransitionGroupId", CAST(l_partkey AS VARCHAR(20)) || \'_\' || CAST(l_suppkey AS VARCHAR(20)) || \'_\' || CAST(l_linenumber AS VARCHAR(9)) AS "TransitionId",'
        ' CAST(CASE WHEN l_linestatus = \'O\' THEN 1 ELSE 0 END AS INT) AS "Decoy" FROM {lineitem}',
    ),
    "scored": (
        ["lineitem", "orders"],
        "SELECT l_orderkey * 8 + l_linenumber AS feature_id, l_discount AS q_value, l_orderkey AS precursor_id, CAST(1 + o_orderkey % 4 AS INT) AS charge, CAST(o_orderkey % 2 AS INT) AS decoy"
        " FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
    ),
    "mapping": (["lineitem"], "SELECT DISTINCT l_orderkey AS precursor_id, l_partkey AS peptide_id FROM {lineitem}"),
    "peptides": (["part"], "SELECT p_partkey AS peptide_id, p_name AS unmodified, p_name || p_type AS modified FROM {part}"),
    "protein_map": (["lineitem"], "SELECT DISTINCT l_partkey AS peptide_id, l_suppkey AS protein_id FROM {lineitem}"),
    "proteins": (
        ["documents"],
        "SELECT doc_id AS ordinal, 'P' || CAST(doc_id AS VARCHAR(20)) AS protein, upper(regexp_replace(text, '[^A-Za-z]+', ''{all})) AS sequence FROM {documents} WHERE n_chars < 2000",
    ),
    "whole_proteins": (
        ["documents"],
        "SELECT doc_id AS ordinal, 'P' || CAST(doc_id AS VARCHAR(20)) AS protein, upper(regexp_replace(text, '[^A-Za-z]+', ''{all})) AS sequence FROM {documents}",
    ),
    # Peaks at ten masses on a grid of half days, so that fragments share points.
    "chromatogram": (
        ["events"],
        "SELECT event_id AS scan_index, floor({seconds} / 43200) * 43200{double} AS rt, 400.0{double} + 24 * (user_id % 25) AS win_mz, 100 + 50 * floor(value / 50) + (event_id % 7) * 0.0001{double} AS mz, value AS intensity FROM {events}",
    ),
    # Six fragments for each customer, in one of the windows.
    "assays": (
        ["customer"],
        "SELECT c_custkey AS candidate, CAST(c_custkey % 2 AS INT) AS decoy, CAST(40000 + 2400 * (c_custkey % 25) AS BIGINT) AS win_key, j AS fragment, CAST(100 + 50 * ((c_custkey * 7 + j * 3) % 10) AS DOUBLE) AS product_mz, 1.0{double} / (1 + j) AS intensity,"
        " CAST((c_custkey * 7919) % 60 AS DOUBLE) * 43200 AS rt_apex FROM {customer} CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) AS fragments",
    ),
    # Three peak groups for each precursor with four sub-scores: every second target precursor has one real group, the second.
    "peak_groups": (
        ["events"],
        "SELECT event_id AS group_id, event_id {idiv} 3 AS precursor_id, CAST((event_id {idiv} 3) % 2 AS INT) AS decoy,"
        " (event_id * 7919 % 1009 + event_id * 104729 % 1013 + event_id * 1299709 % 1019) / 1000.0{double} + CASE WHEN (event_id {idiv} 3) % 4 = 0 AND event_id % 3 = 1 THEN 1.6{double} ELSE 0.0{double} END AS s1,"
        " (event_id * 15485863 % 1021 + event_id * 86028121 % 1031) / 1000.0{double} + CASE WHEN (event_id {idiv} 3) % 4 = 0 AND event_id % 3 = 1 THEN 0.9{double} ELSE 0.0{double} END AS s2,"
        " CASE WHEN event_id % 41 = 0 THEN NULL ELSE (event_id * 32452843 % 1033) / 1000.0{double} - CASE WHEN (event_id {idiv} 3) % 4 = 0 AND event_id % 3 = 1 THEN 0.4{double} ELSE 0.0{double} END END AS s3,"
        " (event_id * 49979687 % 1039) / 1000.0{double} AS s4 FROM {events}",
    ),
    "osw_feature": (["lineitem"], 'SELECT l_orderkey * 8 + l_linenumber AS "ID", l_orderkey AS "PRECURSOR_ID", l_quantity * 20 AS "EXP_RT" FROM {lineitem}'),
    "osw_feature_ms2": (["lineitem"], 'SELECT l_orderkey * 8 + l_linenumber AS "FEATURE_ID", l_discount + l_tax AS "VAR_XCORR_SHAPE" FROM {lineitem}'),
    "osw_precursor": (["orders"], 'SELECT o_orderkey AS "ID", 300 + o_totalprice / 1000 AS "PRECURSOR_MZ", CAST(1 + o_orderkey % 4 AS INT) AS "CHARGE", CAST(o_orderkey % 2 AS INT) AS "DECOY" FROM {orders}'),
}


def spark_sql(name: str) -> str:
    tables, text = PROXIES[name]
    return _sql(text, "spark").replace('"', "`").replace("{all}", "")


def duck_sql(name: str) -> str:
    tables, text = PROXIES[name]
    text = _sql(text, "duck").replace("{all}", ", 'g'")
    for t in tables:
        text = text.replace("{" + t + "}", t)
    return text


def proxy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, _ = PROXIES[name]
    return spark.sql(spark_sql(name), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def all_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proteins of every document, of any length. (``proteins`` has short ones only, for tests.)"""
    return proxy(spark, sf_dir, "whole_proteins")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a fragment trace; a group is a label's vectors among sixty consecutive ids."""
    return spark.sql(
        "SELECT CAST(label AS BIGINT) * 1000000000 + vec_id div 60 AS `group`, vec_id AS fragment, transform(embedding, x -> CAST(x AS DOUBLE)) AS trace FROM {embeddings}",
        embeddings=spark.read.parquet(f"{sf_dir}/embeddings.parquet"),
    )


#: The same as rows (grp, fragment, i, v), i from 1.
DUCK_TRACES = (
    "t AS (SELECT label::BIGINT * 1000000000 + vec_id // 60 AS grp, vec_id AS fragment, embedding FROM embeddings),"
    " x AS (SELECT grp, fragment, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS v FROM t)"
)
