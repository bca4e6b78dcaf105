"""mzML spectra: Spark's XML source splits the file by spectrum, an Arrow function decodes the binary arrays."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CV = "array<struct<_accession:string,_value:string,_unitAccession:string>>"
SCHEMA = (
    f"_index bigint, cvParam {_CV}, scanList struct<scan:array<struct<cvParam:{_CV}>>>,"
    f"precursorList struct<precursor:array<struct<isolationWindow:struct<cvParam:{_CV}>,selectedIonList:struct<selectedIon:array<struct<cvParam:{_CV}>>>>>>,"
    f"binaryDataArrayList struct<binaryDataArray:array<struct<cvParam:{_CV},binary:string>>>"
)
#: Accessions of the PSI-MS vocabulary.
LEVEL, START, MINUTE, DRIFT, TARGET, LOWER, UPPER, SELECTED = "MS:1000511", "MS:1000016", "UO:0000031", "MS:1002476", "MS:1000827", "MS:1000828", "MS:1000829", "MS:1000744"
MZ_ARRAY, INTENSITY_ARRAY, FLOAT64, ZLIB = "MS:1000514", "MS:1000515", "MS:1000523", "MS:1000574"


def _param(params, accession: str):
    return F.get(F.filter(params, lambda p: p["_accession"] == accession), F.lit(0))["_value"]


def _decode(arrays) -> list[dict[str, float]]:
    found = {}
    for a in arrays if arrays is not None else []:
        names = {p["_accession"] for p in a["cvParam"]}
        data = base64.b64decode(a["binary"] or "")
        if ZLIB in names and data:
            data = zlib.decompress(data)
        values = np.frombuffer(data, "<f8" if FLOAT64 in names else "<f4").astype(float)
        for name in (MZ_ARRAY, INTENSITY_ARRAY):
            if name in names:
                found[name] = values
    mz, intensity = found.get(MZ_ARRAY, np.zeros(0)), found.get(INTENSITY_ARRAY, np.zeros(0))
    return [{"mz": float(m), "intensity": float(i)} for m, i in zip(mz, intensity, strict=True)]


def decode_peaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for arrays in batches:
        yield arrays.map(_decode)


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """(run, scan_index, ms_level, rt in seconds, drift_time or -1, precursors, peaks), one row for each spectrum."""
    raw = spark.read.format("xml").option("rowTag", "spectrum").schema(SCHEMA).load(path)
    return decoded(raw.withColumn("run", F.input_file_name()))


def stream_mzml(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """The same rows as a stream over a folder of runs. A batch takes ``files_per_trigger`` files at most and the next begins
    when it is done, so a slow consumer holds the reader back and memory holds one batch."""
    reader = spark.readStream.format("xml").option("rowTag", "spectrum").option("maxFilesPerTrigger", files_per_trigger).schema(SCHEMA)
    return decoded(reader.load(path).withColumn("run", F.input_file_name()))


def parse_counts(spectra: DataFrame) -> DataFrame:
    """What parsing alone yields, without an index: fragment spectra that would be indexed, and their peaks; batch or stream."""
    return spectra.where("ms_level = 2 AND size(peaks) > 0 AND size(precursors) > 0").agg(F.count(F.lit(1)).alias("spectra"), F.coalesce(F.sum(F.size("peaks").cast("bigint")), F.lit(0)).alias("peaks"))


def write_mzml(spectra: DataFrame, path: str) -> None:
    """Spectra as files of ``spectrum`` elements that ``read_mzml`` reads: 64-bit arrays, compressed. For exchange between jobs
    and for tests; not a complete document of the format."""
    spectra.select("scan_index", "ms_level", "rt", "drift_time", "precursors", "peaks").mapInArrow(_elements, "value string").write.mode("overwrite").text(path)


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def cv(accession: str, value: object = "", unit: str = "") -> str:
        return f'<cvParam accession="{accession}" value="{value}"' + (f' unitAccession="{unit}"' if unit else "") + "/>"

    def array(kind: str, values: list[float]) -> str:
        data = base64.b64encode(zlib.compress(np.asarray(values, "<f8").tobytes())).decode()
        return f"<binaryDataArray>{cv(FLOAT64)}{cv(ZLIB)}{cv(kind)}<binary>{data}</binary></binaryDataArray>"

    def element(r: dict) -> str:
        window = lambda p: cv(TARGET, p["mz"]) + cv(LOWER, p["iso_lower"]) + cv(UPPER, p["iso_upper"])
        chosen = "".join(f"<precursor><isolationWindow>{window(p)}</isolationWindow></precursor>" for p in r["precursors"])
        drift = cv(DRIFT, r["drift_time"]) if r["drift_time"] >= 0 else ""
        arrays = array(MZ_ARRAY, [p["mz"] for p in r["peaks"]]) + array(INTENSITY_ARRAY, [p["intensity"] for p in r["peaks"]])
        return (
            f'<spectrum index="{r["scan_index"]}">{cv(LEVEL, r["ms_level"])}<scanList><scan>{cv(START, r["rt"])}{drift}</scan></scanList>'
            + (f"<precursorList>{chosen}</precursorList>" if chosen else "")
            + f"<binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>"
        )

    lines = lambda some: pa.record_batch([pa.array(some, pa.string())], names=["value"])
    yield lines(["<run>"])
    for batch in batches:
        yield lines(map(element, batch.to_pylist()))
    yield lines(["</run>"])


def decoded(raw: DataFrame) -> DataFrame:
    """Elements of ``SCHEMA`` with their ``run`` as rows of ``read_mzml``."""
    scan = F.get("scanList.scan", F.lit(0))["cvParam"]
    start = F.get(F.filter(scan, lambda p: p["_accession"] == START), F.lit(0))
    rt = start["_value"].cast("double") * F.when(start["_unitAccession"] == MINUTE, 60.0).otherwise(1.0)
    number = lambda p, a: _param(p, a).cast("double")

    def precursor(p):
        own = p["isolationWindow"]["cvParam"]
        chosen = F.get(p["selectedIonList"]["selectedIon"], F.lit(0))["cvParam"]
        mz = F.coalesce(number(own, TARGET), number(chosen, SELECTED))
        return F.struct(mz.alias("mz"), F.coalesce(number(own, LOWER), F.lit(0.0)).alias("iso_lower"), F.coalesce(number(own, UPPER), F.lit(0.0)).alias("iso_upper"))

    return raw.select(
        "run", F.col("_index").alias("scan_index"), _param(F.col("cvParam"), LEVEL).cast("int").alias("ms_level"), rt.alias("rt"),
        F.coalesce(number(scan, DRIFT), F.lit(-1.0)).alias("drift_time"),
        F.coalesce(F.transform("precursorList.precursor", precursor), F.array().cast("array<struct<mz:double,iso_lower:double,iso_upper:double>>")).alias("precursors"),
        F.pandas_udf(decode_peaks, "array<struct<mz:double,intensity:double>>")("binaryDataArrayList.binaryDataArray").alias("peaks"),
    )
