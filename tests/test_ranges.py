"""Reading within a file: ranges of any size, restarts in the middle, growth."""

import io
import random

from pyspark.sql import functions as F

from peakloom.operators import index, profile
from peakloom.sources import mzml, ranges
from peakloom.streaming import cells

SPECTRA = (
    "scan_index bigint, ms_level int, rt double, drift_time double, precursors array<struct<mz:double,iso_lower:double,iso_upper:double>>, peaks array<struct<mz:double,intensity:double>>"
)


def run(spark, n: int, to: str) -> bytes:
    """One file of ``n`` spectra, with what a document has around them."""
    rng = random.Random(4)
    rows = [(i, 2 if i % 4 else 1, i * 0.5, -1.0, [(400.0 + 24 * (i % 3), 12.0, 12.0)] if i % 4 else [], [(rng.uniform(90, 900), float(rng.randint(1, 9))) for _ in range(rng.choice((0, 1, 5, 300)))]) for i in range(n)]
    mzml.write_mzml(spark.createDataFrame(rows, SPECTRA).coalesce(1), to)
    body = b"".join(open(f"{to}/{f}", "rb").read() for f in sorted(__import__("os").listdir(to)) if f.startswith("part"))
    return b'<mzML><spectrumList count="9">' + body.replace(b"<run>", b"").replace(b"</run>", b"") + b"</spectrumList><chromatogramList/>" + b" " * 3000 + b"</mzML>"


def plain(rows) -> list:
    return sorted((r["scan_index"], r["ms_level"], r["rt"], str(r["precursors"]), str(r["peaks"])) for r in rows)


def test_elements_of_any_ranges():
    """Against a slow reading: every spectrum once, whatever the cuts, tags across them included."""
    some = [b'<spectrum index="%d">' % i + b"x" * (i * 7 % 23) + b"</spectrum>" for i in range(20)]
    data = b"<spectrumList>" + b"\n".join(some[:10]) + b'<spectrum index="e"/>' + b"".join(some[10:]) + b'</spectrumList><spectrum index="9">never'
    want = [(data.index(s), s) for s in some]
    for step in (1, 2, 5, 17, 64, 10_000):
        got = [e for a in range(0, len(data), step) for e in ranges.elements(io.BytesIO(data), a, min(a + step, len(data)))]
        assert got == want, step
    ends = [data.index(s) + len(s) for s in some]
    for low in (0, *ends):
        for want_at in range(low, len(data) + 1, 3):
            past = [e for e in ends if low < e <= want_at]
            later = [e for e in ends if e > want_at]
            assert ranges.boundary(io.BytesIO(data), low, want_at, len(data)) == (past[-1] if past else later[0] if later else low)


def test_reads_longer_than_a_block(monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK", 7)
    test_elements_of_any_ranges()


def test_batch_equals_the_xml_source(spark, tmp_path):
    data = run(spark, 300, str(tmp_path / "w"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.mzML").write_bytes(data)
    (tmp_path / "in" / "b.mzML").write_bytes(b"")
    (tmp_path / "in" / "_hidden").write_bytes(data)
    want = plain(mzml.read_mzml(spark, str(tmp_path / "in" / "a.mzML")).collect())
    assert len(want) == 300
    for step in (5_000, 1 << 25):
        found = ranges.read_ranges(spark, f"file:{tmp_path}/in", step)
        assert plain(found.collect()) == want and {r[0] for r in found.select("run").distinct().collect()} == {f"{tmp_path}/in/a.mzML"}
    (tmp_path / "none").mkdir()
    assert ranges.read_ranges(spark, str(tmp_path / "none")).count() == 0


def test_stream_within_a_growing_file(spark, tmp_path):
    """Starts, restarts and growth in the middle of a spectrum: each spectrum once, and the index of the batch."""
    data = run(spark, 400, str(tmp_path / "w"))
    (tmp_path / "in").mkdir()
    path, checkpoint = tmp_path / "in" / "a.mzML", str(tmp_path / "state")
    seen = str(tmp_path / "seen")
    for part in (0.3, 0.3, 0.7, 1.0):
        path.write_bytes(data[: int(part * len(data))])
        spectra = ranges.stream_ranges(spark, str(tmp_path / "in"), 40_000, 9_000)
        q = spectra.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{seen}/batch={i}")).option("checkpointLocation", str(tmp_path / "rows")).start()
        cells.drain(q)
        peaks = profile.isolation_bounds(profile.fragment_scans(spectra)).select("win_mz", "rt", F.inline("peaks"))
        to, _ = cells.run_index(peaks, "ranges", checkpoint=checkpoint, by_ranges=True)
    path.write_bytes(data)
    want = mzml.read_mzml(spark, str(path))
    got = spark.read.parquet(seen)
    assert plain(got.collect()) == plain(want.collect()) and got.select("batch").distinct().count() > 3
    flat = profile.isolation_bounds(profile.fragment_scans(want)).select("scan_index", "win_mz", "rt", F.inline("peaks"))
    batch = {(r["win_key"], r["block"]): (r["n_peaks"], r["n_bins"]) for r in index.cells(index.indexed_peaks(flat)).collect()}
    assert {(r["win_key"], r["block"]): (r["n_peaks"], r["n_bins"]) for r in cells.all_cells(spark, to, checkpoint).collect()} == batch


def test_replay_of_a_batch(spark, tmp_path):
    """A batch that was planned but not finished is read again, whole, before the stream goes on."""
    data = run(spark, 100, str(tmp_path / "w"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.mzML").write_bytes(data)
    seen, failed = str(tmp_path / "seen"), []

    def write(batch, i):
        if i == 1 and not failed:
            failed.append(i)
            raise RuntimeError("lost")
        batch.write.mode("overwrite").parquet(f"{seen}/batch={i}")

    start = lambda: ranges.stream_ranges(spark, str(tmp_path / "in"), 30_000, 9_000).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        cells.drain(start())
    except Exception:
        pass
    assert failed
    cells.drain(start())
    assert plain(spark.read.parquet(seen).collect()) == plain(mzml.read_mzml(spark, str(tmp_path / "in" / "a.mzML")).collect())
