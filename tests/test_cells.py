"""The stream with bounded state against the batch index."""

import random
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from peakloom.operators import index
from peakloom.streaming import cells

SCHEMA = "scan_index bigint, win_mz double, rt double, mz double, intensity double"


def test_bitmaps():
    bits = cells.with_bins(b"", np.array([3, 9, 9]))
    assert cells.count_bins(bits) == 2 and cells.with_bins(bits, np.array([], int)) == bits
    assert cells.with_bins(cells.with_bins(b"", np.array([40])), np.array([0])) == cells.with_bins(b"", np.array([0, 40]))


def test_stream_and_batch_are_equal(spark, tmp_path):
    """Over many batches and a restart: the same bitmaps, and no more open cells than two a window on the way."""
    rng = random.Random(1)
    rows = [(i, 400.0 + 24 * (i % 3), i * 0.4, rng.choice((rng.uniform(90, 110), 105.0)), rng.random()) for i in range(3000)]
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame(rows[:500], SCHEMA).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    for k in range(1, 6):
        to, _ = cells.run_index(stream, "t", checkpoint=checkpoint)
        assert cells.open_cells(spark, checkpoint).groupBy("win_key").count().agg(F.max("count")).first()[0] <= 2
        part = rows[500 * k : 500 * (k + 1)]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    cells.run_index(stream, "t", checkpoint=checkpoint)
    found = cells.all_cells(spark, to, checkpoint)
    got = {(r["win_key"], r["block"]): r for r in found.collect()}
    assert len(got) == found.count()
    at = index.indexed_peaks(spark.createDataFrame(rows, SCHEMA))
    want = {(r["win_key"], r["block"]): r for r in index.cells(at).collect()}
    assert set(got) == set(want)
    bins = {}
    for r in at.select("win_key", "block", "bin").distinct().collect():
        bins.setdefault((r[0], r[1]), []).append(r[2])
    for key, r in want.items():
        assert (got[key]["n_peaks"], got[key]["n_bins"]) == (r["n_peaks"], r["n_bins"]) and abs(got[key]["intensity"] - r["intensity"]) < 1e-4
        assert bytes(got[key]["bits"]) == cells.with_bins(b"", np.array(bins[key]))


def test_memory_of_a_batch(monkeypatch):
    """Ten thousand cells in one batch, in any order: no more bitmaps are held than are emitted at once."""
    taken = {}
    monkeypatch.setattr(cells, "window_key", lambda c: c)
    got = []

    class Group:
        def applyInPandasWithState(self, step, *_):
            taken["step"] = step

    class Peaks:
        def where(self, *_):
            return self

        select = dropna = groupBy = where

        def groupBy(self, *_):
            return Group()

    monkeypatch.setattr(cells, "F", type("F", (), {"col": lambda *_: _Any()}))
    monkeypatch.setattr(cells, "rt_block", lambda *_: _Any())
    monkeypatch.setattr(cells, "mz_bin", lambda *_: _Any())
    cells.closing_cells(Peaks())
    rng = np.random.default_rng(0)
    rt = rng.permutation(np.arange(40_000) * 7.5)
    bins = rng.integers(0, 80_000, 40_000)
    frames = (pd.DataFrame({"block": (rt[i : i + 1000] // 30).astype("int32"), "bin": bins[i : i + 1000].astype("int32"), "rt": rt[i : i + 1000], "intensity": 1.0}) for i in range(0, 40_000, 1000))
    state = _State()
    tracemalloc.start()
    for frame in taken["step"]((1,), frames, state):
        got.append(frame[["block", "n_peaks", "n_bins"]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found = pd.concat(got)
    assert len(found) == 9_999 and (found["n_peaks"] == 4).all() and len(state.value[1]) == 1
    want = pd.Series(bins).groupby((rt // 30).astype(int)).nunique()
    assert (found.set_index("block")["n_bins"] == want[:-1]).all()
    assert peak < 20e6  # ten thousand bitmaps have some 80 MB


class _Any:
    alias = cast = lambda self, *_: self
    __ge__ = lambda self, _: self


class _State:
    exists, value = False, None

    def update(self, value):
        self.value = value


def test_stream_without_data(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none"))
    to, checkpoint = cells.run_index(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "none")), "none", checkpoint=str(tmp_path / "state"))
    assert cells.all_cells(spark, to, checkpoint).count() == 0
