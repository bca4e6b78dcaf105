"""Spectra of mzML files by ranges of bytes: a large run is read by many tasks, or streamed in many batches."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from peakloom.sources.mzml import SCHEMA, decoded

OPEN, CLOSE = re.compile(rb"<spectrum[\s>]"), b"</spectrum>"
BLOCK, TAIL = 1 << 20, 16  # bytes read at a time; bytes kept so that no tag is lost between two reads


def files(path: str) -> list[tuple[str, int]]:
    """Path and size of a file, or of those in a folder and below, by name; hidden ones are left out, as Spark does."""
    system, at = _at(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    inside = lambda f: os.path.relpath(f.path, at).split("/") if f.path != at else [f.base_name]
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not any(n[0] in "._" and n != "." for n in inside(f)))


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"file:/[^/]", path):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def elements(file: BinaryIO, low: int, high: int) -> Iterator[tuple[int, bytes]]:
    """(position, element) of each spectrum whose tag begins at ``low`` or after it and before ``high``; the last is read to its
    end beyond ``high``. One that is never closed is left out, as is one closed by its own tag, which holds nothing."""
    file.seek(low)
    held, at = b"", low  # ``held`` begins at byte ``at``
    while block := file.read(BLOCK):
        held, start = held + block, 0
        while (close := held.find(CLOSE, start)) >= 0:
            opened = [m.start() for m in OPEN.finditer(held, start, close)]
            if opened and at + opened[-1] < high:
                yield at + opened[-1], held[opened[-1] : close + len(CLOSE)]
            start = close + len(CLOSE)
            if at + start >= high:
                return
        pending = OPEN.search(held, start)
        start = pending.start() if pending else max(start, len(held) - TAIL)
        held, at = held[start:], at + start
        if at >= high:
            return


def boundary(file: BinaryIO, low: int, want: int, size: int) -> int:
    """The end of the last spectrum that closes between ``low`` and ``want``; if none does, of the first after it; if there is
    none, ``low``."""
    end, after = want, b""
    while end > low:
        begin = max(low, end - BLOCK)
        file.seek(begin)
        block = file.read(end - begin) + after
        if (found := block.rfind(CLOSE)) >= 0:
            return begin + found + len(CLOSE)
        end, after = begin, block[:TAIL]
    at = max(low, want - TAIL)
    file.seek(at)
    held = b""
    while at + len(held) < size and (block := file.read(min(BLOCK, size - at - len(held)))):
        held += block
        if (found := held.find(CLOSE)) >= 0:
            return at + found + len(CLOSE)
        at, held = at + max(0, len(held) - TAIL), held[-TAIL:]
    return low


@dataclass
class Range(InputPartition):
    run: str
    low: int
    high: int


def _read(path: str, part: Range) -> Iterator[tuple[str, int, str]]:
    with _at(path)[0].open_input_file(part.run) as file:
        for position, element in elements(file, part.low, part.high):
            yield part.run, position, element.decode()


def _ranges(run: str, low: int, high: int, step: int) -> list[Range]:
    return [Range(run, a, min(a + step, high)) for a in range(low, high, step)]


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.step = options["path"], int(options.get("rangebytes", 32 << 20))

    def partitions(self) -> list[Range]:
        return [r for run, size in files(self.path) for r in _ranges(run, 0, size, self.step)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple[str, int, str]]:
        return _read(self.path, part) if part.run else iter(())


class RangeStream(DataSourceStreamReader):
    """Offsets are, for each file begun, the byte behind the last spectrum taken. A batch takes ``batchBytes`` more, files by
    name, and ends where a spectrum ends, so a file may still grow: a spectrum without its end waits. The driver reads no more
    than the bytes around that end. Spark tells a restarted reader where it stood by asking for the empty range there."""

    def __init__(self, options: dict[str, str]):
        self.path, self.step, self.most = options["path"], int(options.get("rangebytes", 32 << 20)), int(options.get("batchbytes", 256 << 20))
        self.stood: dict[str, int] = {}
        self.barren: dict[str, tuple[int, int]] = {}  # files that held no further spectrum, with position and size then

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        to, left = dict(self.stood), self.most
        for run, size in files(self.path):
            low = to.get(run, 0)
            if left <= 0 or low >= size or self.barren.get(run) == (low, size):
                continue
            with _at(self.path)[0].open_input_file(run) as file:
                high = boundary(file, low, min(size, low + left), size)
            if high > low:
                to[run], left = high, left - (high - low)
            else:
                self.barren[run] = low, size
        return to

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.stood = dict(end)
        return [r for run, high in sorted(end.items()) for r in _ranges(run, start.get(run, 0), high, self.step)]

    def read(self, part: Range) -> Iterator[tuple[str, int, str]]:
        return _read(self.path, part)


class SpectrumSource(DataSource):
    """``format("mzml_ranges")``: (run, position, element), batch or stream. Options: ``rangeBytes`` a task, ``batchBytes`` a
    batch of the stream."""

    @classmethod
    def name(cls) -> str:
        return "mzml_ranges"

    def schema(self) -> str:
        return "run string, position bigint, element string"

    def reader(self, schema: StructType) -> RangeReader:
        return RangeReader(self.options)

    def streamReader(self, schema: StructType) -> RangeStream:
        return RangeStream(self.options)


def _parsed(found: DataFrame) -> DataFrame:
    return decoded(found.select("run", F.from_xml("element", SCHEMA).alias("s")).select("run", "s.*"))


def read_ranges(spark: SparkSession, path: str, range_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``mzml.read_mzml``, a file read by as many tasks as it has ranges of ``range_bytes``. The path is a file or a
    folder that every executor reaches, local or by a URI that Arrow opens; ``run`` is the path within it. An empty folder or
    file has no rows."""
    spark.dataSource.register(SpectrumSource)
    return _parsed(spark.read.format("mzml_ranges").option("rangeBytes", range_bytes).load(path))


def stream_ranges(spark: SparkSession, path: str, batch_bytes: int = 256 << 20, range_bytes: int = 32 << 20) -> DataFrame:
    """The same rows as a stream that goes through each file in order, ``batch_bytes`` at a time. A restart goes on within the
    file. The offsets hold an entry for each file, so for many small files ``mzml.stream_mzml`` is the better reader. Run it
    with a trigger by time and ``drain``; Spark's ``availableNow`` takes one batch from such a source."""
    spark.dataSource.register(SpectrumSource)
    return _parsed(spark.readStream.format("mzml_ranges").option("batchBytes", batch_bytes).option("rangeBytes", range_bytes).load(path))
