"""Media columns: lossless samples, content-defined chunks stored once, and media put together from ordered chunk lists."""

from __future__ import annotations

import struct
import zlib
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.common import documents, has_prefix, map_batches, prefix_bits, utf8
from peakloom.operators.graph import lookup
from peakloom.plans.durable import durable_table

#: Samples of a frame; a payload is a positive multiple of it.
FRAME = 192
#: Sizes of a chunk in bytes: at least, about (a power of two) and at most.
LEAST, ABOUT, MOST = 512, 2048, 8192
RATE = 8000
#: The gear table: 32-bit values of byte values, from a fixed generator.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
CHUNK = "array<struct<digest:binary,size:int,data:binary>>"


def payload_of(text: bytes) -> bytes:
    """The text with spaces up to a positive multiple of ``FRAME`` bytes."""
    return text.ljust(max(FRAME, -(-len(text) // FRAME) * FRAME), b" ")


def wave_header(n: int, rate: int = RATE) -> bytes:
    """Header of a WAVE file of ``n`` unsigned 8-bit samples, one channel. ``n`` is even, so no pad byte follows."""
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n)


def read_wave(media: bytes) -> bytes:
    """The samples of a file as ``wave_header`` begins it."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or struct.unpack("<HH", media[20:24]) != (1, 1) or struct.unpack("<H", media[34:36]) != (8,):
        raise ValueError("not a WAVE file of 8-bit samples in one channel")
    n = struct.unpack("<I", media[40:44])[0]
    if len(media) != 44 + n:
        raise ValueError("the file is cut short")
    return media[44:]


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: where the gear hash of the last 32 bytes has its top bits zero, within the sizes' bounds."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h = GEAR[np.frombuffer(data, np.uint8)]
    span = 1
    while span < 32:
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    able = np.flatnonzero(h < np.uint32((1 << 32) // ABOUT)) + 1
    ends, at, i = [], 0, 0
    while n - at > LEAST:
        i = int(np.searchsorted(able, at + LEAST))
        end = int(able[i]) if i < len(able) else n
        at = min(end, at + MOST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def features(samples: bytes) -> str:
    """Mean, root mean square, zero crossings, and the share of energy in four bands of the frames' spectra."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64) - 128
    frames = x.reshape(-1, FRAME)
    power = (np.abs(np.fft.rfft(frames, axis=1)) ** 2).sum(axis=0)[1:]
    bands = np.array([b.sum() for b in np.array_split(power, 4)])
    share = bands / (bands.sum() or 1.0)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return ";".join([f"mean={x.mean():.3f}", f"rms={np.sqrt((x * x).mean()):.3f}", f"crossings={crossings}", "bands=" + ",".join(f"{b:.4f}" for b in share)])


def _digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def _pieces(text: bytes) -> list[bytes]:
    data, at, out = payload_of(text), 0, []
    for end in cuts(data):
        out.append(data[at:end])
        at = end
    return out


def chunk_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document ``key`` (digest of the text), ``n_bytes`` and ``digests``, its payload's chunks in order: narrow."""
    kind = docs.schema[id_col].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column(1))
        digests = pa.array([[_digest(x) for x in _pieces(t)] for t in texts], pa.list_(pa.binary()))
        return pa.record_batch([batch.column(0), pa.array([_digest(t) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), digests], names=[id_col, "key", "n_bytes", "digests"])

    return map_batches(docs.select(id_col, text_col), step, f"{id_col} {kind}, key binary, n_bytes bigint, digests array<binary>")


def chunked(docs: DataFrame, bits: np.ndarray, flagged: bool, text_col: str = "text") -> DataFrame:
    """``key``, ``head`` (the file's header) and ``chunks``, the payload as an ordered list of digest, size and compressed
    bytes, of the rows whose key is in ``bits``, or is not."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack, keys, heads, lists = zstandard.ZstdCompressor(3, write_content_size=True), [], [], []
        for text in utf8(batch.column(0)):
            key = _digest(text)
            if has_prefix(shared.value, key) != flagged:
                continue
            pieces = _pieces(text)
            keys.append(key)
            heads.append(wave_header(sum(map(len, pieces))))
            lists.append([{"digest": _digest(x), "size": len(x), "data": pack.compress(x)} for x in pieces])
        kind = pa.list_(pa.struct([("digest", pa.binary()), ("size", pa.int32()), ("data", pa.binary())]))
        return pa.record_batch([pa.array(keys, pa.binary()), pa.array(heads, pa.binary()), pa.array(lists, kind)], names=["key", "head", "chunks"])

    return map_batches(docs.select(text_col), step, f"key binary, head binary, chunks {CHUNK}")


def repeated_places(lists: DataFrame) -> DataFrame:
    """Places (``key``, ``pos``) of every chunk that stands at two places or more of distinct texts, and whether the place
    is the first by key and position, which owns the bytes; and (``key``, -1) for texts with copies.

    ``lists`` has ``key`` and ``digests``; equal rows are one text.
    """
    once = lists.groupBy("key").agg(F.first("digests").alias("digests"), F.count(F.lit(1)).alias("copies"))
    used = once.select("key", F.posexplode("digests").alias("pos", "digest"))
    first = used.groupBy("digest").agg(F.min(F.struct("key", "pos")).alias("low"), F.max(F.struct("key", "pos")).alias("high")).where("low <> high")
    places = used.join(first, "digest").select("key", "pos", (F.struct("key", "pos") == F.col("low")).alias("own"))
    return places.union(once.where("copies > 1").select("key", F.lit(-1), F.lit(False)))


def deduplicated(media: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The media table, whose rows lack the bytes of repeated chunks, and the chunk table that holds those once; both are
    written to the shared folder, and read from there.

    ``media`` has ``key``, ``head`` and ``chunks``; its copies are combined before the shuffle. The chunk table has ``digest``
    and ``data`` of each repeated chunk, from the place that owns it. A chunk used once stays with its row, where no join
    is needed to read it. Lists keep every chunk's digest and size.
    """
    repeated = places.groupBy("key").agg(F.collect_set("pos").alias("out"), F.collect_set(F.when(F.col("own"), F.col("pos"))).alias("own"))
    once = media.groupBy("key").agg(F.first(F.struct("head", "chunks")).alias("r")).select("key", "r.*")
    gone = F.coalesce("out", F.array().cast("array<int>"))
    kept = F.transform("chunks", lambda c, i: F.struct(c["digest"].alias("digest"), c["size"].alias("size"), F.when(~F.array_contains(gone, i), c["data"]).alias("data")))
    owned = F.filter("chunks", lambda c, i: F.array_contains(F.coalesce("own", F.array().cast("array<int>")), i))
    known = once.join(repeated, "key", "left").select("key", "head", kept.alias("chunks"), owned.alias("owned"))
    table = durable_table(known, "media", "none")  # the bytes are compressed already
    return table.drop("owned"), durable_table(table.select(F.inline("owned")).select("digest", "data"), "chunks", "none")


def reconstructed(rows: DataFrame, store: DataFrame) -> DataFrame:
    """``rows`` with every chunk's bytes in its list again, fetched from the store by digest."""
    lacking = rows.select("key", F.posexplode("chunks").alias("pos", "c")).where("c.data is null").select("key", "pos", F.col("c.digest").alias("digest"))
    fetched = lacking.join(store, "digest").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("pos", "data"))).alias("filled"))
    whole = F.forall("chunks", lambda c: c["data"].isNotNull())
    back = rows.where(~whole).join(fetched, "key")
    filled = back.select("key", "head", F.transform("chunks", lambda c, i: F.struct(c["digest"].alias("digest"), c["size"].alias("size"), F.coalesce(c["data"], F.try_element_at("filled", i)).alias("data"))).alias("chunks"))
    return rows.where(whole).select("key", "head", "chunks").union(filled)


def described(media: DataFrame) -> DataFrame:
    """Read each row's media from its header and chunk list: every chunk is verified by size and digest, the file is put
    together and read, and its samples are described. A chunk that is missing or differs stops the job."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack, out = zstandard.ZstdDecompressor(), []
        for head, chunks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            parts = [head]
            for c in chunks:
                part = unpack.decompress(c["data"])
                if len(part) != c["size"] or _digest(part) != c["digest"]:
                    raise ValueError("a stored chunk differs from its digest")
                parts.append(part)
            file = b"".join(parts)
            samples = read_wave(file)
            out.append((len(samples), sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(file), sha256(file).hexdigest(), features(samples), len(chunks)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
        return pa.record_batch([batch.column(0), *cols], names=["key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"])

    return map_batches(media.select("key", "head", "chunks"), step, "key binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_chunks bigint")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document its media's sizes, digests and features, read back from what was stored.

    A narrow pass finds repeated chunks; then each distinct text's file is stored, as header and ordered chunk list, and
    every repeated chunk once; then the files are put together from the stored bytes alone. Texts are UTF-8, null is
    empty and makes one frame of spaces; very long texts are cut and read whole. Equal texts are one medium, however many
    documents have them, and get equal values. Other columns are not read; an empty table gives an empty result.
    """
    source = docs.select(id_col, text_col)
    lists = durable_table(chunk_lists(source, id_col, text_col), "chunk-lists")
    places = durable_table(repeated_places(lists), "places")
    bits = prefix_bits(places)
    rows, store = deduplicated(chunked(source, bits, True, text_col), places)
    alone = durable_table(chunked(source, bits, False, text_col), "media", "none")
    found = durable_table(described(reconstructed(rows, store).union(alone)), "described")
    # A third of all documents may share one text: keys of that many are told by a broadcast.
    sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return lookup(lists.drop("digests"), found.join(sizes, "key"), "key", lists.count()).drop("key")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))
