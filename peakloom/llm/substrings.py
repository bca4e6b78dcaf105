"""Removal of long byte strings that occur more than once in a corpus, by suffix arrays over anchored blocks."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.common import documents, has_prefix, map_batches, prefix_bits, utf8
from peakloom.llm.grouping import suffix_array
from peakloom.operators.graph import lookup
from peakloom.plans.durable import durable_table

#: Bytes of an anchor, a string whose hash is the least of those in a window; bytes of a suffix-array symbol.
GRAM, SYMBOL = 64, 8
_MULTIPLY = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Starts whose anchors are found at once; positions in such a segment take the low bits of a packed minimum.
_SEGMENT, _POSITION_BITS = 1 << 22, 24
#: Words of a passage's anchor; bytes of text whose words are hashed at once.
GRAM_WORDS, _PART = 8, 1 << 18


def gram_hashes(b: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of every ``length``-byte string of ``b``, by doubling."""
    base = b.astype(np.uint64) + np.uint64(1)
    h, n, power = base, 1, _MULTIPLY
    for bit in bin(length)[3:]:
        h = h[: len(h) - n] * np.uint64(power) + h[n:]
        n, power = 2 * n, power * power & _MASK
        if bit == "1":
            h = h[: len(h) - 1] * np.uint64(_MULTIPLY) + base[n : n + len(h) - 1]
            n, power = n + 1, power * _MULTIPLY & _MASK
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def least_places(h: np.ndarray, window: int) -> np.ndarray:
    """For every ``window`` neighbours of ``h`` the place of the leftmost least one, by their high bits."""
    low = (h >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS)) | np.arange(len(h), dtype=np.uint64)
    n = 1
    while 2 * n <= window:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    if n < window:
        low = np.minimum(low[: len(low) - (window - n)], low[window - n :])
    return (low & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)


def anchor_runs(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts of ``length``-byte strings that share an anchor: first start, last start, anchor's place and hash.

    A string's anchor is its leftmost ``GRAM``-byte string of least hash, so equal strings have equal anchors at equal
    distances wherever they stand.
    """
    starts, place, value = [], [], []
    window = length - GRAM + 1
    for at in range(0, max(0, len(text) - length + 1), _SEGMENT):
        b = np.frombuffer(text[at : at + _SEGMENT + length - 1], np.uint8)
        h = gram_hashes(b, GRAM)
        p = least_places(h, window)
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        starts.append(at + first)
        place.append(at + p[first])
        value.append(h[p[first]].view(np.int64))
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    s = np.concatenate(starts)
    e = np.r_[s[1:] - 1, len(text) - length]
    return s, e, np.concatenate(place), np.concatenate(value)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Words (runs of bytes other than ASCII white space): place of the first byte, 64-bit hash."""
    b = np.frombuffer(data, np.uint8)
    gap = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    first, size = edge[::2], edge[1::2] - edge[::2]
    h = np.zeros(len(first), np.uint64)
    cut = np.unique(np.r_[np.searchsorted(first, np.arange(0, len(b), _PART)), len(first)])
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        n = size[i:j]
        begin = np.cumsum(n) - n
        within = np.arange(begin[-1] + n[-1]) - np.repeat(begin, n)
        power = np.cumprod(np.full(n.max(), _MULTIPLY, np.uint64))
        h[i:j] = np.add.reduceat((b[np.repeat(first[i:j], n) + within].astype(np.uint64) + np.uint64(1)) * power[within], begin)
    return first, h


PASSAGES = pa.struct([("anchor", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])


def passage_runs(texts: list[bytes], words: int) -> tuple[pa.Array, pa.Array]:
    """Each text's number of words, and its runs of starts of strings of ``words`` words that share an anchor: its hash, first
    start and last start, counted in words. An anchor is the leftmost ``GRAM_WORDS`` words of least hash."""
    counts, sizes, found, at = [], [], [], 0
    while at < len(texts):
        to, held = at + 1, len(texts[at])
        while to < len(texts) and held + len(texts[to]) < _PART:
            held += len(texts[to])
            to += 1
        part = texts[at:to]
        first, h = word_hashes(b"\n".join(part))
        ends = np.searchsorted(first, np.cumsum([len(t) + 1 for t in part]))
        n = np.diff(ends, prepend=0)
        counts.append(n)
        many = np.zeros(len(part), np.int64)
        if len(h) >= words:
            g, window = gram_hashes(h, GRAM_WORDS), words - GRAM_WORDS + 1
            p = np.concatenate([i + least_places(g[i : i + _SEGMENT + window - 1], window) for i in range(0, len(h) - words + 1, _SEGMENT)])
            # Strings that reach into the next text are none.
            text = np.repeat(np.arange(len(part)), n)[: len(p)]
            s = np.flatnonzero(np.arange(len(p)) + words <= ends[text])
            if len(s):
                p, text = p[s], text[s]
                new = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                begin = (ends - n)[text[new]]
                many = np.bincount(text[new], minlength=len(part))
                found.append((g[p[new]].view(np.int64), s[new] - begin, s[np.r_[new[1:] - 1, len(s) - 1]] - begin))
        sizes.append(many)
        at = to
    columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PASSAGES, strict=True)], fields=list(PASSAGES))
    offsets = np.cumsum(np.concatenate([[0], *sizes]))
    return pa.array(np.concatenate([[], *counts]), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def passage_digests(data: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    """128-bit hash of each span of words (first, end), joined by single spaces."""
    parts = data.split()
    line = b" ".join(parts)
    at = np.cumsum([0, *(len(w) + 1 for w in parts)]).tolist()
    return [xxhash.xxh3_128_digest(line[at[a] : at[b] - 1]) for a, b in spans]


def repeated_starts(runs: list[tuple[bytes, int, int]], length: int) -> list[np.ndarray]:
    """For each run (its bytes, the anchor's place in them, number of starts) the starts whose ``length``-byte string
    begins at another start of these runs too.

    All strings of an anchor stand at the same distance from it, so bytes are packed into symbols of ``SYMBOL`` bytes
    counted from the anchor. Neighbours in the suffix array of the packed runs that share enough symbols are the
    candidates: their strings agree but for fewer than ``SYMBOL`` bytes on either side, which are then compared.
    """
    whole = length // SYMBOL - 1
    packed, lead = [], []
    for data, anchor, _ in runs:
        skip = anchor % SYMBOL
        n = (len(data) - skip) // SYMBOL
        packed.append(np.frombuffer(data, np.uint64, n, skip))
        lead.append(skip)
    sizes = np.array([len(x) for x in packed])
    symbols = np.unique(np.concatenate(packed), return_inverse=True)[1].astype(np.int64) + 1
    ends = np.cumsum(sizes + 1)
    begin = ends - sizes - 1
    # Each run ends with the least symbol.
    line = np.zeros(int(ends[-1]), np.int64)
    owner = np.repeat(np.arange(len(runs)), sizes + 1)
    within = np.arange(len(line)) - begin[owner]
    inside = within < sizes[owner]
    line[inside] = symbols
    order = np.array(suffix_array(line.tolist()), np.int64)
    full = order[(within + whole <= sizes[owner])[order]]
    out = [np.zeros(0, np.int64)] * len(runs)
    if len(full) < 2:
        return out
    same = np.zeros(len(full), bool)
    for a in range(0, len(full) - 1, 1 << 16):
        x, y = full[a : min(a + (1 << 16), len(full) - 1)], full[a + 1 : a + 1 + (1 << 16)]
        same[a + 1 : a + 1 + len(x)] = (line[x[:, None] + np.arange(whole)] == line[y[:, None] + np.arange(whole)]).all(axis=1)
    group = np.cumsum(~same)
    kept = np.r_[same[1:], False] | same
    full, group = full[kept], group[kept]
    if not len(full):
        return out
    buffer = np.frombuffer(b"".join(d for d, _, _ in runs), np.uint8)
    offset = np.cumsum([0, *(len(d) for d, _, _ in runs)])
    run = owner[full]
    column = np.array(lead)[run] + within[full] * SYMBOL
    many = np.array([n for _, _, n in runs])[run]
    hits_run, hits_start = [], []
    for left in range(SYMBOL):
        start = column - left
        able = np.flatnonzero((start >= 0) & (start < many))
        if len(able) < 2:
            continue
        at = offset[run[able]] + start[able]
        places = np.r_[np.arange(left), np.arange(left + whole * SYMBOL, length)]
        sides = np.ascontiguousarray(buffer[at[:, None] + places]).view(np.uint64)[:, 0]
        by = np.lexsort((sides, group[able]))
        g, v = group[able][by], sides[by]
        equal = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
        again = able[by[np.r_[False, equal] | np.r_[equal, False]]]
        hits_run.append(run[again])
        hits_start.append((column - left)[again])
    if not hits_run:
        return out
    r, s = np.concatenate(hits_run), np.concatenate(hits_start)
    by = np.lexsort((s, r))
    r, s = r[by], s[by]
    cut = np.searchsorted(r, np.arange(len(runs) + 1))
    return [s[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def intervals(starts: np.ndarray) -> list[dict[str, int]]:
    """Sorted distinct starts as inclusive intervals."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return [{"a": int(a), "b": int(b)} for a, b in zip(starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]], strict=True)]


INTERVALS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _key(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


RUN = "anchor bigint, run binary, place bigint, starts bigint, times bigint, data binary"


def find_repeats(runs: DataFrame, often: DataFrame | None, length: int, block_bytes: int = 1 << 18, group_runs: int = 2000) -> DataFrame:
    """``run`` and ``found`` (intervals of repeated starts) from runs (anchor, run, place, starts, times, data).

    ``runs`` are of anchors with at most ``group_runs`` runs each, and are dealt by anchor. ``often`` has those of all
    other anchors: they are dealt by anchor and run, so that equal ones become one with the sum of their ``times``
    wherever they are many; anchors that then have few distinct runs join the others, and the rest, which no task could
    hold, have each of their strings counted by its 128-bit hash over all tasks instead.

    Equal runs that meet are one with the sum of their ``times``; all starts of a run met more than once are repeated. A
    task joins the distinct runs of several anchors to blocks of about ``block_bytes`` and builds one suffix array for each.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids, found):
            return pa.record_batch([pa.array(ids, pa.binary()), pa.array(found, INTERVALS)], names=["run", "found"])

        def solve(block):
            starts = repeated_starts([(r[4], r[1], r[2]) for r in block], length)
            rows = [(r[0], intervals(s)) for r, s in zip(block, starts, strict=True) if len(s) and r[3] == 1]
            return [out([r for r, _ in rows], [f for _, f in rows])] if rows else []

        def copied(group):
            rows = [r for r in group if r[3] > 1]
            return [out([r[0] for r in rows], [[{"a": 0, "b": r[2] - 1}] for r in rows])] if rows else []

        anchor, group, block, size = None, [], [], 0

        def ended():
            """The anchor's group is whole."""
            nonlocal block, size
            yield from copied(group)
            if len(group) > 1:
                block += group
                size += sum(len(r[4]) for r in group)
                if size >= block_bytes:
                    yield from solve(block)
                    block, size = [], 0

        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            for a, *row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if a != anchor:
                    yield from ended()
                    anchor, group = a, []
                if group and group[-1][0] == row[0]:
                    group[-1][3] += row[3]
                else:
                    group.append(row)
        yield from ended()
        if block:
            yield from solve(block)

    def dealt(these: DataFrame) -> DataFrame:
        return these.repartition("anchor").sortWithinPartitions("anchor", "run").mapInArrow(search, "run binary, found array<struct<a:bigint,b:bigint>>")

    columns = ["anchor", "run", "place", "starts", "times", "data"]
    if often is None:
        return durable_table(dealt(runs.select(*columns)), "repeats")
    once = often.groupBy("anchor", "run").agg(F.sum("times").alias("times"), F.first(F.struct("place", "starts", "data")).alias("r")).select("anchor", "run", "r.place", "r.starts", "times", "r.data")
    once = durable_table(once, "often")
    # The anchors of ``often`` that are still crowded, with their numbers of distinct runs.
    crowds = durable_table(once.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_runs).select("anchor"), "crowds")
    searched = durable_table(dealt(runs.select(*columns).union(once.join(crowds, "anchor", "left_anti").select(*columns))), "repeats")
    crowded = once.join(crowds, "anchor", "left_semi")
    copied = crowded.where("times > 1").select("run", F.array(F.struct(F.lit(0).cast("bigint").alias("a"), (F.col("starts") - 1).alias("b"))).alias("found"))

    def strings(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs, at, digest = [], [], []
        for run, data, many in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            runs += [run] * many
            at += range(many)
            digest += [xxhash.xxh3_128_digest(data[i : i + length]) for i in range(many)]
        return pa.record_batch([pa.array(runs, pa.binary()), pa.array(at, pa.int64()), pa.array(digest, pa.binary())], names=["run", "at", "digest"])

    each = map_batches(crowded.select("run", "data", "starts"), strings, "run binary, at bigint, digest binary")
    seen = durable_table(each.groupBy("digest").agg(F.min(F.struct("run", "at")).alias("low"), F.max(F.struct("run", "at")).alias("high")).where("low <> high").select("digest"), "strings")
    again = each.join(seen, "digest", "left_semi").select("run", F.array(F.struct(F.col("at").alias("a"), F.col("at").alias("b"))).alias("found"))
    return searched.union(copied).union(again)


def shared_anchors(runs: DataFrame, place: Column, total: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Anchors met at two values of ``place`` or more with their numbers of runs ``n``, and the runs that have one."""
    shared = durable_table(runs.groupBy("anchor").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("anchor", "n"), name)
    # Anchors with over a thousandth of all runs: a thousand at most. Their runs are told by a broadcast, not dealt by anchor.
    frequent = shared.where(F.col("n") > total / 1000)
    if not frequent.take(1):
        return shared, runs.join(shared, "anchor")
    frequent = F.broadcast(frequent)
    rare = runs.join(frequent.select("anchor"), "anchor", "left_anti").join(shared.where(F.col("n") <= total / 1000), "anchor")
    return shared, rare.unionByName(runs.join(frequent, "anchor"))


def shared_words(able: DataFrame, words: int) -> DataFrame:
    """``key`` and ``n_shared_words``, the words of a text that a string of ``words`` words covers which stands in another
    text too, from texts (key, data, passages).

    Equal runs of two texts or more are shared whole. Where an anchor has others beside them, each string of one copy of its
    runs is hashed, and is shared if another text has it, or a run that several texts have.
    """

    def name(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, anchor, s, n, run = [], [], [], [], []
        for k, data, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            key += [k] * len(found)
            anchor += [r["anchor"] for r in found]
            s += [r["s"] for r in found]
            n += [r["e"] - r["s"] + 1 for r in found]
            run += passage_digests(data, [(r["s"], r["e"] + words) for r in found])
        return pa.record_batch([pa.array(x, t) for x, t in zip((key, anchor, s, n, run), (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["key", "anchor", "s", "n", "run"])

    place = F.xxhash64("key")
    source = able.where(F.size("passages") > 0)
    pieces = durable_table(map_batches(source.select("key", "data", "passages"), name, "key binary, anchor bigint, s int, n int, run binary"), "passages")
    once = durable_table(pieces.groupBy("anchor", "run").agg(F.min(F.struct("key", "s", "n")).alias("r"), (F.min(place) < F.max(place)).alias("met"), F.count(F.lit(1)).alias("n")), "passage-runs")
    mixed = once.where("not met").select("anchor").distinct()
    opened = once.join(mixed, "anchor", "left_semi").groupBy("r.key").agg(F.collect_list(F.struct("run", "met", "r.s", "r.n")).alias("opened"))

    def strings(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, run, at, digest = [], [], [], []
        for k, data, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for r in found:
                key += [k] * r["n"]
                run += [None if r["met"] else r["run"]] * r["n"]
                at += range(r["n"])
            digest += passage_digests(data, [(a, a + words) for r in found for a in range(r["s"], r["s"] + r["n"])])
        halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
        return pa.record_batch([pa.array(key, pa.binary()), pa.array(run, pa.binary()), pa.array(at, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=["key", "run", "at", "d", "e"])

    each = map_batches(source.select("key", "data").join(opened, "key").select("key", "data", "opened"), strings, "key binary, run binary, at int, d bigint, e bigint")
    # Strings of runs that several texts have come without the run.
    each = durable_table(each.select("run", "at", "d", "e", place.alias("place")), "passage-strings")
    seen = each.groupBy("d", "e").agg((F.max(F.col("run").isNull()) | (F.min("place") < F.max("place"))).alias("again")).where("again").select("d", "e")
    again = each.where("run IS NOT NULL").join(seen, ["d", "e"], "left_semi").groupBy("run").agg(F.collect_set(F.struct(F.col("at").alias("a"), F.col("at").alias("b"))).alias("found"))
    whole = once.where("met").select("run", F.array(F.struct(F.lit(0).alias("a"), (F.col("r.n") - 1).alias("b"))).alias("found"), "n")
    # A run of one text has few rows.
    found = durable_table(whole.union(again.withColumn("n", F.lit(1).cast("bigint"))), "passage-found")
    hits = lookup(pieces.select("run", "key", "s"), found, "run", pieces.count()).select("key", "s", F.explode("found").alias("f"))
    spans = hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct((F.col("s") + F.col("f.a")).alias("a"), (F.col("s") + F.col("f.b") + words).alias("b")))).alias("spans"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    step = lambda x, y: F.struct((x["n"] + y["b"] - F.greatest(x["end"], y["a"])).alias("n"), y["b"].alias("end"))
    return spans.select("key", F.aggregate("spans", start, step)["n"].alias("n_shared_words"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, block_bytes: int = 1 << 18, group_runs: int = 2000, with_text: bool = False, words: int = 0) -> DataFrame:
    """For each document ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept_sha256``; ``kept`` (the
    remaining bytes) if asked for; if ``words`` is not 0 also ``n_shared_words``, the words that a string of so many words
    covers which stands in another document too, whatever its bytes and white space. These are told, not removed.

    Every byte goes that a string of ``length`` bytes covers which also starts anywhere else, in this or another
    document, overlaps included, judged on the input. Texts are UTF-8 bytes, null is empty, matches do not cross
    documents, and repeated rows are documents of their own. Texts shorter than ``length`` stay. An empty table gives
    an empty result; other columns are not read.

    1. Every string's anchor is found (``anchor_runs``); runs of starts with one anchor go to a narrow table.
    2. Anchors that stand at one place only are dropped: minimum and maximum place by anchor, combined before the
       shuffle. All starts of the rest are candidates, with no limit. Anchors that stand in over ``group_runs`` places are
       marked; no task gets all their runs.
    3. Candidate runs get their bytes; equal runs are combined before the shuffle, so copies of a passage cost one.
    4. ``find_repeats`` decides which strings of different runs are equal.
    5. Covered bytes are put together for each distinct text, and joined with its documents.
    6. Shared words are found the same way, by anchors of words (``passage_runs``, ``shared_words``).
    """
    if length % SYMBOL or length < GRAM + 2 * SYMBOL:
        raise ValueError(f"length must be a multiple of {SYMBOL}, {GRAM + 2 * SYMBOL} at least")
    if words and words < 2 * GRAM_WORDS:
        raise ValueError(f"words must be 0, or {2 * GRAM_WORDS} at least")
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(id_col, text_col)

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column(1))
        runs = []
        for t in texts:
            s, e, p, h = anchor_runs(t, length)
            runs.append([{"anchor": a, "s": b, "e": c, "p": d} for a, b, c, d in zip(h.tolist(), s.tolist(), e.tolist(), p.tolist(), strict=True)])
        run = pa.list_(pa.struct([("anchor", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("p", pa.int32())]))
        n_words, passages = passage_runs(texts, words) if words else (pa.nulls(len(texts), pa.int64()), pa.nulls(len(texts), pa.list_(PASSAGES)))
        return pa.record_batch(
            [batch.column(0), pa.array([_key(t) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array([sha256(t).hexdigest() for t in texts]), pa.array(runs, run), n_words, passages],
            names=[id_col, "key", "n_bytes", "sha", "runs", "n_words", "passages"],
        )

    sketched = durable_table(map_batches(source, sketch, f"{id_col} {kind}, key binary, n_bytes bigint, sha string, runs array<struct<anchor:bigint,s:int,e:int,p:int>>, n_words bigint, passages array<struct<anchor:bigint,s:int,e:int>>"), "sketch")
    copies = sketched.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.max("n_bytes").alias("n"), F.max("n_words").alias("n_words"))
    runs = sketched.select("key", F.explode("runs").alias("r")).select("key", "r.*")
    place = F.xxhash64("key", "p")
    total = sketched.agg(F.sum(F.size("runs")), F.sum(F.size("passages"))).first()
    shared, told = shared_anchors(runs, place, total[0] or 0, "anchors")
    told = told.select("key", F.struct("anchor", "s", "e", "p", (F.col("n") > group_runs).alias("often")).alias("run"), F.lit(None).cast("struct<anchor:bigint,s:int,e:int>").alias("passage"))
    if words:
        passages = sketched.select("key", F.explode("passages").alias("r")).select("key", "r.*")
        met = shared_anchors(passages, F.xxhash64("key"), total[1] or 0, "passage-anchors")[1]
        told = told.union(met.select("key", F.lit(None).cast(told.schema["run"].dataType), F.struct("anchor", "s", "e")))
    candidates = durable_table(told.groupBy("key").agg(F.collect_set("run").alias("runs"), F.collect_set("passage").alias("passages")), "shared-anchors")
    bits = source.sparkSession.sparkContext.broadcast(prefix_bits(candidates))

    least = min(length, 2 * words - 1) if words else length

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(k, t) for t in utf8(batch.column(0)) if len(t) >= least for k in [_key(t)] if has_prefix(bits.value, k)]
        return pa.record_batch([pa.array([k for k, _ in rows], pa.binary()), pa.array([t for _, t in rows], pa.binary())], names=["key", "data"])

    texts = map_batches(source.select(text_col), keyed, "key binary, data binary")
    distinct = texts.groupBy("key").agg(F.first("data").alias("data"))
    able = durable_table(distinct.join(candidates, "key").join(copies, "key"), "candidates")

    def cut(batches: Iterator[pa.RecordBatch], often: bool) -> Iterator[pa.RecordBatch]:
        """Runs of anchors that stand in many places, or of the others, with their bytes; equal ones of a task are
        combined, up to a bound on what it holds."""
        held: dict[tuple, list] = {}
        size = 0

        def out():
            rows = [(*k, *v) for k, v in held.items()]
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            return pa.record_batch(cols, names=["anchor", "run", "place", "starts", "times", "data"])

        for whole in batches:
            for batch in (whole.slice(at, 200) for at in range(0, whole.num_rows, 200)):
                for data, found, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    for r in found:
                        if r["often"] != often:
                            continue
                        piece = data[r["s"] : r["e"] + length]
                        k = (r["anchor"], _key(piece), r["p"] - r["s"], r["e"] - r["s"] + 1)
                        if k in held:
                            held[k][0] += n
                        else:
                            held[k] = [n, piece]
                            size += len(piece)
                if size > 1 << 25:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    cuts = lambda often: able.select("data", "runs", "copies").mapInArrow(lambda batches: cut(batches, often), RUN)
    crowds = shared.where(F.col("n") > group_runs).take(1)
    searched = find_repeats(cuts(False), cuts(True) if crowds else None, length, block_bytes, group_runs)
    where = able.select("key", F.explode("runs").alias("r"), "data").select("key", F.col("r.s").cast("bigint").alias("s"), F.expr("substring(data, r.s + 1, r.e - r.s + {})".format(length)).alias("bytes"))

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), batch.column(1), pa.array([_key(x) for x in batch.column(2).to_pylist()], pa.binary())], names=["key", "s", "run"])

    occurrences = map_batches(where, named, "key binary, s bigint, run binary")
    hits = occurrences.join(searched, "run").select("key", F.explode("found").alias("f"), "s").select("key", F.struct((F.col("f.a") + F.col("s")).alias("a"), (F.col("f.b") + F.col("s") + length).alias("b")).alias("span"))
    spans = hits.groupBy("key").agg(F.collect_set("span").alias("spans"))

    def strip(batch: pa.RecordBatch) -> pa.RecordBatch:
        removed, count, digest, kept = [], [], [], []
        for data, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            change = np.zeros(len(data) + 1, np.int64)
            np.add.at(change, [x["a"] for x in found], 1)
            np.add.at(change, [x["b"] for x in found], -1)
            gone = np.cumsum(change[:-1]) > 0
            rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
            removed.append(int(gone.sum()))
            count.append(int((gone & ~np.r_[False, gone[:-1]]).sum()))
            digest.append(sha256(rest).hexdigest())
            kept.append(rest if with_text else None)
        return pa.record_batch([batch.column(0), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], names=["key", "n_removed", "n_spans", "kept_sha256", "kept"])

    once = able.where("copies = 1").select("key", "data").join(spans, "key").select("key", "data", "spans")
    stripped = map_batches(once, strip, "key binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    again = copies.where(f"copies > 1 and n >= {length}").select("key", F.col("n").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.lit(sha256(b"").hexdigest()).alias("kept_sha256"), F.lit(b"" if with_text else None).cast("binary").alias("kept"))
    changed = stripped.union(again)
    zero = F.lit(0).cast("bigint")
    rows, extra = sketched.drop("runs", "passages"), []
    if words:
        twins = copies.where(f"copies > 1 and n_words >= {words}").select("key", F.col("n_words").alias("n_shared_words"))
        rows = rows.join(shared_words(able, words).union(twins).groupBy("key").agg(F.max("n_shared_words").alias("n_shared_words")), "key", "left")
        extra = [F.coalesce("n_shared_words", zero).alias("n_shared_words")]
    out = rows.join(changed, "key", "left").select(id_col, "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *extra, "key", F.col("n_removed").isNotNull().alias("changed"), "kept")
    if not with_text:
        return out.drop("key", "changed", "kept")
    short = map_batches(source.select(text_col), lambda b: pa.record_batch([pa.array([_key(t) for t in utf8(b.column(0))], pa.binary()), pa.array(utf8(b.column(0)), pa.binary())], names=["key", "data"]), "key binary, data binary")
    whole = short.groupBy("key").agg(F.first("data").alias("data"))
    return out.join(whole, "key").select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["n_shared_words"] if words else []), F.when(F.col("changed"), F.col("kept")).otherwise(F.col("data")).alias("kept"))


#: Passages of over 50 words that documents share are told by ``op10_substrings``, also below its 400 bytes.
PASSAGE_WORDS = 51


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), words=PASSAGE_WORDS)
