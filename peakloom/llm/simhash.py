"""Near-duplicate documents by SimHash: pigeonhole blocks, joins on blocks, Hamming verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.common import documents, map_batches, utf8
from peakloom.operators.graph import connected_components, lookup
from peakloom.plans.durable import durable

BITS = 64
#: For each value of a byte its bits, lowest first: counts of byte values times this are counts of bits.
OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit integer; see ``fingerprints``."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = [*accumulate(map(len, tokens), lambda a, n: a + 1 + n)]
    k = min(words, len(tokens))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :], strict=False)), np.uint64, len(tokens) - k + 1)
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    set_in = np.concatenate([np.bincount(lanes[:, i], minlength=256) @ OF_BYTE for i in range(8)])
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the ``carry`` columns and ``fp`` (signed 64-bit SimHash) of every document.

    A-Z are lower-cased, words are runs free of ASCII white space, shingles are ``words`` words joined by one space,
    repeats included; fewer words make one shingle, none (null or empty text) the fingerprint zero. A bit is 1 if it
    is set in over half of the shingles' XXH64 values.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t, words, seed) for t in utf8(batch.column(0))), np.int64, batch.num_rows)
        return pa.record_batch([*batch.columns[1:], pa.array(fps)], names=[*kept, "fp"])

    kept = [id_col, *carry]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return map_batches(docs.select(text_col, *kept), step, f"{kinds}, fp bigint")


def block_masks(max_distance: int, blocks: int) -> list[int]:
    """Bit masks of every choice of ``blocks - max_distance`` blocks: two fingerprints that differ in at most
    ``max_distance`` bits agree on all bits of at least one mask, as the differing bits touch at most that many blocks."""
    if not max_distance < blocks <= BITS:
        raise ValueError("more blocks than differing bits are needed, at most 64")
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    each = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(each, blocks - max_distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _spanning(fps: np.ndarray, max_distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Star edges (member, root) of the components of ``fps`` under the distance; each member is compared only with
    those that no component has taken yet."""
    left, u, v = fps.view(np.uint64), [], []
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= max_distance
            if near.any():
                found, left = left[near], left[~near]
                u.append(found.view(np.int64))
                v.append(np.full(len(found), root).view(np.int64))
                queue.extend(found)
    return u, v


def block_links(fps: DataFrame, max_distance: int = 4, blocks: int = 7, bucket_rows: int = 20_000) -> DataFrame:
    """Edges ``(u, v)`` between distinct fingerprints ``fp`` that connect exactly what links of at most
    ``max_distance`` bits connect.

    Every fingerprint is sent to one bucket for each mask of ``block_masks``; buckets are dealt by key and verified in
    numpy, giving a spanning forest in place of all pairs. A bucket of more than ``bucket_rows`` fingerprints is not
    held in one task: its members are linked through shared midpoints (every fingerprint within half the distance),
    a grouping that is linear in them and finds the same components.
    """
    masks = F.array(*(F.lit(_signed(m)) for m in block_masks(max_distance, blocks)))
    keyed = fps.select("fp", F.explode(F.transform(masks, lambda m: F.xxhash64(m, F.col("fp").bitwiseAND(m)))).alias("key"))
    dealt = keyed.repartition("key").sortWithinPartitions("key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key0, held, hot = None, np.empty(0, np.int64), False

        def out(u, v, is_hot):
            return pa.record_batch([pa.array(u), pa.array(v), pa.array(np.full(len(u), is_hot))], names=["u", "v", "hot"])

        def run(members):
            u, v = _spanning(members, max_distance)
            return [out(np.concatenate(u), np.concatenate(v), False)] if u else []

        for batch in batches:
            fp, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
            sizes = np.diff(np.r_[cuts, len(key)]) if len(key) else []
            final = len(cuts) - 1
            for i in np.unique(np.r_[np.flatnonzero(np.asarray(sizes) > 1), [0, final] if final >= 0 else []]).astype(int):
                at, n, last = cuts[i], sizes[i], i == final
                if key0 is not None and key[at] != key0 and (len(held) > 1 and not hot):
                    yield from run(held)
                if key0 is None or key[at] != key0:
                    if n == 1 and not last:
                        key0, held, hot = None, np.empty(0, np.int64), False
                        continue
                    key0, held, hot = key[at], np.empty(0, np.int64), False
                held = np.concatenate([held, fp[at : at + n]])
                if hot or len(held) > bucket_rows:
                    yield out(held, held, True)
                    held, hot = np.empty(0, np.int64), True
        if len(held) > 1 and not hot:
            yield from run(held)

    found = durable(dealt.mapInArrow(verify, "u bigint, v bigint, hot boolean"))
    crowded = found.where("hot").select(F.col("u").alias("fp")).distinct()
    flips = [0, *(1 << i for i in range(BITS)), *((1 << i) | (1 << j) for i, j in combinations(range(BITS), 2))]
    flips = [f for f in flips if f.bit_count() <= (max_distance + 1) // 2]
    if max_distance > 4:
        raise ValueError("midpoints are written out for distances up to 4")
    table = fps.sparkSession.createDataFrame([([_signed(f) for f in flips],)], "flips array<bigint>") if max_distance else None
    links = found.where("not hot").select("u", "v").distinct()
    if table is None or not crowded.take(1):
        return links
    through = crowded.join(F.broadcast(table)).select("fp", F.explode("flips").alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"), F.bit_count("flip").alias("far"))
    least = through.groupBy("mid").agg(F.min_by("fp", F.struct("far", "fp")).alias("root"), F.min("far").alias("near"))
    via = through.join(least, "mid").where((F.col("fp") != F.col("root")) & (F.col("far") + F.col("near") <= max_distance))
    return links.union(via.select(F.col("fp").alias("u"), F.col("root").alias("v")).distinct()).distinct()


def grouped(docs: DataFrame, id_col: str, text_col: str, words: int, max_distance: int, blocks: int, bucket_rows: int, carry: tuple[str, ...]) -> DataFrame:
    """``id_col``, ``carry``, ``fp``, ``component_id`` and ``group_fp``, a fingerprint that the rows of a group share."""
    each = durable(fingerprints(docs, id_col, text_col, words, carry=carry))
    first = durable(each.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n")))
    rows = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = connected_components(block_links(first.select("fp"), max_distance, blocks, bucket_rows))
    of = durable(found.select(F.col("node").alias("fp"), "component").join(first.drop("n"), "fp"))
    group = of.groupBy("component").agg(F.min("first_id").alias("group_id"), F.count(F.lit(1)).alias("n"))
    linked = lookup(of, group, "component", rows).select("fp", "group_id", "component")
    ids = first.join(linked, "fp", "left").select("fp", F.when(F.col("component").isNull(), F.col("first_id")).otherwise(F.col("group_id")).alias("component_id"), F.coalesce("component", "fp").alias("group_fp"), "n")
    return lookup(each, durable(ids), "fp", rows).select(id_col, *carry, "fp", "component_id", "group_fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_distance: int = 4, blocks: int = 7, bucket_rows: int = 20_000) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id``: the least id reachable over links of at most ``max_distance`` bits.

    Null ids are kept and never represent a group unless it has no other. Null and empty texts have the fingerprint
    zero and link like any other. Repeated rows have one fingerprint and one group; each is returned. Very long texts
    are hashed whole. An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    return grouped(docs, id_col, text_col, words, max_distance, blocks, bucket_rows, ()).drop("group_fp")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, max_distance: int = 4, blocks: int = 7, bucket_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that stay when one of each group of near-duplicates does: the one with the least id and, of rows
    that share it, the one with the least hash over its columns.

    Only ids and hashes move until the rows are known; texts move once. Rows equal in every column are one. A row without
    id stays only if its group has no other. Columns of any name are carried; null and empty texts are one group; an
    empty table gives an empty result.
    """
    told = F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind))
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), told.alias("told"))
    groups = grouped(keyed.drop("row"), "id", "text", words, max_distance, blocks, bucket_rows, ("told",))
    equal = groups.groupBy("group_fp", "id", "told").agg(F.count(F.lit(1)).alias("n"))
    best = equal.groupBy("group_fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "told", "n")).alias("r"))
    stay = durable(best.select(F.col("r.id").alias("best_id"), F.col("r.told").alias("best_told"), "r.n"))
    rows = keyed.drop("text")
    same = (F.col("told") == F.col("best_told")) & F.col("id").eqNullSafe(F.col("best_id"))
    once = rows.join(stay.where("n = 1"), same, "left_semi").select("row.*")
    if not stay.where("n > 1").take(1):
        return once
    again = rows.join(stay.where("n > 1"), same, "left_semi").dropDuplicates(["told", "id"]).select("row.*")
    return once.union(again)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
