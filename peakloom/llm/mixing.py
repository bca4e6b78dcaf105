"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only."""

from __future__ import annotations

from fractions import Fraction
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakloom.llm.common import documents


def whole_weights(weights: dict[str, float], slots: int) -> dict[str, int]:
    """Slots of a period for each source: at least one each, ``slots`` in all, nearest to the weights (largest remainders)."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    if len(weights) > slots:
        raise ValueError("a period needs a slot for each source")
    total = sum(map(Fraction, weights.values()))
    ideal = {s: Fraction(w) / total * slots for s, w in weights.items()}
    whole = {s: max(1, int(x)) for s, x in ideal.items()}
    over = sum(whole.values()) - slots
    # Each step changes one source; the next is the one that is furthest off then, ties by name.
    off = [((whole[s] - x) * (1 if over < 0 else -1), s) for s, x in ideal.items() if over <= 0 or whole[s] > 1]
    heapify(off)
    for _ in range(abs(over)):
        x, s = heappop(off)
        whole[s] -= 1 if over > 0 else -1
        if over < 0 or whole[s] > 1:
            heappush(off, (x + 1, s))
    return whole


def pfair_period(whole: dict[str, int]) -> list[tuple[str, int]]:
    """(source, its block of the period) for each slot of one period.

    Block j of a source with w of the period's n slots is released at floor(j n / w) and due by ceil((j + 1) n / w);
    in each slot the released block with the earliest deadline goes (ties: by name). The weights fill the period, so
    every deadline holds and after any slot each source is less than one block from its share.
    """
    n, done, order = sum(whole.values()), dict.fromkeys(whole, 0), []
    ready: list[tuple[int, str]] = []
    waiting = [(0, s) for s in sorted(whole)]  # by release; both are heaps, so a slot costs the log of the sources
    for t in range(n):
        while waiting and waiting[0][0] <= t:
            _, s = heappop(waiting)
            heappush(ready, (-(-(done[s] + 1) * n // whole[s]), s))
        due, s = heappop(ready)
        if due <= t:
            raise AssertionError("a deadline was missed")
        order.append((s, done[s]))
        done[s] += 1
        if done[s] < whole[s]:
            heappush(waiting, (done[s] * n // whole[s], s))
    return order


def tempered_weights(docs: DataFrame, source_col: str = "source", power: float = 0.5) -> dict[str, float]:
    """Each source's row count to a power below one: large sources are taken less often than they are large.

    The result has one entry for each source; a null source is the source ``''``.
    """
    counts = docs.groupBy(F.coalesce(source_col, F.lit("")).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["s"]: float(r["n"]) ** power for r in counts}


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = 16, slots: int = 1024, rows_per_bucket: int = 4096, most_sources: int = 100_000) -> DataFrame:
    """``docs`` with ``mix_block`` (number of the row's block in its source), ``mix_slot`` and ``mix_position``: the order
    by ``mix_position`` interleaves blocks of ``block_rows`` rows so that, as long as no source has run out, each
    source's blocks stay less than one block from its weight. No row is dropped or repeated: when a source runs out
    its slots stay empty and the others go on.

    Weights are rounded to whole ``slots`` of a period (one at least for each source); sources missing from
    ``weights`` and null sources, as ``''``, raise the period by one slot each. The period is a table of one row for each
    slot; more than ``most_sources`` sources are refused, so its size is bounded (map hosts and the like to groups first).

    Rows are numbered in their source by a hash of their id in two steps, within buckets and over the buckets' counts,
    so that a source with most rows is never in one task. Rows that share an id, or have none, follow a hash of the whole
    row; where they overfill a bucket that hash also splits it. Only rows that are equal in every column cannot be told
    apart and stay in one task; which of them comes first makes no difference. Columns of ``docs`` named like the three
    added ones are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("mix_block", "mix_slot", "mix_position")
    source = F.coalesce(F.col(source_col), F.lit(""))
    present = {r["s"]: r["n"] for r in docs.groupBy(source.alias("s")).agg(F.count(F.lit(1)).alias("n")).limit(most_sources + 1).collect()}
    if len(present) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    if weights is None:
        weights = {s: float(n) ** 0.5 for s, n in present.items()}
    known = {s: w for s, w in weights.items() if s in present}
    whole = whole_weights(known, max(slots, len(known))) if known else {}
    whole |= {s: 1 for s in sorted(present) if s not in known}
    spark, period = docs.sparkSession, pfair_period(whole) if whole else []
    n = max(1, len(period))
    table = spark.createDataFrame([(s, k, t, whole[s]) for t, (s, k) in enumerate(period)], "s string, k bigint, at bigint, w bigint")
    buckets = max(1, -(-sum(present.values()) // rows_per_bucket))
    h = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    # Buckets are ranges of the hash, so numbers run on from one to the next.
    bucket = F.shiftright(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") * buckets, 32)
    counts = docs.groupBy(source.alias("s"), bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    crowded = counts.where(F.col("n") > 4 * rows_per_bucket)
    # Distinct ids never fill a bucket four times over; repeated ones do.
    told = F.xxhash64(*(F.col(f"row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind))
    most = crowded.agg(F.max("n")).first()[0]
    keyed = docs.select(F.struct("*").alias("row"), source.alias("s"), h.alias("h"), F.col(id_col).alias("id"), bucket.alias("b"))
    if most:
        part = F.pmod(told, F.lit(-(-most // rows_per_bucket)))
        keyed = keyed.join(crowded.select("s", "b", F.lit(True).alias("full")), ["s", "b"], "left").withColumn("c", F.when(F.col("full"), part).otherwise(F.lit(0)))
    else:
        keyed = keyed.withColumn("c", F.lit(0).cast("bigint"))
    sizes = keyed.groupBy("s", "b", "c").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("s", "b", "c", (F.sum("n").over(W.partitionBy("s").orderBy("b", "c")) - F.col("n")).alias("before"))
    within = keyed.withColumn("r", F.row_number().over(W.partitionBy("s", "b", "c").orderBy("h", "id", told)) - 1)
    placed = within.join(before, ["s", "b", "c"]).withColumn("i", F.col("before") + F.col("r"))
    w_of = table.groupBy("s").agg(F.max("w").alias("w"))
    # Both tables hold a row for each slot of the period at most.
    placed = placed.withColumn("block", F.floor(F.col("i") / block_rows)).join(F.broadcast(w_of), "s").withColumn("k", F.col("block") % F.col("w"))
    placed = placed.join(F.broadcast(table.drop("w")), ["s", "k"])
    slot = F.floor(F.col("block") / F.col("w")) * n + F.col("at")
    return placed.select("row.*", F.col("block").alias("mix_block"), slot.alias("mix_slot"), (slot * block_rows + F.col("i") % block_rows).alias("mix_position"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source")
    return mix(docs)
