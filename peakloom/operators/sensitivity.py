"""What a prefilter keeps: pass rates for every number of fragments asked for, stratified, beside what chance would give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.functions.binning import binomial_tail, neighbours


def hit_counts(fragments: DataFrame, occupied: DataFrame) -> DataFrame:
    """(candidate, hits) of every candidate, those without a hit too: its fragments (candidate, fragment, win_key, block, bin)
    that have an occupied bin, or one beside it, in their cell. ``occupied``: distinct (win_key, block, bin)."""
    probes = fragments.withColumn("bin", F.explode(neighbours(F.col("bin"))))
    hit = probes.join(occupied, ["win_key", "block", "bin"], "left_semi").groupBy("candidate").agg(F.count_distinct("fragment").alias("hits"))
    return fragments.select("candidate").distinct().join(hit, "candidate", "left").fillna(0, ["hits"])


def curves(candidates: DataFrame, hits: DataFrame, strata: tuple[str, ...], chance: float, fragments: int = 6) -> DataFrame:
    """(stratum, level, k, n, passed, rate, expected): of the ``n`` candidates with a stratum's ``level`` those that have ``k``
    hits or more, for every k from 1 to ``fragments``, over all candidates (stratum ``all``) and by each of ``strata``; and
    the binomial chance that k of ``fragments`` hit if each does with ``chance``. Levels are written as text; null is one.

    Candidates are counted once by (stratum, level, hits); all k follow from that small table. ``candidates``: (candidate,
    strata); each candidate has one row.
    """
    named = F.array(*(F.struct(F.lit(s).alias("stratum"), (F.col(s).cast("string") if s != "all" else F.lit("all")).alias("level")) for s in ("all", *strata)))
    counted = candidates.join(hits, "candidate").select("hits", F.inline(named)).groupBy("stratum", "level", F.least("hits", F.lit(fragments)).alias("hits")).agg(F.count(F.lit(1)).alias("n"))
    each = counted.groupBy("stratum", "level").agg(F.collect_list(F.struct("hits", "n")).alias("c"))
    more = lambda k: F.aggregate(F.filter("c", lambda x: x["hits"] >= k), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    rows = F.array(*(F.struct(F.lit(k).alias("k"), more(0).alias("n"), more(k).alias("passed"), binomial_tail(F.lit(float(chance)), k, fragments).alias("expected")) for k in range(1, fragments + 1)))
    found = each.select("stratum", "level", F.inline(rows))
    return found.select("stratum", "level", "k", "n", "passed", (F.col("passed") / F.col("n")).alias("rate"), "expected")
