"""Exact quantiles of groups with very many distinct values: counts by value in ranges with offsets, no group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakloom.plans.durable import durable, durable_table


def _beside(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """A join on ``by`` where null is a group like any other; without ``by``, with the one row of ``right``."""
    if not by:
        return left.join(F.broadcast(right), F.lit(True), how)
    theirs = right.withColumnsRenamed({c: f"__{c}" for c in by})
    return left.join(theirs, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], how).drop(*(f"__{c}" for c in by))


def below(cuts: Column, value: Column, most: int) -> Column:
    """How many of the ascending ``cuts``, ``most`` at most, are less than ``value``: found by halving, where a filter would look
    at every cut for every row."""
    steps = [F.lit(1 << i) for i in reversed(range(most.bit_length()))]
    return F.aggregate(F.array(*steps), F.lit(0), lambda n, s: F.when(F.get(cuts, n + s - 1) < value, n + s).otherwise(n)) if steps else F.lit(0)


def counted(df: DataFrame, by: list[str], value: str, ranges: int = 64) -> DataFrame:
    """For each distinct value of each group the number of rows ``n``, of rows ``before`` it in ascending order, and in
    ``total``. Nulls are left out. Values are cut into ``ranges`` of their group, which are summed alone and offset.

    Distinct values and cuts are kept: approximate cuts differ from one evaluation to the next, and sums and offsets must
    be of the same ranges."""
    at = durable_table(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n")), "quantile-values")
    cuts = F.percentile_approx("value", F.array(*(F.lit(i / ranges) for i in range(1, ranges))), F.lit(1000))
    bounds = durable(at.groupBy(*by).agg(cuts.alias("cuts"), F.sum("n").alias("total")))
    part = _beside(at, bounds, by).withColumn("r", below(F.col("cuts"), F.col("value"), ranges - 1)).drop("cuts")
    sums = part.groupBy(*by, "r").agg(F.sum("n").alias("rn"))
    base = sums.select(*by, "r", (F.sum("rn").over(W.partitionBy(*by).orderBy("r")) - F.col("rn")).alias("base"))
    within = F.sum("n").over(W.partitionBy(*by, "r").orderBy("value")) - F.col("n")
    return _beside(part.withColumn("within", within), base, [*by, "r"]).select(*by, "value", "n", (F.col("base") + F.col("within")).alias("before"), "total")


def medians(df: DataFrame, by: list[str], values: list[str], upper: bool = False, rows: str | None = None) -> DataFrame:
    """One row for each group: the median of each of ``values`` under its name, as double: the mean of the middle two or, if
    ``upper``, element n // 2 of the sorted values; null for a group without values of that name. ``rows`` names a column for
    the number of the group's rows.

    The columns are counted as one, by name and value, so ``df`` is computed once however many there are.
    """
    # A row without a name stands for its group, which may have no values at all.
    named = [F.struct(F.lit(v).alias("__name"), F.col(v).cast("double").alias("__value")) for v in values]
    marked = F.struct(F.lit(None).cast("string").alias("__name"), F.lit(0.0).alias("__value"))
    of = counted(df.select(*by, F.inline(F.array(*named, marked))), [*by, "__name"], "__value")
    holds = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("n"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    ends = of.where(holds(low) | holds(high)).groupBy(*by, "__name").agg(F.max(F.when(holds(low), F.col("value"))).alias("low"), F.max(F.when(holds(high), F.col("value"))).alias("high"), F.max("total").alias("total"))
    middle = F.col("high") if upper else (F.col("low") + F.col("high")) / 2
    each = [F.max(F.when(F.col("__name") == v, middle)).alias(v) for v in values]
    size = [F.coalesce(F.max(F.when(F.col("__name").isNull(), F.col("total"))), F.lit(0)).alias(rows)] if rows else []
    return ends.groupBy(*by).agg(*each, *size)


def at_or_better(df: DataFrame, by: list[str], value: str, sums: dict[str, Column], ranges: int = 64, strictly: bool = False) -> DataFrame:
    """For each distinct ``value`` of each group, ``sums`` over the group's rows of that value or a higher one, ``strictly``: of a higher one only. Rows with a
    null value are left out. Distinct values are summed first; these are cut into ``ranges`` of their group, each summed alone
    and offset by the ranges above it. Values and cuts are kept, as in ``counted``."""
    names = list(sums)
    at = durable_table(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(*(F.sum(c).alias(n) for n, c in sums.items())), "quantile-values")
    cuts = F.percentile_approx("value", F.array(*(F.lit(i / ranges) for i in range(1, ranges))), F.lit(1000)) if ranges > 1 else F.array().cast("array<double>")
    part = _beside(at, durable(at.groupBy(*by).agg(cuts.alias("cuts"))), by).withColumn("r", below(F.col("cuts"), F.col("value"), ranges - 1)).drop("cuts")
    each = part.groupBy(*by, "r").agg(*(F.sum(n).alias(n) for n in names))
    above = W.partitionBy(*by).orderBy(F.desc("r")).rowsBetween(W.unboundedPreceding, -1)
    base = each.select(*by, "r", *(F.coalesce(F.sum(n).over(above), F.lit(0)).alias(f"__{n}") for n in names))
    within = W.partitionBy(*by, "r").orderBy(F.desc("value"))
    run = part.select(*by, "r", "value", *((F.sum(n).over(within) - (F.col(n) if strictly else 0)).alias(n) for n in names))
    return _beside(run, base, [*by, "r"]).select(*by, "value", *((F.col(n) + F.col(f"__{n}")).alias(n) for n in names))


def least_passing(df: DataFrame, by: list[str], value: str, bad: Column, good: Column, rate: float, ranges: int = 64) -> DataFrame:
    """For each group the ``least`` value at which ``bad``, summed over the group's rows of that value or a higher one, is at most
    ``rate`` times ``good`` summed likewise; no row for a group without one. Rows with a null value are left out. Groups are
    few, the summed numbers whole and not negative, and ``df`` is kept: it is read three times.

    Ranges of values are summed first. Gone through value by value are those alone that may hold one that passes (by what is
    above them and their own good rows), down to the lowest whose last value is known to pass.
    """
    given = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("value"), bad.cast("bigint").alias("bad"), good.cast("bigint").alias("good"))
    cuts = F.percentile_approx("value", F.array(*(F.lit(i / ranges) for i in range(1, ranges))), F.lit(1000)) if ranges > 1 else F.array().cast("array<double>")
    bounds = F.broadcast(durable(given.groupBy(*by).agg(cuts.alias("cuts"))))
    part = _beside(given, bounds, by).withColumn("r", below(F.col("cuts"), F.col("value"), ranges - 1)).drop("cuts")
    group = W.partitionBy(*by)
    above = group.orderBy(F.desc("r")).rowsBetween(W.unboundedPreceding, -1)
    sums = part.groupBy(*by, "r").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    base = sums.select(*by, "r", "bad", "good", *(F.coalesce(F.sum(n).over(above), F.lit(0)).alias(f"__{n}") for n in ("bad", "good")))
    most = F.lit(rate) * (F.col("__good") + F.col("good"))
    known = base.withColumn("__lowest", F.min(F.when(F.col("__bad") + F.col("bad") <= most, F.col("r"))).over(group))
    asked = known.where((F.col("__bad") <= most) & F.coalesce(F.col("r") <= F.col("__lowest"), F.lit(True))).select(*by, "r", "__bad", "__good")
    each = _beside(part, F.broadcast(asked), [*by, "r"]).groupBy(*by, "r", "value", "__bad", "__good").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    within = W.partitionBy(*by, "r").orderBy(F.desc("value"))
    run = each.select(*by, "value", *((F.col(f"__{n}") + F.sum(n).over(within)).alias(n) for n in ("bad", "good")))
    return run.where(F.col("bad") <= F.lit(rate) * F.col("good")).groupBy(*by).agg(F.min("value").alias("least"))
