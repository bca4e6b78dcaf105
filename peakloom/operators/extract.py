"""Extraction of candidates: gathered peaks as traces, peak groups picked from them, and a score vector for each peak group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions.arrays import let, total
from peakloom.functions.scoring import normalized_manhattan, rmsd, spectral_angle, standardize, xcorr_max, xcorr_post

#: Weights of the smoothing, from the middle on: the same on either side.
SMOOTHING = (6.0, 4.0, 1.0)
#: The sub-scores of a peak group, in order.
SCORES = ("coelution", "shape", "library_angle", "library_manhattan", "library_rmsd", "log_intensity", "width")


def alike(transitions: DataFrame, by: tuple[str, ...], group: str = "group", fragment: str = "fragment") -> DataFrame:
    """(``group``, ``of``): the least candidate that asks the same, which is fragments equal in name and in all of ``by``.
    Such candidates have the same traces, peak groups and scores, so that one of them is extracted for all."""
    asked = transitions.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(fragment, *by))).alias("asked"))
    first = asked.groupBy("asked").agg(F.min(group).alias("of"))
    return asked.join(first, "asked").select(group, "of")


def summed_points(peaks: DataFrame) -> DataFrame:
    """Peaks of one window, point and mass added up (``scan_index``: the least): what an extraction of traces needs of a run.
    However often a point was measured, a transition meets it once for each mass."""
    able = peaks.where("rt IS NOT NULL AND intensity IS NOT NULL")
    return able.groupBy("win_mz", "rt", "mz").agg(F.min("scan_index").alias("scan_index"), F.sum(F.col("intensity").cast("double")).alias("intensity"))


def matrices(gathered: DataFrame, library: DataFrame, group: str = "group", fragment: str = "fragment") -> DataFrame:
    """For each candidate with a peak: ``points``, its common retention-time points in order, and ``fragments``, its library
    fragments in order of name, each with its library ``intensity`` and its ``trace`` on those points. A point that a
    fragment lacks is 0, several peaks add up, and a fragment without peaks has a trace of zeros.

    ``gathered``: (group, fragment, rt, intensity), as ``index.gather`` gives it; ``library``: (group, fragment, intensity),
    each fragment once. Rows are dealt by candidate once; a candidate has as many as its window of retention time holds.
    """
    name = [F.col(group).alias("group"), F.col(fragment).alias("fragment")]
    peaks = gathered.select(*name, "rt", F.col("intensity").cast("double").alias("i")).where("rt IS NOT NULL AND i IS NOT NULL").repartition("group")
    summed = peaks.groupBy("group", "fragment", "rt").agg(F.sum("i").alias("i"))
    series = summed.groupBy("group", "fragment").agg(F.map_from_entries(F.collect_list(F.struct("rt", "i"))).alias("at"))
    points = summed.groupBy("group").agg(F.array_sort(F.collect_set("rt")).alias("points"))
    listed = library.select(*name, F.col("intensity").cast("double").alias("intensity")).repartition("group")
    whole = listed.join(series, ["group", "fragment"], "left").join(points, "group")
    trace = F.transform("points", lambda t: F.coalesce(F.try_element_at("at", t), F.lit(0.0)))
    made = whole.select("group", "points", F.struct("fragment", "intensity", trace.alias("trace")).alias("f"))
    return made.groupBy("group").agg(F.first("points").alias("points"), F.array_sort(F.collect_list("f")).alias("fragments")).withColumnRenamed("group", group)


def smoothed(x: Column, weights: tuple[float, ...] = SMOOTHING) -> Column:
    """Weighted mean of each point and those beside it; beyond the ends there are none, and the rest weigh for them."""
    reach = len(weights) - 1

    def at(i: Column) -> Column:
        near = [(F.get(x, i + d), F.when((i + d >= 0) & (i + d < F.size(x)), F.lit(weights[abs(d)])).otherwise(F.lit(0.0))) for d in range(-reach, reach + 1)]
        up = sum((F.coalesce(v, F.lit(0.0)) * w for v, w in near), F.lit(0.0))
        return up / sum((w for _, w in near), F.lit(0.0))

    return F.transform(x, lambda _, i: at(i))


def peaks(x: Column) -> Column:
    """The peaks of a smooth trace in one pass: (left, apex, right, height), from the valley before an apex to the one behind
    it; the first of equal points is the apex. Stretches without a value above 0 hold no peak."""
    kind = "struct<left:int,apex:int,right:int,height:double>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("found"), F.lit(0).alias("i"), F.lit(0).alias("left"), F.lit(0).alias("apex"), F.lit(0.0).alias("height"), F.lit(0.0).alias("before"), F.lit(False).alias("falling"))

    def closed(s: Column, right: Column) -> Column:
        one = F.struct(s["left"].alias("left"), s["apex"].alias("apex"), right.alias("right"), s["height"].alias("height"))
        return F.when(s["height"] > 0, F.concat(s["found"], F.array(one))).otherwise(s["found"])

    def step(s: Column, v: Column) -> Column:
        valley, higher = s["falling"] & (v > s["before"]), ~s["falling"] & (v > s["height"])
        return F.struct(
            F.when(valley, closed(s, s["i"] - 1)).otherwise(s["found"]).alias("found"), (s["i"] + 1).alias("i"), F.when(valley, s["i"] - 1).otherwise(s["left"]).alias("left"),
            F.when(valley | higher, s["i"]).otherwise(s["apex"]).alias("apex"), F.when(valley | higher, v).otherwise(s["height"]).alias("height"), v.alias("before"), (~valley & (s["falling"] | (v < s["before"]))).alias("falling"),
        )

    return F.aggregate(x, start, step, lambda s: closed(s, s["i"] - 1))


def pick(traces: DataFrame, fraction: float = 0.05, weights: tuple[float, ...] = SMOOTHING) -> DataFrame:
    """A row for each peak group of each candidate, numbered from the highest (``peak``, ties by place): ``left``, ``apex`` and
    ``right`` are places among the points. Groups are the peaks of the smoothed sum of all traces, cut to where it is at
    least ``fraction`` of the apex, so that the fragments of a group share its bounds."""
    joint = F.aggregate(F.col("fragments.trace"), F.transform("points", lambda _: F.lit(0.0)), lambda a, t: F.zip_with(a, t, lambda v, w: v + w))
    bare = traces.withColumn("joint", joint).withColumn("smooth", smoothed(F.col("joint"), weights))
    ranked = F.array_sort(F.transform(peaks(F.col("smooth")), lambda p: F.struct((-p["height"]).alias("down"), p["apex"].alias("apex"), p["left"].alias("left"), p["right"].alias("right"))))
    each = bare.select(*traces.columns, "smooth", F.posexplode(ranked).alias("peak", "p"))
    inside = F.filter(F.sequence(F.col("p.left"), F.col("p.right")), lambda j: F.get("smooth", j) >= -F.col("p.down") * fraction)
    placed = each.withColumn("__in", inside)
    return placed.select(*traces.columns, "peak", F.array_min("__in").alias("left"), F.col("p.apex").alias("apex"), F.array_max("__in").alias("right"), (-F.col("p.down")).alias("height"))


def score_peaks(picked: DataFrame, max_delay: int = 3) -> DataFrame:
    """``picked`` without its arrays and with ``rt_left``, ``rt_apex``, ``rt_right`` and the sub-scores, all such that they
    come from the points of the peak group alone:

    ``coelution`` (mean plus deviation of the delays at which pairs of traces correlate best; 0 is best), ``shape`` (mean of
    those correlations), ``library_angle``, ``library_manhattan`` and ``library_rmsd`` (of the fragments' areas against their
    library intensities, shares of their sums in the last), ``log_intensity`` (of all areas) and ``width`` (points). Scores of
    pairs are null where a candidate has one fragment.
    """
    cut = F.transform("fragments", lambda f: F.slice(f["trace"], F.col("left") + 1, F.col("right") - F.col("left") + 1))
    near = picked.withColumn("cut", cut).withColumn("area", F.transform("cut", total)).withColumn("z", F.transform("cut", standardize))
    n = F.size("z")
    rest = lambda i: F.when(i + 1 < n, F.sequence(i + 1, n - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(rest(i), lambda j: xcorr_max(xcorr_post(F.get("z", i), F.get("z", j), max_delay), 9))))
    near = near.withColumn("pairs", pairs)
    mean = lambda x: total(x) / F.nullif(F.size(x), F.lit(0))
    delays = F.transform("pairs", lambda p: F.abs(p["delay"]).cast("double"))
    spread = let(delays, lambda d: let(mean(d), lambda m: m + F.sqrt(mean(F.transform(d, lambda v: (v - m) * (v - m))))))
    library = F.col("fragments.intensity")
    share = lambda x: let(total(x), lambda s: F.when(s > 0, F.transform(x, lambda v: v / s)).otherwise(x))
    scores = (
        spread, mean(F.transform("pairs", lambda p: p["value"])), spectral_angle(F.col("area"), library), normalized_manhattan(F.col("area"), library), rmsd(share(F.col("area")), share(library)),
        F.log(total(F.col("area"))), F.size(F.get("z", F.lit(0))).cast("double"),
    )
    keep = [c for c in picked.columns if c not in ("points", "fragments", "left", "apex", "right")]
    at = [F.get("points", F.col(c)).alias(f"rt_{c}") for c in ("left", "apex", "right")]
    return near.select(*keep, *at, *(s.alias(c) for c, s in zip(SCORES, scores, strict=True)))


def extract_and_score(gathered: DataFrame, library: DataFrame, group: str = "group", fragment: str = "fragment", max_delay: int = 3) -> DataFrame:
    """Gathered peaks to scored peak groups: traces, picking, scores. A candidate without gathered peaks has no row."""
    return score_peaks(pick(matrices(gathered, library, group, fragment)), max_delay)
