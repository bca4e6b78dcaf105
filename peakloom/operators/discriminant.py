"""Semi-supervised scoring of peak groups: sub-scores combined into one discriminant learned from decoys and confident targets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakloom.functions.arrays import total
from peakloom.operators.quantiles import least_passing
from peakloom.operators.rescore import target_decoy_qvalues
from peakloom.plans.durable import durable_table, scratch

#: Peak groups that a row of the training table holds at most; those of one precursor that are dealt to one task, about.
MOST_GROUPS, MOST_DEALT = 64, 100_000


@dataclass(frozen=True)
class Learning:
    """``folds`` by precursor, so that no precursor is scored by what was learned from it; ``rounds`` of choosing the best
    peak groups and fitting; the FDR up to which targets count as confident, in the first round and later."""

    folds: int = 3
    rounds: int = 5
    first_fdr: float = 0.15
    fdr: float = 0.05
    ridge: float = 1e-6


@dataclass(frozen=True)
class Discriminant:
    """Weights of the standardized sub-scores and an offset, a row for each fold; means and deviations of the sub-scores."""

    scores: tuple[str, ...]
    means: np.ndarray
    deviations: np.ndarray
    weights: np.ndarray
    options: Learning


def fold_of(by: str, folds: int) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(folds)).cast("int")


def _number(c: str) -> Column:
    """A sub-score as double; not a number is null."""
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x)


def _standard(scores: tuple[str, ...], means: np.ndarray, deviations: np.ndarray) -> list[Column]:
    """The sub-scores, centred and scaled; a missing one counts as the mean."""
    return [F.coalesce((_number(c) - F.lit(float(m))) / F.lit(float(d)), F.lit(0.0)) for c, m, d in zip(scores, means, deviations, strict=True)]


def _score(weights: np.ndarray, fold: str) -> Column:
    """Inner product of ``x`` with the weights of the fold, plus its offset. Weights are literals: folds by sub-scores."""
    table = F.array(*(F.array(*(F.lit(float(v)) for v in w)) for w in weights))
    mine = F.get(table, F.col(fold))
    return total(F.zip_with(F.concat("x", F.array(F.lit(1.0))), mine, lambda a, b: a * b))


def best_groups(scored: DataFrame, by: list[str], group: str, decoy: str) -> DataFrame:
    """The peak group of each precursor with the highest ``d``, ties by the smaller id: a minimum, combined before the shuffle."""
    rest = [c for c in ("x",) if c in scored.columns]
    least = scored.where(~F.isnan("d")).groupBy(*by).agg(F.min(F.struct((-F.col("d")).alias("down"), F.col(group).alias("group"), F.col(decoy).alias("decoy"), *rest)).alias("r"))
    return least.select(*by, F.col("r.group").alias(group), F.col("r.decoy").alias(decoy), (-F.col("r.down")).alias("d"), *(f"r.{c}" for c in rest))


def _solve(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, ridge: float) -> np.ndarray:
    """Weights and offset from counts (2), sums (2, k) and cross-products (2, k, k) of decoys and confident targets: the
    direction that separates them in units of their pooled spread, scaled so that decoys have mean 0 and deviation 1."""
    mean = sums / n[:, None]
    within = squares - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    pooled = within.sum(axis=0) / max(1.0, n.sum() - 2)
    k = len(pooled)
    w = np.linalg.solve(pooled + ridge * (np.trace(pooled) / k + 1e-12) * np.eye(k), mean[1] - mean[0])
    spread = float(np.sqrt(max(w @ (within[0] / max(1.0, n[0] - 1)) @ w, 1e-24)))
    return np.r_[w, -float(w @ mean[0])] / spread


@dataclass(frozen=True)
class Training:
    """Precursors with their standardized peak groups: ``rows`` (by, fold, whole, groups: array of (group, decoy, x0, x1, ...) in
    order). A precursor of ``MOST_GROUPS`` or more has several rows, of which none is ``whole``; ``crowded``: there are such."""

    rows: DataFrame
    crowded: bool
    n: int
    means: np.ndarray
    deviations: np.ndarray


def _training(groups: DataFrame, scores: tuple[str, ...], by: str, group: str, decoy: str, folds: int) -> Training:
    k = len(scores)
    facts = groups.agg(*(F.avg(_number(c)) for c in scores), *(F.stddev_pop(_number(c)) for c in scores), F.count(F.lit(1))).first()
    means, deviations = np.array([v or 0.0 for v in facts[:k]]), np.array([v or 1.0 for v in facts[k : 2 * k]])
    xs = [c.alias(f"x{i}") for i, c in enumerate(_standard(scores, means, deviations))]
    each = groups.where(F.col(decoy).isin(0, 1)).select(F.col(by).alias("by"), F.col(group).alias("group"), F.col(decoy).cast("int").alias("decoy"), *xs)
    # Precursors of over ``MOST_DEALT`` groups, few beside the rows, are dealt in pieces.
    crowds = each.groupBy("by").agg(F.ceil(F.count(F.lit(1)) / MOST_DEALT).cast("int").alias("pieces")).where("pieces > 1").withColumnRenamed("by", "__by")
    dealt = each.join(F.broadcast(crowds), F.col("by").eqNullSafe(F.col("__by")), "left").withColumn("piece", F.pmod(F.xxhash64("group", *(f"x{i}" for i in range(k))), F.coalesce("pieces", F.lit(1))))
    part = F.floor((F.row_number().over(W.partitionBy("by", "piece").orderBy("group")) - 1) / MOST_GROUPS)
    listed = dealt.withColumn("part", part).groupBy("by", "piece", "part").agg(F.sort_array(F.collect_list(F.struct("group", "decoy", *(f"x{i}" for i in range(k))))).alias("groups"), F.first("pieces").alias("pieces"))
    whole = F.col("pieces").isNull() & (F.col("part") == 0) & (F.size("groups") < MOST_GROUPS)
    rows = durable_table(listed.select("by", fold_of("by", folds).alias("fold"), whole.alias("whole"), "groups"), "discriminant-training")
    return Training(rows, bool(rows.where("NOT whole").take(1)), facts[2 * k], means, deviations)


def _bests(training: Training, weights: np.ndarray, own: bool = False) -> DataFrame:
    """The best peak group of each precursor (set, by, group, decoy, d, x) by the weights of every fold that learns from it or,
    if ``own``, of the fold it is in. Whole precursors are settled where they are, without a shuffle; of others each row gives
    its best, and these meet."""
    folds, k = len(weights), weights.shape[1] - 1
    kinds = {f.name: f.dataType.simpleString() for f in training.rows.schema["groups"].dataType.elementType}
    by = training.rows.schema["by"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, fold = batch.column("groups"), batch.column("fold").to_numpy()
            rows, of = lists.flatten(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            xs = [rows.field(f"x{i}").to_numpy() for i in range(k)]
            for f in range(folds):
                d = np.zeros(len(of))
                for x, w in zip(xs, weights[f], strict=False):
                    d += x * w
                d += weights[f, k]
                mine = fold == f if own or folds == 1 else fold != f
                at = np.flatnonzero(mine[of] & ~np.isnan(d))
                if not len(at):
                    continue
                start = np.flatnonzero(np.r_[True, np.diff(of[at]) > 0])
                high = np.repeat(np.maximum.reduceat(d[at], start), np.diff(np.r_[start, len(at)]))
                at = at[d[at] == high]  # of equal ones the first is the least
                at = at[np.r_[True, np.diff(of[at]) > 0]]
                x = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * k, np.column_stack([x[at] for x in xs]).ravel())
                who = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), f, np.int32)), batch.column("by").take(pa.array(of[at])), rows.field("group").take(who), rows.field("decoy").take(who), pa.array(d[at]), x],
                    ["set", "by", "group", "decoy", "d", "x"],
                )

    found = lambda rows: rows.mapInArrow(search, f"set int, by {by}, `group` {kinds['group']}, decoy int, d double, x array<double>")
    if not training.crowded:
        return found(training.rows)
    return found(training.rows.where("whole")).unionByName(best_groups(found(training.rows.where("NOT whole")), ["set", "by"], "group", "decoy"))


def _learn(training: Training, scores: tuple[str, ...], main: str, options: Learning) -> Discriminant:
    k = len(scores)
    ranges = 1 + training.n * options.folds // 100_000
    weights = np.zeros((options.folds, k + 1))
    weights[:, scores.index(main)] = 1.0
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for r in range(options.rounds):
        with scratch(training.rows.sparkSession):
            best = durable_table(_bests(training, weights).select("set", "decoy", "d", "x"), "discriminant-best")
            sure = least_passing(best, ["set"], "d", F.col("decoy"), 1 - F.col("decoy"), options.fdr if r else options.first_fdr, ranges).collect()
            least = F.array(*(F.lit({s["set"]: s["least"] for s in sure}.get(f)).cast("double") for f in range(options.folds)))
            used = best.where((F.col("decoy") == 1) | (F.col("d") >= F.get(least, F.col("set"))))
            xs = [F.get("x", F.lit(i)) for i in range(k)]
            sums = used.groupBy("set", "decoy").agg(F.count(F.lit(1)), *(F.sum(v) for v in xs), *(F.sum(xs[i] * xs[j]) for i, j in pairs)).collect()
        found = {(s[0], s[1]): s[2:] for s in sums}
        for f in range(options.folds):
            both = [found.get((f, d)) for d in (1, 0)]
            if any(b is None or b[0] < k + 2 for b in both):
                continue
            squares = np.zeros((2, k, k))
            for side, b in enumerate(both):
                for (i, j), v in zip(pairs, b[1 + k :], strict=True):
                    squares[side, i, j] = squares[side, j, i] = v
            weights[f] = _solve(np.array([b[0] for b in both], float), np.array([b[1 : 1 + k] for b in both], float), squares, options.ridge)
    return Discriminant(tuple(scores), training.means, training.deviations, weights, options)


def _checked(scores: tuple[str, ...], main: str) -> None:
    if main not in scores:
        raise ValueError(f"{main} is none of {', '.join(scores)}")


def learn(groups: DataFrame, scores: tuple[str, ...], main: str, by: str = "precursor_id", group: str = "group_id", decoy: str = "decoy", options: Learning = Learning()) -> Discriminant:
    """Weights for each fold, from the precursors of the other folds.

    Each round scores every peak group with the weights so far (``main`` alone at first), takes the best one of each
    precursor, targets and decoys alike, and fits targets at the FDR or better against all decoys. A round in which a
    fold has fewer confident targets or decoys than it needs to be fitted keeps the fold's weights.

    Precursors are dealt once; a round shuffles no peak groups but the bests of rows of precursors that have very many, and
    what it keeps is removed at its end. The driver gets one threshold and two rows of sums (k x k) for each fold.
    """
    _checked(scores, main)
    return _learn(_training(groups, scores, by, group, decoy, options.folds), scores, main, options)


def score(groups: DataFrame, model: Discriminant, by: str = "precursor_id") -> DataFrame:
    """``groups`` with ``d_score``: each by the weights of its precursor's fold, which were learned without it."""
    x = groups.withColumn("x", F.array(*_standard(model.scores, model.means, model.deviations))).withColumn("__fold", fold_of(by, model.options.folds))
    return x.withColumn("d_score", _score(model.weights, "__fold")).drop("x", "__fold")


def score_groups(groups: DataFrame, scores: tuple[str, ...], main: str, by: str = "precursor_id", group: str = "group_id", decoy: str = "decoy", options: Learning = Learning()) -> DataFrame:
    """The best peak group of each precursor: ``by``, ``group``, ``decoy``, ``d_score``, and ``fdr``, ``q_value`` and ``unit`` of
    targets and decoys in one pool. Rows whose ``decoy`` is neither 0 nor 1 take no part; an empty table gives an empty
    result; sub-scores may be null, and other columns are not read."""
    _checked(scores, main)
    training = _training(groups, scores, by, group, decoy, options.folds)
    model = _learn(training, scores, main, options)
    best = _bests(training, model.weights, own=True).select(F.col("by").alias(by), F.col("group").alias(group), F.col("decoy").alias(decoy), F.col("d").alias("d_score"))
    return target_decoy_qvalues(durable_table(best, "discriminant-best"), "d_score", decoy, "peak group")
