"""Calibration before extraction: monotone alignment of retention time, and the drift of mass with its spread."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.operators.quantiles import medians
from peakloom.plans.durable import durable_table

#: Bins of predicted retention time that an alignment can have: what the driver gets of the anchors.
MOST_BINS = 10_000


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))


def anchor_bins(anchors: DataFrame, width: float) -> DataFrame:
    """For each bin of ``predicted`` the number of anchors ``n`` and the medians of ``predicted`` and ``observed``; rows in which
    either is null or not finite are no anchors. Medians are exact and no bin is one task's."""
    both = anchors.where(_finite("predicted") & _finite("observed")).select(F.floor(F.col("predicted") / width).alias("bin"), F.col("predicted").cast("double"), F.col("observed").cast("double"))
    return medians(both, ["bin"], ["predicted", "observed"], rows="n")


def monotone(values: list[float], weights: list[float]) -> list[float]:
    """The non-decreasing sequence nearest to ``values`` in weighted squares: adjacent ones that fall are pooled."""
    pools: list[list[float]] = []  # mean, weight, members
    for v, w in zip(values, weights, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            (v2, w2, n2), (v1, w1, n1) = pools.pop(), pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return [v for v, _, n in pools for _ in range(int(n))]


@dataclass(frozen=True)
class Alignment:
    """Observed for predicted retention time: linear between knots, and along the outermost two beyond them."""

    x: tuple[float, ...]
    y: tuple[float, ...]
    width: float

    def observed(self, predicted: Column) -> Column:
        """One lookup by bin for each row: every bin keeps the line of each of its two halves."""
        if len(self.x) < 2:
            return predicted + F.lit(self.y[0] - self.x[0] if self.x else 0.0)
        x, y = np.array(self.x), np.array(self.y)
        half, first = self.width / 2, 2 * floor(self.x[0] / self.width) - 1
        n = 2 * ceil((self.x[-1] - self.x[0]) / self.width) + 6
        # A piece may hold knots: it is cut at them, and a value takes the first cut that it does not exceed.
        table = []
        for i in range(n):
            low, high = (first + i) * half, (first + i + 1) * half
            ends = [*x[(x > low) & (x < high)], np.inf if i == n - 1 else high]
            at = [min(max(int(np.searchsorted(x, e, "left")) - 1, 0), len(x) - 2) for e in ends]
            slope = [(y[k + 1] - y[k]) / (x[k + 1] - x[k]) for k in at]
            table.append([(float(e), float(s), float(y[k] - s * x[k])) for e, s, k in zip(ends, slope, at, strict=True)])
        pieces = F.array(*(F.array(*(F.struct(F.lit(e).alias("to"), F.lit(s).alias("slope"), F.lit(b).alias("from")) for e, s, b in row)) for row in table))
        piece = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(predicted / half).cast("int") - first))
        line = F.get(F.filter(F.get(pieces, piece), lambda p: (predicted <= p["to"]) | (p["to"] == table[-1][-1][0])), F.lit(0))
        return line["slope"] * predicted + line["from"]


def align(anchors: DataFrame, width: float) -> Alignment:
    """A non-decreasing alignment from anchors (predicted, observed) in bins of ``width``: bin medians, weighted by their
    anchors. Without anchors time stays as it is; with those of one bin it is shifted. The driver gets a row for each bin."""
    rows = anchor_bins(anchors, width).orderBy("bin").limit(MOST_BINS + 1).collect()
    if len(rows) > MOST_BINS:
        raise ValueError(f"over {MOST_BINS} bins: take a larger width")
    y = monotone([r["observed"] for r in rows], [float(r["n"]) for r in rows])
    knots = {r["predicted"]: v for r, v in zip(rows, y, strict=True)}
    return Alignment(tuple(knots), tuple(knots.values()), width)


@dataclass(frozen=True)
class Drift:
    """Mass error in ppm, linear in retention time and mass, and its robust deviation."""

    offset: float
    by_rt: float
    by_mz: float
    deviation: float

    def error(self, rt: Column, mz: Column) -> Column:
        return F.lit(self.offset) + self.by_rt * rt + self.by_mz * mz

    def corrected(self, mz: Column, rt: Column) -> Column:
        return mz / (1 + self.error(rt, mz) * 1e-6)

    def width(self, deviations: float = 3.0, least: float = 1.0) -> float:
        """Full extraction width in ppm, as ``index.gather`` takes it."""
        return max(least, 2 * deviations * self.deviation)


def mass_drift(anchors: DataFrame, rounds: int = 8, cut: float = 4.685) -> Drift:
    """The drift of anchors (mz, theoretical_mz, rt): least squares reweighted each round by how far an anchor is from the
    line (Tukey's weights; none beyond ``cut`` deviations), so that wrong anchors do not count. Each round is one
    aggregate of ten sums and one exact median; rows with a null or infinite value are no anchors. Without anchors there
    is no drift and no deviation."""
    error = (F.col("mz") - F.col("theoretical_mz")) / F.col("theoretical_mz") * 1e6
    able = anchors.where(_finite("mz") & _finite("theoretical_mz") & _finite("rt") & (F.col("theoretical_mz") > 0))
    facts = able.agg(F.count(F.lit(1)), F.avg("rt"), F.stddev_pop("rt"), F.avg("mz"), F.stddev_pop("mz")).first()
    if not facts[0]:
        return Drift(0.0, 0.0, 0.0, 0.0)
    (rt0, rt1), (mz0, mz1) = (facts[1], facts[2] or 1.0), (facts[3], facts[4] or 1.0)
    x = [F.lit(1.0), (F.col("rt") - rt0) / rt1, (F.col("mz") - mz0) / mz1]
    kept = durable_table(able.select(error.alias("e"), *(c.alias(f"x{i}") for i, c in enumerate(x))), "drift-anchors")
    at = [F.col(f"x{i}") for i in range(3)]
    middle = lambda c: medians(kept.select(c.alias("v")), [], ["v"]).first()["v"]
    beta = np.array([middle(F.col("e")), 0.0, 0.0])
    for _ in range(rounds):
        off = F.col("e") - sum((float(b) * c for b, c in zip(beta, at, strict=True)), F.lit(0.0))
        scale = 1.4826 * middle(F.abs(off))
        if scale < 1e-9:
            break
        u = off / (cut * scale)
        w = F.when(F.abs(u) < 1, F.pow(1 - u * u, F.lit(2.0))).otherwise(F.lit(0.0))
        pairs = [(i, j) for i in range(3) for j in range(i, 3)]
        sums = kept.withColumn("w", w).agg(*(F.sum(F.col("w") * at[i] * at[j]) for i, j in pairs), *(F.sum(F.col("w") * c * F.col("e")) for c in at)).first()
        a = np.zeros((3, 3))
        for (i, j), v in zip(pairs, sums[:6], strict=True):
            a[i, j] = a[j, i] = v
        fresh = np.linalg.solve(a + 1e-9 * np.trace(a) * np.eye(3), np.array(sums[6:], float))
        done, beta = np.abs(fresh - beta).max() < 1e-9, fresh
        if done:
            break
    off = F.col("e") - sum((float(b) * c for b, c in zip(beta, at, strict=True)), F.lit(0.0))
    return Drift(float(beta[0] - beta[1] * rt0 / rt1 - beta[2] * mz0 / mz1), float(beta[1] / rt1), float(beta[2] / mz1), 1.4826 * middle(F.abs(off)))
