"""Scores of traces: arrays of doubles, in higher-order functions. Arrays of unequal length give NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peakloom.functions.arrays import let
from peakloom.functions.arrays import total as _sum


def _paired(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value)


def standardize(x: Column) -> Column:
    """Less the mean, over the population deviation; only less the mean where that is zero; empty stays empty."""
    n = F.nullif(F.size(x), F.lit(0))
    divided = lambda c, sd: F.when(sd > 0, F.transform(c, lambda v: v / sd)).otherwise(c)
    deviation = lambda c: F.sqrt(_sum(F.transform(c, lambda v: v * v)) / n)
    centred = lambda mean: F.transform(x, lambda v: v - mean)
    some = let(_sum(x) / n, lambda mean: let(centred(mean), lambda c: let(deviation(c), lambda sd: divided(c, sd))))
    return F.when(F.size(x) == 0, x).otherwise(some)


def xcorr_post(a: Column, b: Column, max_delay: int) -> Column:
    """Sum of a[i] b[i + d] over the overlap, over the full length, for d from -max_delay to max_delay."""

    def of(x: Column, y: Column) -> Column:
        n = F.size(x)

        def at(d: Column) -> Column:
            # The overlap is a slice of each: one pass, without looking up places.
            low, m = F.greatest(F.lit(0), -d), F.greatest(F.lit(0), n - F.abs(d))
            terms = F.zip_with(F.slice(x, low + 1, m), F.slice(y, low + d + 1, m), lambda v, w: v * w)
            value = F.when(m > 0, _sum(terms)).otherwise(F.lit(0.0)) / F.nullif(n, F.lit(0))
            return F.struct(d.alias("delay"), value.alias("value"))

        return _paired(x, y, F.transform(F.sequence(F.lit(-max_delay), F.lit(max_delay)), at))

    return let(a, lambda x: let(b, lambda y: of(x, y)))


def xcorr(a: Column, b: Column, max_delay: int) -> Column:
    return xcorr_post(standardize(a), standardize(b), max_delay)


def xcorr_max(peaks: Column, digits: int | None = None) -> Column:
    """The largest in magnitude, with its sign; the first delay of equal ones (equal to ``digits`` places, if given)."""
    size = lambda x: F.abs(x["value"]) if digits is None else F.round(F.abs(x["value"]), digits)
    rest = lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))
    return let(peaks, lambda p: F.aggregate(rest(p), F.get(p, F.lit(0)), lambda best, x: F.when(size(x) > size(best), x).otherwise(best)))


def normalized_manhattan(a: Column, b: Column) -> Column:
    """Mean absolute difference after each is divided by its sum (unless that is zero); 0 of empty ones."""
    share = lambda x: let(_sum(x), lambda s: F.when(s != 0, F.transform(x, lambda v: v / s)).otherwise(x))
    gaps = F.zip_with(share(a), share(b), lambda x, y: F.abs(x - y))
    return _paired(a, b, F.when(F.size(a) == 0, F.lit(0.0)).otherwise(_sum(gaps) / F.nullif(F.size(a), F.lit(0))))


def rmsd(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return _paired(a, b, F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.sqrt(_sum(gaps) / F.nullif(F.size(a), F.lit(0)))))


def spectral_angle(a: Column, b: Column) -> Column:
    """Angle between two intensity vectors; 0 if either has no length (see ``has_angle``)."""
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(_sum(F.transform(a, lambda v: v * v))) * F.sqrt(_sum(F.transform(b, lambda v: v * v)))
    cosine = lambda n: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / F.nullif(n, F.lit(0.0))))
    return _paired(a, b, let(norm, lambda n: F.when(n == 0, F.lit(0.0)).otherwise(F.acos(cosine(n)))))


def has_angle(a: Column, b: Column) -> Column:
    """Whether both vectors have a length, so that their angle means something."""
    return F.exists(a, lambda v: v != 0) & F.exists(b, lambda v: v != 0)
