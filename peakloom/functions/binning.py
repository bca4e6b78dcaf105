"""Bins of mass-to-charge ratios, keys of isolation windows, blocks of retention time."""

from __future__ import annotations

from math import log1p

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where logarithmic bins begin, in Th. Bins below it are negative; the bin of a value just below it is 0, as bins
#: are cut towards zero.
MZ0 = 100.0


def mz_bin(mz: Column, ppm: float = 20.0, mz0: float = MZ0) -> Column:
    """Logarithmic bin of width ``ppm``, cut towards zero."""
    return (F.log(mz / F.lit(mz0)) * F.lit(1.0 / log1p(ppm * 1e-6))).cast("bigint")


def neighbours(bin_: Column) -> Column:
    """The bins in which a value within the tolerance can be: its own and those beside it."""
    return F.array(bin_ - 1, bin_, bin_ + 1)


def neighbour_hit(p: Column) -> Column:
    """Chance that one of a bin and its two neighbours is occupied, ``p`` for each; bounded by one."""
    return F.least(F.lit(1.0), 3 * p)


def window_key(mz: Column) -> Column:
    """Integer identity of an isolation window: hundredths of a Th, rounded half up."""
    return (mz * 100 + 0.5).cast("bigint")


def grid_window(mz: Column, width: float = 24.0) -> Column:
    """Cell of a fixed grid anchored at zero, not at an acquisition's own windows."""
    return F.floor(mz / width)


def rt_block(rt: Column, seconds: float = 30.0) -> Column:
    """Retention-time block, cut towards zero."""
    return (rt / seconds).cast("int")


def upper_median(x: Column | str) -> Column:
    """Element n // 2 of the sorted values, 0.0 of none: the upper one of an even count, never an average."""
    name = x if isinstance(x, str) else None
    return F.expr(f"coalesce(percentile_disc(0.5) WITHIN GROUP (ORDER BY {name} DESC), 0.0D)")


def binomial_tail(p: Column, k: int, n: int) -> Column:
    """Chance of ``k`` hits or more of ``n`` independent ones with chance ``p`` each."""
    from math import comb

    total = F.lit(0.0)
    for i in range(k, n + 1):
        total = total + F.lit(float(comb(n, i))) * F.pow(p, F.lit(float(i))) * F.pow(1 - p, F.lit(float(n - i)))
    return total
