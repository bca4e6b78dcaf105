"""What expressions over arrays share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once: Spark computes what stands in a lambda anew for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def total(x: Column) -> Column:
    """Sum of an array of doubles, in its order."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def running(x: Column) -> Column:
    """Sums of the first one, two, ... elements."""
    empty = F.array().cast("array<double>")
    return F.aggregate(x, F.struct(F.lit(0.0).alias("s"), empty.alias("all")), lambda a, v: F.struct((a["s"] + v).alias("s"), F.concat(a["all"], F.array(a["s"] + v)).alias("all")), lambda a: a["all"])
