"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUDGE = 1e-9


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def nan_to_null(x: Column) -> Column:
    """Missing values are NULL in this engine, whatever the source wrote."""
    return F.when(finite(x), x)


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, with no negative zero; the nudge decides ties whatever the last bits of a sum are."""
    return F.round(x + F.lit(NUDGE), digits) + F.lit(0.0)


def spread(name: str, ddof: int = 1):
    """The standard deviation aggregate of a degree-of-freedom correction."""
    if ddof not in (0, 1):
        raise ValueError("ddof must be 0 or 1")
    return F.stddev_samp(name) if ddof else F.stddev_pop(name)
