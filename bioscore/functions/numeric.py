"""Rounding and clamping expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Small positive shift used before truncating a product that should be whole.
ADJUST = 0.0000000000005


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed(c: Column | str, digits: int = 6) -> Column:
    """Round by floor(x*10^d + 0.5)/10^d; never yields a negative zero."""
    scale = float(10 ** digits)
    return F.floor(col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def trunc(c: Column) -> Column:
    """Truncate towards zero to an int."""
    return c.cast("int")


def half_away(c: Column) -> Column:
    """Round to the nearest int, halves away from zero."""
    return F.when(c >= 0, (c + 0.5).cast("int")).otherwise((c - 0.5).cast("int"))


def half_even(c: Column) -> Column:
    """Round to the nearest int, halves to even."""
    return F.rint(c).cast("int")


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, low if isinstance(low, Column) else F.lit(low)),
                   high if isinstance(high, Column) else F.lit(high))


def real(c) -> Column:
    """Single precision."""
    return (c if isinstance(c, Column) else F.lit(c)).cast("float")


def ratio(a, b) -> Column:
    """Single-precision quotient, NULL for a zero divisor.

    Spark divides in double precision, so there is one rounding.
    """
    return F.try_divide(real(a), real(b)).cast("float")
