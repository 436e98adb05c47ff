"""Number functions with the rounding and null rules that ranking and linkage need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """To the nearest integer, halves towards plus infinity."""
    return F.floor(x + 0.5).cast("long")


def half_even(x: Column) -> Column:
    """To the nearest integer, halves to the even one."""
    return F.rint(x).cast("long")


def clamp(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def price_per_m2(price: Column, size: Column) -> Column:
    return F.when(price.isNotNull() & (size > 0), price / size)


def known(x: Column) -> Column:
    """False for null and zero."""
    return F.coalesce(x != 0, F.lit(False))
