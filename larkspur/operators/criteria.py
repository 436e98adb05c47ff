"""Filters with an explicit rule for missing values: stored criteria let them pass, filters of a reader don't."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_passes(test: Column) -> Column:
    return F.coalesce(test, F.lit(True))


def null_fails(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def within(value: Column, low=None, high=None) -> Column:
    """Inclusive bounds; a bound of None is none; null if the value is and there is a bound."""
    tests = ([value >= low] if low is not None else []) + ([value <= high] if high is not None else [])
    return reduce(Column.__and__, tests, F.lit(True)) if tests else F.lit(True)


def accepted(value: Column, allowed: list) -> Column:
    """True for an empty list; null if the value is missing."""
    return value.isin(allowed) if allowed else F.lit(True)


def apply_criteria(items: DataFrame, bounds: dict[str, tuple], layouts: list[str] = (), layout: str | None = None) -> DataFrame:
    """Stored criteria: a missing value passes."""
    tests = [null_passes(within(F.col(c), *b)) for c, b in bounds.items()] + ([null_passes(accepted(F.col(layout), list(layouts)))] if layout else [])
    return items.where(reduce(Column.__and__, tests, F.lit(True)))


def apply_filter(items: DataFrame, bounds: dict[str, tuple], facets: dict[str, list] | None = None) -> DataFrame:
    """A reader's filter: a missing value fails where there is a bound or a choice."""
    tests = [null_fails(within(F.col(c), *b)) for c, b in bounds.items()] + [null_fails(accepted(F.col(c), v)) for c, v in (facets or {}).items()]
    return items.where(reduce(Column.__and__, tests, F.lit(True)))


def inside_place(kind: str, code: int, columns: dict[str, str]) -> Column:
    """Whether a located row lies in a place: its code column of that kind holds the code; a coarser location fails."""
    return null_fails(F.col(columns[kind]) == code)
