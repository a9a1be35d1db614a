"""Imputing and scaling one value with fitted parameters held as literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing_as_null(value: Column) -> Column:
    """NaN becomes NULL, so that SQL aggregates skip it."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def filled(value: Column, replacement: float | None) -> Column:
    return F.coalesce(value, F.lit(replacement).cast("double"))


def min_max(value: Column, low: float, high: float) -> Column:
    """Unclipped; a constant column gives 0 at its own value."""
    width = high - low
    return (value - F.lit(low)) / F.lit(width if width != 0 else 1.0)


def from_min_max(value: Column, low: float, high: float) -> Column:
    width = high - low
    return value * F.lit(width if width != 0 else 1.0) + F.lit(low)


def standard(value: Column, mean: float, std_pop: float) -> Column:
    """Population deviation; a constant column is only centred."""
    return (value - F.lit(mean)) / F.lit(std_pop if std_pop != 0 else 1.0)


def from_standard(value: Column, mean: float, std_pop: float) -> Column:
    return value * F.lit(std_pop if std_pop != 0 else 1.0) + F.lit(mean)
