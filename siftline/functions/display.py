"""Text forms of numbers for reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.naming import col

# Decimals and unit per displayed feature.
KOI_DISPLAY = {
    "koi_period": (2, "days"),
    "koi_depth": (1, "ppm"),
    "koi_prad": (2, "Earth radii"),
    "koi_teq": (0, "K"),
}


def _halves(value: Column) -> tuple[Column, Column]:
    """A double as the sum of two with half the digits each, whose products are exact."""
    wide = value * 134217729.0  # 2**27 + 1
    high = wide - (wide - value)
    return high, value - high


def _rounded(value: Column, decimals: int) -> Column:
    """Round by the exact value of the double, ties to the even digit: 500.25 and 2.675 go down, 500.35 up.

    Formats on the JVM round the shortest text of a number, half up, which gives 500.3 and 2.68.
    """
    value, factor = value.cast("double"), float(10**decimals)
    (a, b), (c, d) = _halves(value), _halves(F.lit(factor))
    product = value * factor
    rest = a * c - product + a * d + b * c + b * d  # what the product has lost, exactly
    below = F.floor(product).cast("double")
    over = product - below - 0.5 + rest
    up = (over > 0) | ((over == 0) & (F.abs(below % 2) == 1))
    whole = below + up.cast("double")
    signed = F.when((value < 0) & (whole == 0), F.lit(-0.0)).otherwise(whole / factor)
    # Beyond that a double has no more decimals to round.
    return F.when(F.abs(product) < 2.0**52, signed).otherwise(value)


def with_unit(value: Column, decimals: int, unit: str = "") -> Column:
    text = F.format_string(f"%.{decimals}f", _rounded(value, decimals))
    return F.concat(text, F.lit(f" {unit}")) if unit else text


def percent(value: Column, decimals: int = 2) -> Column:
    return F.format_string(f"%.{decimals}f%%", _rounded(value * 100, decimals))


def display_columns(formats: Mapping[str, tuple[int, str]]) -> list[Column]:
    return [
        with_unit(col(name), decimals, unit).alias(name)
        for name, (decimals, unit) in formats.items()
    ]
