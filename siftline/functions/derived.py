"""Derived features: ratios, products, logarithms and squares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.naming import col


@dataclass(frozen=True)
class DerivedFeatures:
    """New column name -> the columns it is made of."""

    ratios: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    products: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    logs: Sequence[str] = ()
    squares: Sequence[str] = ()

    def names(self, available: Sequence[str]) -> list[str]:
        logs = [f"{name}_log" for name in self.logs if name in available]
        squares = [f"{name}_squared" for name in self.squares]
        return [*self.ratios, *self.products, *logs, *squares]


# The twelve derived features of the catalogue.
KOI_DERIVED = DerivedFeatures(
    ratios={
        "depth_period_ratio": ("koi_depth", "koi_period"),
        "depth_duration_ratio": ("koi_depth", "koi_duration"),
        "period_duration_ratio": ("koi_period", "koi_duration"),
    },
    products={
        "depth_impact_product": ("koi_depth", "koi_impact"),
        "snr_depth_product": ("koi_model_snr", "koi_depth"),
        "teq_prad_product": ("koi_teq", "koi_prad"),
    },
    logs=("koi_period", "koi_depth", "koi_prad", "koi_model_snr"),
    squares=("koi_depth", "koi_period"),
)


def ratio(numerator: str, denominator: str) -> Column:
    """``a / (b + 1)``; NULL where the denominator is 0."""
    return F.try_divide(col(numerator), col(denominator) + F.lit(1.0))


def product(left: str, right: str) -> Column:
    return col(left) * col(right)


def log_plus_one(name: str) -> Column:
    """NULL at and below -1."""
    return F.log1p(col(name))


def square(name: str) -> Column:
    return col(name) * col(name)


def with_derived(df: DataFrame, derived: DerivedFeatures, suffix: str = "") -> DataFrame:
    """All derived features in one projection, made of the columns whose names end in ``suffix``.

    Logs of absent columns are left out.
    """
    columns: dict[str, Column] = {}
    columns.update({name: ratio(*(f"{part}{suffix}" for part in pair)) for name, pair in derived.ratios.items()})
    columns.update({name: product(*(f"{part}{suffix}" for part in pair)) for name, pair in derived.products.items()})
    columns.update({f"{n}_log": log_plus_one(n + suffix) for n in derived.logs if n + suffix in df.columns})
    columns.update({f"{name}_squared": square(name + suffix) for name in derived.squares})
    return df.withColumns(columns)
