"""Median imputation and scaling: fit small parameters, apply them as literals."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import scaling
from siftline.functions.naming import col
from siftline.operators import quantiles


def fit_medians(df: DataFrame, features: Sequence[str], approximate: bool = False) -> dict[str, float | None]:
    """Exact medians, or on request approximate ones from a single pass."""
    values = {name: scaling.missing_as_null(col(name)) for name in features}
    if approximate:
        found = quantiles.sketch_quantiles(df, {n: (v, (0.5,)) for n, v in values.items()})
        return {n: points[0] if points else None for n, (_, points) in found.items()}
    medians, _ = quantiles.exact_quantiles(df, values, (0.5,))
    return {n: m[0] for n, m in medians.items()}


def impute(df: DataFrame, medians: Mapping[str, float | None]) -> DataFrame:
    return df.withColumns(
        {name: scaling.filled(scaling.missing_as_null(col(name)), value) for name, value in medians.items()}
    )


def moments(features: Mapping[str, Column]) -> list[Column]:
    """Aggregates that both scalers are fitted from."""
    wanted = []
    for name, value in features.items():
        wanted += [
            F.min(value).alias(f"min:{name}"),
            F.max(value).alias(f"max:{name}"),
            F.avg(value).alias(f"mean:{name}"),
            F.stddev_pop(value).alias(f"std_pop:{name}"),
        ]
    return wanted


STATS = ("min", "max", "mean", "std_pop")


def fit_scales(df: DataFrame, features: Sequence[str]) -> dict[str, dict[str, float]]:
    """min, max, mean and population deviation per feature, from one pass."""
    row = df.agg(*moments({name: col(name).cast("double") for name in features})).first()
    return {name: {stat: row[f"{stat}:{name}"] for stat in STATS} for name in features}


def scale_after_filling(
    scale: Mapping[str, float | None], present: int, missing: int, fill: float
) -> dict[str, float]:
    """The moments of a column once its missing values are filled, without another pass."""
    if not missing:
        return dict(scale)
    if not present:
        return {"min": fill, "max": fill, "mean": fill, "std_pop": 0.0}
    rows = present + missing
    mean = (present * scale["mean"] + missing * fill) / rows
    spread = present * (scale["std_pop"] ** 2 + (scale["mean"] - mean) ** 2) + missing * (fill - mean) ** 2
    return {
        "min": min(scale["min"], fill),
        "max": max(scale["max"], fill),
        "mean": mean,
        "std_pop": math.sqrt(spread / rows),
    }


def _scaled(name: str, scale: Mapping[str, float], method: str) -> Column:
    if method == "minmax":
        return scaling.min_max(col(name), scale["min"], scale["max"])
    if method == "standard":
        return scaling.standard(col(name), scale["mean"], scale["std_pop"])
    raise ValueError(f"unknown scaling method: {method}")


def scale(
    df: DataFrame, scales: Mapping[str, Mapping[str, float]], method: str = "minmax", suffix: str = "_scaled"
) -> DataFrame:
    """Scaled columns next to the raw ones; an empty suffix replaces the raw ones."""
    return df.withColumns({name + suffix: _scaled(name, s, method) for name, s in scales.items()})


def unscale(
    df: DataFrame, scales: Mapping[str, Mapping[str, float]], method: str = "minmax", suffix: str = "_scaled"
) -> DataFrame:
    """Put the values of the scaled columns back into the unsuffixed columns."""
    back = {}
    for name, s in scales.items():
        value = F.col(name + suffix)
        if method == "minmax":
            back[name] = scaling.from_min_max(value, s["min"], s["max"])
        else:
            back[name] = scaling.from_standard(value, s["mean"], s["std_pop"])
    return df.withColumns(back)
