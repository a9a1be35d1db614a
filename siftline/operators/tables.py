"""Shape changes on small result rows, and checks on column names."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def one_row_per(wide: DataFrame, id_name: str, names: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """Turn the single row of a wide aggregate, columns ``stat:name``, into one row per name."""
    rows = [
        F.struct(F.lit(name).alias(id_name), *[F.col(f"`{s}:{name}`").alias(s) for s in stats])
        for name in names
    ]
    return wide.select(F.inline(F.array(*rows)))


def available(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    """The wanted columns that exist, in the wanted order."""
    return [name for name in wanted if name in df.columns]


def absent(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    return [name for name in wanted if name not in df.columns]


def require_columns(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Raise before any job if a wanted column is absent."""
    names = absent(df, wanted)
    if names:
        raise ValueError(f"Missing columns: {', '.join(names)}")
    return df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a floating-point column."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def first_rows(df: DataFrame, key: Sequence[str], rows: int = 5) -> DataFrame:
    return df.orderBy(*key).limit(rows)


def row_at(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def paired(features: DataFrame, labels: DataFrame, key: Sequence[str]) -> DataFrame:
    """Feature rows with their labels, matched on the key, which must identify a row of both."""
    return features.join(labels, list(key), "inner")


def stacked(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second)
