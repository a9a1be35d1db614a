"""Table profile: shape, statistics, missing values, class comparison, range checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.naming import col
from siftline.functions.scaling import missing_as_null
from siftline.operators import quantiles
from siftline.operators.labeling import class_ratio, positive_share
from siftline.operators.tables import is_missing, one_row_per

QUARTILES = (0.25, 0.5, 0.75)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column."""
    values = {name: missing_as_null(col(name)) for name in columns}
    stats = []
    for name, value in values.items():
        stats += [
            F.count(value).alias(f"rows:{name}"),
            F.avg(value).alias(f"mean:{name}"),
            F.stddev_samp(value).alias(f"std:{name}"),
            F.min(value).alias(f"min:{name}"),
            F.max(value).alias(f"max:{name}"),
        ]
    quarters, row = quantiles.exact_quantiles(df, values, QUARTILES, stats)
    lines = [
        (n, row[f"rows:{n}"], row[f"mean:{n}"], row[f"std:{n}"], row[f"min:{n}"], *quarters[n], row[f"max:{n}"])
        for n in columns
    ]
    schema = (
        "feature string, rows bigint, mean double, std double, min double,"
        " p25 double, p50 double, p75 double, max double"
    )
    return df.sparkSession.createDataFrame(lines, schema)


def class_comparison(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Mean and exact median per class and column."""
    values = {
        f"{value}:{name}": F.when(col(label) == value, missing_as_null(col(name)))
        for value in (0, 1)
        for name in columns
    }
    means = [F.avg(value).alias(f"mean:{name}") for name, value in values.items()]
    medians, row = quantiles.exact_quantiles(df, values, (0.5,), means)
    lines = [
        (value, name, row[f"mean:{value}:{name}"], medians[f"{value}:{name}"][0])
        for value in (0, 1)
        for name in columns
    ]
    return df.sparkSession.createDataFrame(lines, "label int, feature string, mean double, median double")


def missing_by_column(df: DataFrame) -> DataFrame:
    """Columns with missing values, most missing first."""
    counts = [F.count_if(is_missing(df, name)).alias(f"missing:{name}") for name in df.columns]
    wide = df.agg(F.count(F.lit(1)).alias("total"), *counts)
    shares = {f"percent:{n}": F.try_divide(col(f"missing:{n}") * 100.0, F.col("total")) for n in df.columns}
    wide = wide.withColumns(shares)
    return (
        one_row_per(wide, "feature", df.columns, ["missing", "percent"])
        .where(F.col("missing") > 0)
        .orderBy(F.desc("missing"), "feature")
    )


def _missing_totals(df: DataFrame) -> list:
    counts = [F.count_if(is_missing(df, name)) for name in df.columns]
    affected = sum((F.when(c > 0, 1).otherwise(0) for c in counts), F.lit(0))
    cells = sum(counts, F.lit(0).cast("bigint"))
    return [
        affected.cast("bigint").alias("columns_with_missing"),
        cells.alias("missing_cells"),
        F.try_divide(cells * 100.0, F.count(F.lit(1)) * len(df.columns)).alias("missing_percent"),
    ]


def missing_totals(df: DataFrame) -> DataFrame:
    return df.agg(*_missing_totals(df))


def profile_report(df: DataFrame, label: str) -> DataFrame:
    """Size, label balance and missing values in one row, from one pass."""
    return df.agg(
        *positive_share(label),
        F.lit(len(df.columns)).alias("columns"),
        class_ratio(label).alias("class_ratio"),
        *_missing_totals(df),
    )


def missing_shares(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(is_missing(df, name).cast("double")).alias(name) for name in columns]).first()
    return {name: row[name] or 0.0 for name in columns}


def dense_features(df: DataFrame, columns: Sequence[str], threshold: float = 0.5) -> list[str]:
    """Columns whose missing share does not exceed the threshold."""
    shares = missing_shares(df, columns)
    return [name for name in columns if shares[name] <= threshold]


def value_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value over all the columns together."""
    lows = [F.min(col(name)) for name in columns]
    highs = [F.max(col(name)) for name in columns]
    if len(columns) == 1:
        return df.agg(lows[0].alias("low"), highs[0].alias("high"))
    return df.agg(F.least(*lows).alias("low"), F.greatest(*highs).alias("high"))


def with_range_violations(df: DataFrame, ranges: Mapping[str, Sequence[float]], name: str = "violations") -> DataFrame:
    """Names of the columns whose value lies outside its allowed range.

    A range starts with the smallest and the largest value; more, as a spec's default, is ignored.
    """
    checks = [F.when(~col(column).between(*span[:2]), F.lit(column)) for column, span in ranges.items()]
    return df.withColumn(name, F.array_compact(F.array(*checks)))


def range_violations(df: DataFrame, ranges: Mapping[str, Sequence[float]]) -> DataFrame:
    """Rows outside the allowed range, per column, from one pass."""
    counts = [
        F.count_if(~col(column).between(*span[:2])).alias(f"violations:{column}")
        for column, span in ranges.items()
    ]
    return one_row_per(df.agg(*counts), "feature", list(ranges), ["violations"])
