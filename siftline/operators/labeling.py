"""From a category column to a 0/1 label, and counts of both."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.labels import mapped_label
from siftline.functions.naming import col


def with_label(df: DataFrame, category: str, label_map: Mapping[str, int], label: str = "label") -> DataFrame:
    """Label by lookup; rows of unknown or missing category are dropped."""
    return df.withColumn(label, mapped_label(category, label_map)).where(col(label).isNotNull())


def unmapped_values(df: DataFrame, category: str, label_map: Mapping[str, int]) -> DataFrame:
    """Distinct categories that the map does not know, a missing one included."""
    return df.where(mapped_label(category, label_map).isNull()).select(category).distinct()


def category_counts(df: DataFrame, category: str) -> DataFrame:
    """Rows per category, and percent of all rows including those without a category. One scan."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy())  # one row for each category
    return (
        counts.withColumn("percent", F.col("rows") / total * 100)
        .where(col(category).isNotNull())
        .orderBy(F.desc("rows"), F.asc(category))
    )


def positive_share(label: str) -> list[Column]:
    """Aggregates: rows, positives, negatives, percent of positives."""
    positive = col(label) == 1
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(positive).alias("positives"),
        F.count_if(col(label) == 0).alias("negatives"),
        F.try_divide(F.count_if(positive) * 100.0, F.count(F.lit(1))).alias("positive_percent"),
    ]


def label_distribution(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*positive_share(label))


def class_ratio(label: str) -> Column:
    """Aggregate: negatives per positive; NULL without positives."""
    positives = F.count_if(col(label) == 1)
    return F.try_divide(F.count_if(col(label) == 0).cast("double"), positives.cast("double"))


def with_class_weight(df: DataFrame, label: str, weight: str = "class_weight", ratio: float | None = None) -> DataFrame:
    """Positives weigh negatives/positives, negatives weigh 1."""
    if ratio is None:
        ratio = df.agg(class_ratio(label)).first()[0]
        if ratio is None:
            raise ValueError("class weights need at least one positive row")
    return df.withColumn(weight, F.when(col(label) == 1, F.lit(float(ratio))).otherwise(F.lit(1.0)))
