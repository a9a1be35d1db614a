"""Equal-width histograms between the smallest and the largest value."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.naming import col
from siftline.functions.scaling import missing_as_null


@dataclass(frozen=True)
class _Series:
    feature: str
    label: int | None
    value: Column


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """(feature, bin, bin_low, bin_high, rows), empty bins included."""
    series = [_Series(name, None, missing_as_null(col(name))) for name in columns]
    return _binned(df, series, bins).select("feature", "bin", "bin_low", "bin_high", "rows")


def histogram_by_class(df: DataFrame, columns: Sequence[str], label: str, bins: int = 30) -> DataFrame:
    """Each class is binned over its own range; ``density`` integrates to 1 per class."""
    series = [
        _Series(name, value, F.when(col(label) == value, missing_as_null(col(name))))
        for name in columns
        for value in (0, 1)
    ]
    return _binned(df, series, bins)


def _binned(df: DataFrame, series: list[_Series], bins: int) -> DataFrame:
    limits = []
    for i, s in enumerate(series):
        limits += [
            F.min(s.value).alias(f"min{i}"), F.max(s.value).alias(f"max{i}"), F.count(s.value).alias(f"rows{i}")
        ]
    row = df.agg(*limits).first()

    frame, guesses, bins_of, hits = [], [], [], []
    for i, s in enumerate(series):
        low, high, total = row[f"min{i}"], row[f"max{i}"], row[f"rows{i}"]
        if not total:
            continue
        if low == high:
            low, high = low - 0.5, high + 0.5
        step = (high - low) / bins
        frame.append((i, s.feature, s.label, low, high, step, total))
        position = F.floor((s.value - low) / (high - low) * bins)
        # least() skips NULL, so a missing value is kept out of the last bin by hand.
        guess = F.when(s.value.isNotNull(), F.least(position, F.lit(bins - 1)))
        guesses += [s.value.alias(f"value{i}"), guess.cast("int").alias(f"guess{i}")]
        bins_of.append(_bin(F.col(f"value{i}"), F.col(f"guess{i}"), low, step, bins).alias(f"bin{i}"))
        hits.append(F.struct(F.lit(i).alias("series"), F.col(f"bin{i}").alias("bin")))

    spark = df.sparkSession
    schema = "series int, feature string, label int, low double, high double, step double, total bigint"
    every_bin = spark.createDataFrame(frame, schema).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    if not hits:
        return _described(every_bin.withColumn("rows", F.lit(0)), bins)
    counts = (
        df.select(*guesses)
        .select(*bins_of)
        .select(F.inline(F.array(*hits)))
        .where(F.col("bin").isNotNull())
        .groupBy("series", "bin")
        .agg(F.count(F.lit(1)).alias("counted"))
    )
    # At most len(series) * bins rows on either side.
    joined = every_bin.join(F.broadcast(counts), ["series", "bin"], "left")
    return _described(joined.withColumn("rows", F.coalesce("counted", F.lit(0))), bins)


def _bin(value: Column, guess: Column, low: float, step: float, bins: int) -> Column:
    """Bins are closed on the left, the last one on both sides; edges are ``low + i * step``."""
    return (
        F.when(value < guess * F.lit(step) + F.lit(low), guess - 1)
        .when((value >= (guess + 1) * F.lit(step) + F.lit(low)) & (guess < bins - 1), guess + 1)
        .otherwise(guess)
    )


def _described(df: DataFrame, bins: int) -> DataFrame:
    upper = F.when(F.col("bin") == bins - 1, F.col("high")).otherwise((F.col("bin") + 1) * F.col("step") + F.col("low"))
    return df.select(
        "label",
        "feature",
        "bin",
        (F.col("bin") * F.col("step") + F.col("low")).alias("bin_low"),
        upper.alias("bin_high"),
        "rows",
        F.try_divide(F.col("rows").cast("double"), F.col("total") * F.col("step")).alias("density"),
    )
