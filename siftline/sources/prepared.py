"""The prepared table, partitioned by split, and the fitted parameters beside it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAMETER_SCHEMA = (
    "position int, feature string, median double, min double, max double, mean double, std_pop double"
)


def write_prepared(df: DataFrame, path: str, split: str = "split", mode: str = "error") -> None:
    df.write.partitionBy(split).mode(mode).parquet(path)


def read_prepared(spark: SparkSession, path: str, splits: Sequence[str] = (), split: str = "split") -> DataFrame:
    """Only the folders of the named splits are read."""
    df = spark.read.parquet(path)
    return df.where(F.col(split).isin(list(splits))) if splits else df


def parameter_table(
    spark: SparkSession,
    medians: Mapping[str, float | None],
    scales: Mapping[str, Mapping[str, float]],
) -> DataFrame:
    rows = [
        (i, name, medians.get(name), s["min"], s["max"], s["mean"], s["std_pop"])
        for i, (name, s) in enumerate(scales.items())
    ]
    return spark.createDataFrame(rows, PARAMETER_SCHEMA)


SETTINGS_SCHEMA = "method string, positive string, negative string"


def write_parameters(
    parameters: DataFrame, label_map: Mapping[str, int], path: str, method: str, positive: str, negative: str
) -> None:
    """One row per feature, one per category, and one of settings."""
    spark = parameters.sparkSession
    parameters.coalesce(1).write.parquet(f"{path}/features")
    categories = spark.createDataFrame(list(label_map.items()), "category string, label int")
    categories.coalesce(1).write.parquet(f"{path}/categories")
    settings = spark.createDataFrame([(method, positive, negative)], SETTINGS_SCHEMA)
    settings.coalesce(1).write.parquet(f"{path}/settings")


def read_parameters(spark: SparkSession, path: str) -> tuple[dict, dict, dict, dict]:
    """(medians, scales, label map, settings) in feature order. A folder without settings is an error."""
    settings = spark.read.parquet(f"{path}/settings").collect()
    if len(settings) != 1 or settings[0]["method"] is None:
        raise ValueError(f"{path} does not say how its features are scaled")
    rows = spark.read.parquet(f"{path}/features").orderBy("position").collect()
    medians = {r["feature"]: r["median"] for r in rows}
    scales = {r["feature"]: {s: r[s] for s in ("min", "max", "mean", "std_pop")} for r in rows}
    categories = spark.read.parquet(f"{path}/categories").collect()
    return medians, scales, {r["category"]: r["label"] for r in categories}, settings[0].asDict()


def preparation_summary(df: DataFrame, features: Sequence[str], label: str = "label", split: str = "split") -> DataFrame:
    """Feature count and names, rows and percent of positives per split."""
    return df.groupBy(split).agg(
        F.lit(len(features)).alias("n_features"),
        F.concat_ws(", ", *[F.lit(name) for name in features]).alias("features"),
        F.count(F.lit(1)).alias("rows"),
        (F.avg((F.col(label) == 1).cast("double")) * 100).alias("positive_percent"),
    )


def write_summary(summary: DataFrame, path: str) -> None:
    """The rows of ``preparation_summary`` as lines of JSON, one for each split."""
    summary.coalesce(1).write.json(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    schema = "split string, n_features int, features string, rows bigint, positive_percent double"
    return spark.read.schema(schema).json(path)
