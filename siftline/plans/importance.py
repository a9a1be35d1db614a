"""Which features a fitted tree model uses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.plans.trees import inner_gains, saved


def gain_importance(spark: SparkSession, model: Model, features: Sequence[str]) -> DataFrame:
    """(feature, importance), largest first."""
    values = model.featureImportances.toArray()
    rows = [(name, float(value)) for name, value in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def split_importance(spark: SparkSession, model: Model, features: Sequence[str]) -> DataFrame:
    """How many splits use each feature, counted over the nodes of the saved model."""
    with saved(spark, model) as path:
        nodes = spark.read.parquet(f"{path}/data").select("nodeData.split.featureIndex").where("featureIndex >= 0")
        counts = nodes.groupBy("featureIndex").agg(F.count(F.lit(1)).alias("splits")).collect()  # one row a feature
    names = spark.createDataFrame(list(enumerate(features)), "featureIndex int, feature string")
    used = spark.createDataFrame(counts, "featureIndex int, splits bigint")
    return (
        names.join(used, "featureIndex", "left")
        .select("feature", F.coalesce("splits", F.lit(0)).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def gains_of_nodes(spark: SparkSession, model: Model, features: Sequence[str]) -> dict[str, float]:
    """The importances of a forest from its nodes: each tree's gains as shares, added over the trees, as shares again."""
    by_tree: dict[int, dict[int, float]] = {}
    for r in inner_gains(spark, model):
        by_tree.setdefault(r["treeID"], {})[r["featureIndex"]] = r["gain"]
    total = [0.0] * len(features)
    for gains in by_tree.values():
        whole = sum(gains.values())
        for place, gain in gains.items():
            total[place] += gain / whole if whole else 0.0
    return {name: value / (sum(total) or 1.0) for name, value in zip(features, total, strict=True)}
