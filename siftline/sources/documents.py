"""Metric documents as JSON: one per model, nested, with differing fields."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY_METRICS = ("accuracy", "precision", "recall", "f1")


def write_document(metrics: DataFrame, path: str, model_type: str | None = None) -> None:
    """``metrics`` is the single row of ``full_metrics``."""
    body = metrics.select(F.struct(*[F.col(c) for c in metrics.columns]).alias("evaluation_metrics"))
    if model_type is not None:
        body = body.withColumn("model_type", F.lit(model_type))
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    body.withColumn("timestamp", stamp).coalesce(1).write.json(path)


def write_training_document(spark: SparkSession, document: Mapping[str, object], path: str) -> None:
    """Metrics, settings, history, importances and parameters of one training job, with the time of writing."""
    stamped = dict(document) | {"timestamp": datetime.now().isoformat(timespec="microseconds")}
    line = spark.createDataFrame([(json.dumps(stamped),)], "value string")
    line.coalesce(1).write.text(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def evaluation_rows(documents: Mapping[str, DataFrame]) -> DataFrame:
    """One flat row per model from documents read on their own."""
    rows = None
    for model, document in documents.items():
        row = document.select(F.lit(model).alias("model"), "evaluation_metrics.*")
        rows = row if rows is None else rows.unionByName(row, allowMissingColumns=True)
    return rows


def model_comparison(documents: Mapping[str, DataFrame]) -> DataFrame:
    return evaluation_rows(documents).select("model", "f1_score", "roc_auc", "accuracy")


def _fields(df: DataFrame, parent: str) -> list[str]:
    names, schema = parent.split("."), df.schema
    for name in names:
        if name not in schema.names:
            return []
        schema = schema[name].dataType
    return list(schema.names)


def history_rows(model: str, document: DataFrame) -> DataFrame:
    """(model, stage, split, accuracy, precision, recall, f1, seconds); absent fields are NULL."""
    rows = []
    for stage in ("baseline", "tuned"):
        parent = f"training_history.{stage}"
        fields = _fields(document, parent)
        seconds = next((f for f in ("training_time", "tuning_time") if f in fields), None)
        for split in ("train", "val", "test"):
            if f"{split}_f1" not in fields:
                continue
            values = [
                (F.col(f"{parent}.{split}_{m}") if f"{split}_{m}" in fields else F.lit(None))
                .cast("double")
                .alias(m)
                for m in HISTORY_METRICS
            ]
            time = (F.col(f"{parent}.{seconds}") if seconds else F.lit(None)).cast("double")
            rows.append(
                F.struct(F.lit(stage).alias("stage"), F.lit(split).alias("split"), *values, time.alias("seconds"))
            )
    return document.select(F.inline(F.array(*rows))).select(F.lit(model).alias("model"), "*")


def importance_table(document: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(feature, importance) whether stored as one array or as two parallel arrays."""
    fields = _fields(document, "feature_importances") if "struct" in dict(document.dtypes)["feature_importances"] else []
    if fields:
        names, values = F.col("feature_importances.features"), F.col("feature_importances.importances")
    else:
        names, values = F.array(*[F.lit(f) for f in features or []]), F.col("feature_importances")
    zipped = F.arrays_zip(names.alias("feature"), values.alias("importance"))
    return document.select(F.inline(zipped))
