"""Evaluation of 0/1 predictions and scores against 0/1 labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.naming import col
from siftline.operators.ranking import roc_auc

METRICS = ("accuracy", "precision", "recall", "f1_score")


def confusion_cells(label: str, prediction: str) -> list[Column]:
    truth, guess = col(label), col(prediction)
    return [
        F.count_if((truth == 0) & (guess == 0)).alias("tn"),
        F.count_if((truth == 0) & (guess == 1)).alias("fp"),
        F.count_if((truth == 1) & (guess == 0)).alias("fn"),
        F.count_if((truth == 1) & (guess == 1)).alias("tp"),
    ]


def confusion_matrix(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """One row with tn, fp, fn, tp."""
    return df.groupBy(*by).agg(*confusion_cells(label, prediction))


def matrix_column() -> Column:
    """Rows are the truth, columns the prediction."""
    return F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix")


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def metric_columns() -> list[Column]:
    """Accuracy, precision, recall and F1 of class 1 from tn, fp, fn, tp; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return [
        _share(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    ]


def binary_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per group, all groups in one pass."""
    return confusion_matrix(df, label, prediction, by).select(*by, *metric_columns())


def full_metrics(df: DataFrame, label: str, prediction: str, score: str) -> DataFrame:
    """The five metrics and the confusion matrix in one row."""
    auc = roc_auc(df, label, score)
    return confusion_matrix(df, label, prediction).select(
        *metric_columns(), auc.select("roc_auc").scalar().alias("roc_auc"), matrix_column()
    )


def metrics_long(metrics: DataFrame, names: Sequence[str] = (*METRICS, "roc_auc")) -> DataFrame:
    """(metric, score) rows from a metrics row."""
    cells = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("score")) for n in names]
    return metrics.select(F.inline(F.array(*cells)))


def classification_report(
    df: DataFrame, label: str, prediction: str, class_names: tuple[str, str] = ("0", "1")
) -> DataFrame:
    """Per class, then accuracy and the plain and support-weighted averages."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def scores(hit: Column, wrongly: Column, missed: Column) -> tuple[Column, Column, Column]:
        return (
            _share(hit, hit + wrongly),
            _share(hit, hit + missed),
            _share(2 * hit, 2 * hit + wrongly + missed),
        )

    negative, positive = scores(tn, fn, fp), scores(tp, fp, fn)
    support = (tn + fp, fn + tp)
    total = tn + fp + fn + tp
    accuracy = _share(tn + tp, total)
    macro = [(a + b) / 2 for a, b in zip(negative, positive)]
    weighted = [_share(a * support[0] + b * support[1], total) for a, b in zip(negative, positive)]

    def line(position: int, name: str, values: Sequence[Column], rows: Column) -> Column:
        named = [v.alias(n) for v, n in zip(values, ("precision", "recall", "f1_score"))]
        return F.struct(F.lit(position).alias("line"), F.lit(name).alias("class"), *named, rows.alias("support"))

    nothing = F.lit(None).cast("double")
    lines = [
        line(0, class_names[0], negative, support[0]),
        line(1, class_names[1], positive, support[1]),
        line(2, "accuracy", (nothing, nothing, accuracy), total),
        line(3, "macro avg", macro, total),
        line(4, "weighted avg", weighted, total),
    ]
    return confusion_matrix(df, label, prediction).select(F.inline(F.array(*lines)))


def calibration_curve(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Mean score and share of positives per right-closed bin; empty bins are absent."""
    position = F.least(F.greatest(F.ceil(col(score) * bins) - 1, F.lit(0)), F.lit(bins - 1))
    return (
        df.where(col(score).isNotNull() & col(label).isNotNull())
        .groupBy(position.cast("int").alias("bin"))
        .agg(
            F.avg(score).alias("mean_predicted"),
            F.avg(col(label).cast("double")).alias("fraction_positive"),
            F.count(F.lit(1)).alias("rows"),
        )
    )


def prediction_totals(df: DataFrame, prediction: str) -> DataFrame:
    return df.agg(F.sum(col(prediction).cast("bigint")).alias("positives"), F.count(F.lit(1)).alias("rows"))


def importance_rows(df: DataFrame, features: str, importances: str) -> DataFrame:
    """(position, feature, importance) from two parallel arrays, paired by position."""
    zipped = F.arrays_zip(F.col(features).alias("feature"), F.col(importances).alias("importance"))
    return df.select(F.posexplode(zipped).alias("position", "pair")).select(
        "position", F.col("pair.feature").alias("feature"), F.col("pair.importance").alias("importance")
    )


def top_importances(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.desc("importance"), "feature").limit(k)
