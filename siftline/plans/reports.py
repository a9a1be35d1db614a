"""Bundles of result tables for looking at data and at a model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from siftline.operators.correlation import correlation_matrix
from siftline.operators.evaluate import (
    calibration_curve,
    classification_report,
    confusion_matrix,
    full_metrics,
    metrics_long,
)
from siftline.operators.histogram import histogram, histogram_by_class
from siftline.operators.labeling import label_distribution
from siftline.operators.profile import describe
from siftline.operators.ranking import roc_curve
from siftline.session import stored


def explorer_report(df: DataFrame, features: Sequence[str], shown: int = 4, label: str = "label") -> dict[str, DataFrame]:
    """Label balance, histograms and statistics of the first features, all correlations."""
    return {
        "balance": label_distribution(df, label),
        "histograms": histogram(df, features[:shown]),
        "correlations": correlation_matrix(df, features),
        "statistics": describe(df, features[:shown]),
    }


def performance_report(
    scored: DataFrame,
    importance: DataFrame | None = None,
    history: DataFrame | None = None,
    label: str = "label",
    prediction: str = "prediction",
    score: str = "score",
    class_names: tuple[str, str] = ("0", "1"),
) -> dict[str, DataFrame]:
    """Everything that is drawn about a model, as tables. The scored rows are stored once: the model is applied once."""
    scored = stored(scored.select(label, prediction, score), "scored")
    report = {
        "metrics": metrics_long(full_metrics(scored, label, prediction, score)),
        "confusion": confusion_matrix(scored, label, prediction),
        "classes": classification_report(scored, label, prediction, class_names),
        "roc": roc_curve(scored, label, score),
        "calibration": calibration_curve(scored, label, score),
        "score_histogram": histogram_by_class(scored, [score], label, 30),
    }
    if importance is not None:
        report["importance"] = importance
    if history is not None:
        report["history"] = history
    return report
