"""Labels, class texts and flags as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.naming import col


def mapped_label(category: str, label_map: Mapping[str, int]) -> Column:
    """0/1 by lookup; an unknown or missing category gives NULL."""
    pairs = [F.lit(part) for item in label_map.items() for part in item]
    return F.create_map(*pairs)[col(category)].cast("int")


def membership_flag(category: str, members: Sequence[str]) -> Column:
    """1 for a listed category, else 0; a missing category counts as not listed."""
    return F.coalesce(col(category).isin(list(members)), F.lit(False)).cast("int")


def class_text(prediction: str, positive: str, negative: str) -> Column:
    return F.when(col(prediction) == 1, F.lit(positive)).otherwise(F.lit(negative))


def correct_flag(prediction: str, label: str) -> Column:
    return col(prediction) == col(label)


def thresholded(score: Column, threshold: float = 0.5) -> Column:
    """Class 1 from the threshold upwards, the threshold itself included."""
    return F.when(score >= threshold, 1).otherwise(0)


def target_level(f1: Column, target: float = 0.95, close: float = 0.90) -> Column:
    return (
        F.when(f1 >= target, F.lit("target reached"))
        .when(f1 >= close, F.lit("close to target"))
        .otherwise(F.lit("below target"))
    )


def mean_probability(probabilities: Sequence[str]) -> Column:
    total = F.col(probabilities[0])
    for name in probabilities[1:]:
        total = total + col(name)
    return total / len(probabilities)
