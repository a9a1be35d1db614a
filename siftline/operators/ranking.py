"""Cumulative class counts over ordered scores, without a global sort in one task.

Rows are first counted per distinct score, so a score shared by a third of the table is one row
from there on. The distinct scores are cut into buckets at approximate quantiles of the rows; a
window runs inside a bucket only, and buckets are chained by their totals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.naming import col
from siftline.functions.scaling import missing_as_null
from siftline.operators.quantiles import balanced_edges


def score_counts(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, pos, neg) per distinct score, with the bucket of the score."""
    rows = df.select(*by, col(label).alias("label"), missing_as_null(col(score)).alias("score")).where(
        F.col("score").isNotNull() & F.col("label").isNotNull()
    )
    counts = rows.groupBy(*by, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = [-math.inf, *(balanced_edges(rows, F.col("score"), parts) or [0.0]), math.inf]
    return Bucketizer(splits=edges, inputCol="score", outputCol="bucket").transform(counts)


def _bucket_totals(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per bucket (at most 4096 per group), chained from the top."""
    above = Window.partitionBy(*by).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    next_lower = Window.partitionBy(*by).orderBy(F.desc("bucket"))
    group = Window.partitionBy(*by)
    return (
        counts.groupBy(*by, "bucket")
        .agg(
            F.sum("pos").alias("bucket_pos"),
            F.sum("neg").alias("bucket_neg"),
            F.max_by(F.struct("pos", "neg"), "score").alias("highest"),
        )
        .select(
            *by,
            "bucket",
            F.coalesce(F.sum("bucket_pos").over(above), F.lit(0)).alias("pos_above"),
            F.coalesce(F.sum("bucket_neg").over(above), F.lit(0)).alias("neg_above"),
            F.lead("highest").over(next_lower).alias("next_highest"),
            F.sum("bucket_pos").over(group).alias("all_pos"),
            F.sum("bucket_neg").over(group).alias("all_neg"),
        )
    )


def ranked_scores(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: pos, neg, and tp, fp counted from the highest score down to it.

    ``next_pos`` and ``next_neg`` are the counts at the next lower score, NULL at the lowest;
    ``all_pos`` and ``all_neg`` are the class totals.
    """
    counts = score_counts(df, label, score, by)
    inside = Window.partitionBy(*by, "bucket").orderBy(F.desc("score"))
    following = F.lead(F.struct("pos", "neg")).over(inside)
    return (
        counts.select(
            *by,
            "bucket",
            "score",
            "pos",
            "neg",
            F.sum("pos").over(inside).alias("tp_inside"),
            F.sum("neg").over(inside).alias("fp_inside"),
            following.alias("following"),
        )
        .join(_bucket_totals(counts, by), [*by, "bucket"])
        .withColumn("following", F.coalesce("following", "next_highest"))
        .select(
            *by,
            "score",
            "pos",
            "neg",
            (F.col("tp_inside") + F.col("pos_above")).alias("tp"),
            (F.col("fp_inside") + F.col("neg_above")).alias("fp"),
            F.col("following.pos").alias("next_pos"),
            F.col("following.neg").alias("next_neg"),
            "all_pos",
            "all_neg",
        )
    )


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counted half; NULL when a class is absent."""
    counts = score_counts(df, label, score, by)
    inside = Window.partitionBy(*by, "bucket").orderBy(F.desc("score"))
    above = Window.partitionBy(*by).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    buckets = (
        counts.withColumn("won", neg * (F.sum("pos").over(inside) - pos / 2))
        .groupBy(*by, "bucket")
        .agg(F.sum(pos).alias("pos"), F.sum(neg).alias("neg"), F.sum("won").alias("won"))
        .withColumn("pos_above", F.coalesce(F.sum("pos").over(above), F.lit(0.0)))
    )
    won = F.sum(F.col("won") + F.col("neg") * F.col("pos_above"))
    return buckets.groupBy(*by).agg(F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def roc_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(threshold, fpr, tpr) where the curve bends; the first point has an infinite threshold."""
    ranked = ranked_scores(df, label, score, by)
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    last = F.col("next_pos").isNull()
    bends = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    zero = F.lit(0).cast("bigint")
    origin = F.struct(F.lit(math.inf).alias("threshold"), zero.alias("tp"), zero.alias("fp"))
    here = F.struct(F.col("score").alias("threshold"), "tp", "fp")
    points = F.when(first, F.array(origin, here)).otherwise(F.array(here))
    return (
        ranked.where(first | last | bends)
        .select(*by, "all_pos", "all_neg", F.inline(points))
        .select(
            *by,
            "threshold",
            F.try_divide(F.col("fp").cast("double"), F.col("all_neg")).alias("fpr"),
            F.try_divide(F.col("tp").cast("double"), F.col("all_pos")).alias("tpr"),
        )
    )
