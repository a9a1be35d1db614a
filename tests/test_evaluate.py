import math
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from siftline.functions.labels import class_text, target_level, thresholded
from siftline.operators import evaluate, ranking

# Stored confusion matrices and the metrics stored beside them.
GOLDEN = [
    ((803, 165, 155, 790), (0.832723470987977, 0.8272251308900523, 0.8359788359788359, 0.8315789473684211)),
    ((808, 160, 160, 785), (0.832723470987977, 0.8306878306878307, 0.8306878306878307, 0.8306878306878307)),
    ((629, 339, 101, 844), (0.7699947726084684, 0.7134404057480981, 0.8931216931216931, 0.793233082706767)),
]


@pytest.mark.parametrize("cells,metrics", GOLDEN)
def test_stored_matrices_give_the_stored_metrics(spark, cells, metrics):
    tn, fp, fn, tp = cells
    rows = [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn + [(1, 1)] * tp
    df = spark.createDataFrame(rows, "label int, prediction int")
    assert tuple(evaluate.confusion_matrix(df, "label", "prediction").first()) == cells
    found = evaluate.binary_metrics(df, "label", "prediction").first()
    assert tuple(found) == pytest.approx(metrics, abs=1e-15)


def test_undefined_metrics_are_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, 0)], "label int, prediction int")
    row = evaluate.binary_metrics(df, "label", "prediction").first()
    assert tuple(row) == (0.5, 0.0, 0.0, 0.0)


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return won / (len(pos) * len(neg))


def brute_curve(rows):
    """Every distinct threshold from the top, then the points where nothing bends removed."""
    points, tp, fp = [], 0, 0
    for s in sorted({s for _, s in rows}, reverse=True):
        tp += sum(1 for y, x in rows if x == s and y == 1)
        fp += sum(1 for y, x in rows if x == s and y == 0)
        points.append((s, fp, tp))
    kept = []
    for i, (s, f, t) in enumerate(points):
        inner = 0 < i < len(points) - 1
        if inner:
            bend_f = points[i + 1][1] - 2 * f + points[i - 1][1]
            bend_t = points[i + 1][2] - 2 * t + points[i - 1][2]
            if bend_f == 0 and bend_t == 0:
                continue
        kept.append((s, f / fp, t / tp))
    return [(math.inf, 0.0, 0.0), *kept]


def tied_rows(n=400):
    draw = random.Random(1)
    return [
        (draw.randint(0, 1), 0.5 if draw.random() < 0.34 else round(draw.random(), draw.choice([1, 2, 6])))
        for _ in range(n)
    ]


def test_auc_with_ties_and_a_hot_score(spark):
    rows = tied_rows()
    df = spark.createDataFrame(rows, "label int, score double")
    found = ranking.roc_auc(df, "label", "score").first()[0]
    assert found == pytest.approx(brute_auc(rows), abs=1e-12)
    labelled = df.withColumn("label", F.col("label").cast("double"))
    peer = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0)
    assert found == pytest.approx(peer.evaluate(labelled), abs=1e-9)


def test_auc_by_group_and_single_class(spark):
    rows = tied_rows()
    df = spark.createDataFrame([("a", *r) for r in rows] + [("b", 1, 0.2), ("b", 1, 0.3)], "g string, label int, score double")
    found = {r["g"]: r["roc_auc"] for r in ranking.roc_auc(df, "label", "score", ["g"]).collect()}
    assert found["a"] == pytest.approx(brute_auc(rows), abs=1e-12)
    assert found["b"] is None


@pytest.mark.parametrize(
    "rows",
    [
        tied_rows(),
        [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (0, 0.5), (0, 0.4)],
        [(1, 0.5), (0, 0.5)],
        [(1, 0.5), (0, 0.5), (1, 0.2), (0, 0.2), (1, 0.1)],
    ],
)
def test_roc_curve_points(spark, rows):
    df = spark.createDataFrame(rows, "label int, score double")
    found = sorted((tuple(r) for r in ranking.roc_curve(df, "label", "score").collect()), reverse=True)
    expected = brute_curve(rows)
    assert len(found) == len(expected)
    for ours, theirs in zip(found, expected):
        assert ours == pytest.approx(theirs)


def test_missing_scores_are_left_out(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, None), (0, float("nan"))], "label int, score double")
    assert ranking.roc_auc(df, "label", "score").first()[0] == 1.0


def test_calibration_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.1), (0, 0.3), (1, 1.0)], "label int, score double")
    bins = {r["bin"]: r["rows"] for r in evaluate.calibration_curve(df, "label", "score").collect()}
    assert bins == {0: 2, 2: 1, 9: 1}


def test_report_agrees_with_the_evaluator(spark):
    draw = random.Random(2)
    rows = [(draw.randint(0, 1), draw.randint(0, 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    report = {r["class"]: r for r in evaluate.classification_report(df, "label", "prediction", ("no", "yes")).collect()}
    doubled = df.select(F.col("label").cast("double"), F.col("prediction").cast("double"))

    def peer(metric, label=1.0):
        return MulticlassClassificationEvaluator(metricName=metric, metricLabel=label).evaluate(doubled)

    assert report["yes"]["f1_score"] == pytest.approx(peer("fMeasureByLabel"))
    assert report["no"]["precision"] == pytest.approx(peer("precisionByLabel", 0.0))
    assert report["weighted avg"]["f1_score"] == pytest.approx(peer("f1"))
    assert report["accuracy"]["f1_score"] == pytest.approx(peer("accuracy"))
    assert report["accuracy"]["support"] == 200


def test_full_metrics_row(spark):
    df = spark.createDataFrame([(0, 0, 0.2), (1, 1, 0.9), (1, 0, 0.4)], "label int, prediction int, score double")
    row = evaluate.full_metrics(df, "label", "prediction", "score").first()
    assert row["confusion_matrix"] == [[1, 0], [1, 1]]
    assert row["roc_auc"] == 1.0
    assert evaluate.metrics_long(evaluate.full_metrics(df, "label", "prediction", "score")).count() == 5


def test_flags(spark):
    df = spark.createDataFrame([(0.96,), (0.92,), (0.5,)], "f double")
    assert [r[0] for r in df.select(target_level(F.col("f"))).collect()] == [
        "target reached", "close to target", "below target"
    ]
    half = spark.createDataFrame([(0.5,), (0.4999,)], "s double").select(thresholded(F.col("s")).alias("p"))
    assert [r["p"] for r in half.collect()] == [1, 0]
    texts = half.select(class_text("p", "Planet", "False Positive").alias("t"))
    assert [r["t"] for r in texts.collect()] == ["Planet", "False Positive"]
