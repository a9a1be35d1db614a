"""Evaluation queries on a score that both engines compute alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions.labels import class_text, correct_flag, mean_probability, target_level, thresholded
from siftline.operators import evaluate, ranking
from siftline.operators.histogram import histogram_by_class
from siftline.operators.labeling import with_label
from siftline.plans.tuning import best_of_two
from siftline.session import new_path
from siftline.sources.documents import evaluation_rows, model_comparison, read_document, write_document
from siftline.workload.profiling import histogram_sql
from siftline.workload.registry import LINE_MAP, LINES, lines, query, rounded, table

METRICS = ("accuracy", "precision", "recall", "f1_score")


def scored_lines(spark, sf_dir):
    labelled = with_label(lines(spark, sf_dir), "l_returnflag", LINE_MAP)
    return labelled.withColumn("prediction", thresholded(F.col("score")))


CELLS = """count_if(label = 0 AND prediction = 0) AS tn, count_if(label = 0 AND prediction = 1) AS fp,
  count_if(label = 1 AND prediction = 0) AS fn, count_if(label = 1 AND prediction = 1) AS tp"""
FOUR = """round((tp + tn) / (tn + fp + fn + tp)::DOUBLE, 9) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 9) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 9) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 9) AS f1_score"""
AUC = """(SELECT (sum(CASE WHEN label = 1 THEN mean_rank END) - count_if(label = 1) * (count_if(label = 1) + 1) / 2.0)
  / (count_if(label = 1) * count_if(label = 0)::DOUBLE)
  FROM (SELECT label, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS mean_rank
  FROM lines))"""


@query(f"WITH {LINES} SELECT {CELLS} FROM lines")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(scored_lines(spark, sf_dir), "label", "prediction")


@query(f"WITH {LINES}, c AS (SELECT {CELLS} FROM lines) SELECT {FOUR} FROM c")
def binary_metrics(spark, sf_dir):
    df = evaluate.binary_metrics(scored_lines(spark, sf_dir), "label", "prediction")
    return rounded(df, *METRICS, digits=9)


@query(
    f"""WITH {LINES}, c AS (SELECT label, 0 AS prediction FROM lines), d AS (SELECT {CELLS} FROM c)
    SELECT {FOUR} FROM d"""
)
def metrics_without_positives(spark, sf_dir):
    df = scored_lines(spark, sf_dir).withColumn("prediction", F.lit(0))
    return rounded(evaluate.binary_metrics(df, "label", "prediction"), *METRICS, digits=9)


@query(
    f"""WITH {LINES}, c AS (SELECT l_linestatus AS split, {CELLS} FROM lines GROUP BY l_linestatus)
    SELECT split, {FOUR} FROM c"""
)
def metrics_by_split(spark, sf_dir):
    df = scored_lines(spark, sf_dir).withColumnRenamed("l_linestatus", "split")
    return rounded(evaluate.binary_metrics(df, "label", "prediction", ["split"]), *METRICS, digits=9)


@query(f"WITH {LINES} SELECT round({AUC.format(score='score')}, 9) AS roc_auc")
def roc_auc(spark, sf_dir):
    return rounded(ranking.roc_auc(scored_lines(spark, sf_dir), "label", "score"), "roc_auc", digits=9)


@query(f"WITH {LINES} SELECT round({AUC.format(score='l_extendedprice')}, 9) AS roc_auc")
def roc_auc_many_scores(spark, sf_dir):
    return rounded(ranking.roc_auc(scored_lines(spark, sf_dir), "label", "l_extendedprice"), "roc_auc", digits=9)


@query(
    f"""WITH {LINES}, r AS (SELECT l_linestatus, label, rank() OVER (PARTITION BY l_linestatus ORDER BY score)
      + (count(*) OVER (PARTITION BY l_linestatus, score) - 1) / 2.0 AS mean_rank FROM lines)
    SELECT l_linestatus, round((sum(CASE WHEN label = 1 THEN mean_rank END)
      - count_if(label = 1) * (count_if(label = 1) + 1) / 2.0)
      / (count_if(label = 1) * count_if(label = 0)::DOUBLE), 9) AS roc_auc FROM r GROUP BY l_linestatus"""
)
def roc_auc_by_group(spark, sf_dir):
    df = ranking.roc_auc(scored_lines(spark, sf_dir), "label", "score", ["l_linestatus"])
    return rounded(df, "roc_auc", digits=9)


@query(
    f"""WITH {LINES}, g AS (SELECT score, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM lines GROUP BY score),
    w AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
      row_number() OVER (ORDER BY score DESC) AS place, lead(pos) OVER (ORDER BY score DESC) AS next_pos,
      lead(neg) OVER (ORDER BY score DESC) AS next_neg, sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg FROM g)
    SELECT score AS threshold, round(fp / all_neg::DOUBLE, 9) AS fpr, round(tp / all_pos::DOUBLE, 9) AS tpr
    FROM w WHERE place = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
    UNION ALL SELECT 'infinity'::DOUBLE, 0.0, 0.0"""
)
def roc_curve(spark, sf_dir):
    return rounded(ranking.roc_curve(scored_lines(spark, sf_dir), "label", "score"), "fpr", "tpr", digits=9)


@query(
    f"""WITH {LINES}, c AS (SELECT {CELLS} FROM lines),
    p AS (SELECT tn / (tn + fn)::DOUBLE AS p0, tn / (tn + fp)::DOUBLE AS r0, 2 * tn / (2 * tn + fn + fp)::DOUBLE AS f0,
      tp / (tp + fp)::DOUBLE AS p1, tp / (tp + fn)::DOUBLE AS r1, 2 * tp / (2 * tp + fn + fp)::DOUBLE AS f1,
      tn + fp AS s0, fn + tp AS s1, tn + fp + fn + tp AS n, (tn + tp) / (tn + fp + fn + tp)::DOUBLE AS acc FROM c)
    SELECT 0 AS line, 'Non-Planet' AS class, round(p0, 9) AS precision, round(r0, 9) AS recall,
      round(f0, 9) AS f1_score, s0 AS support FROM p
    UNION ALL SELECT 1, 'Planet', round(p1, 9), round(r1, 9), round(f1, 9), s1 FROM p
    UNION ALL SELECT 2, 'accuracy', NULL, NULL, round(acc, 9), n FROM p
    UNION ALL SELECT 3, 'macro avg', round((p0 + p1) / 2, 9), round((r0 + r1) / 2, 9), round((f0 + f1) / 2, 9), n FROM p
    UNION ALL SELECT 4, 'weighted avg', round((p0 * s0 + p1 * s1) / n, 9), round((r0 * s0 + r1 * s1) / n, 9),
      round((f0 * s0 + f1 * s1) / n, 9), n FROM p"""
)
def classification_report(spark, sf_dir):
    df = evaluate.classification_report(
        scored_lines(spark, sf_dir), "label", "prediction", ("Non-Planet", "Planet")
    )
    return rounded(df, "precision", "recall", "f1_score", digits=9)


@query(
    f"""WITH {LINES}
    SELECT least(greatest(ceil(score * 10) - 1, 0), 9)::INT AS bin, round(avg(score), 6) AS mean_predicted,
      round(avg(label), 6) AS fraction_positive, count(*) AS rows FROM lines GROUP BY 1"""
)
def calibration_curve(spark, sf_dir):
    df = evaluate.calibration_curve(scored_lines(spark, sf_dir), "label", "score")
    return rounded(df, "mean_predicted", "fraction_positive")


@query(f"WITH {LINES} {histogram_sql(('score',), 30, True)}")
def probability_histogram(spark, sf_dir):
    df = histogram_by_class(scored_lines(spark, sf_dir), ["score"], "label", 30)
    return rounded(rounded(df, "bin_low", "bin_high"), "density", digits=9)


@query(
    f"""WITH {LINES}, c AS (SELECT {CELLS} FROM lines), m AS (SELECT {FOUR} FROM c)
    SELECT 'accuracy' AS metric, accuracy AS score FROM m UNION ALL SELECT 'precision', precision FROM m
    UNION ALL SELECT 'recall', recall FROM m UNION ALL SELECT 'f1_score', f1_score FROM m
    UNION ALL SELECT 'roc_auc', round({AUC.format(score='score')}, 9)"""
)
def all_metrics(spark, sf_dir):
    metrics = evaluate.full_metrics(scored_lines(spark, sf_dir), "label", "prediction", "score")
    return rounded(evaluate.metrics_long(metrics), "score", digits=9)


@query(
    f"""WITH {LINES}
    SELECT sum(prediction)::BIGINT AS positives, count(*) AS rows FROM lines"""
)
def prediction_totals(spark, sf_dir):
    return evaluate.prediction_totals(scored_lines(spark, sf_dir), "prediction")


@query(
    f"""WITH {LINES} SELECT CASE WHEN prediction = 1 THEN 'Planet' ELSE 'False Positive' END AS prediction_text,
      score AS probability, l_quantity, l_extendedprice, l_discount, l_tax FROM lines"""
)
def prediction_text(spark, sf_dir):
    return scored_lines(spark, sf_dir).select(
        class_text("prediction", "Planet", "False Positive").alias("prediction_text"),
        F.col("score").alias("probability"),
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
    )


@query(
    f"""WITH {LINES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, prediction = label AS correct FROM lines"""
)
def correct_flags(spark, sf_dir):
    return scored_lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", correct_flag("prediction", "label").alias("correct")
    )


@query(
    f"""WITH {LINES}, c AS (SELECT l_shipdate AS day, {CELLS} FROM lines GROUP BY l_shipdate), m AS (SELECT {FOUR} FROM c)
    SELECT CASE WHEN f1_score >= 0.95 THEN 'target reached' WHEN f1_score >= 0.90 THEN 'close to target'
      ELSE 'below target' END AS level, count(*) AS days FROM m GROUP BY 1"""
)
def target_levels(spark, sf_dir):
    metrics = evaluate.binary_metrics(scored_lines(spark, sf_dir), "label", "prediction", ["l_shipdate"])
    return metrics.groupBy(target_level(F.col("f1_score")).alias("level")).agg(F.count(F.lit(1)).alias("days"))


@query(
    f"""WITH {LINES}, p AS (SELECT *, (score + l_quantity / 50.0 + l_tax * 10) / 3 AS mean_score FROM lines)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(mean_score, 9) AS mean_score,
      CASE WHEN mean_score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM p"""
)
def ensemble_mean_vote(spark, sf_dir):
    df = scored_lines(spark, sf_dir).withColumns(
        {"first": F.col("score"), "second": F.col("l_quantity") / 50.0, "third": F.col("l_tax") * 10}
    )
    df = df.withColumn("mean_score", mean_probability(["first", "second", "third"]))
    df = df.withColumn("prediction", thresholded(F.col("mean_score")))
    keep = df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "mean_score", "prediction")
    return rounded(keep, "mean_score", digits=9)


STAGES = f"""{LINES}, stages AS (
  SELECT 'baseline' AS stage, l_linestatus, label, prediction FROM lines
  UNION ALL SELECT 'tuned', l_linestatus, label, CASE WHEN l_quantity >= 10 THEN 1 ELSE 0 END FROM lines)"""


@query(
    f"""WITH {STAGES}, c AS (SELECT stage, {CELLS} FROM stages WHERE l_linestatus = 'O' GROUP BY stage),
    m AS (SELECT stage, {FOUR} FROM c),
    f AS (SELECT max(CASE WHEN stage = 'tuned' THEN f1_score END) AS tuned_f1,
      max(CASE WHEN stage = 'baseline' THEN f1_score END) AS baseline_f1 FROM m)
    SELECT tuned_f1, baseline_f1, CASE WHEN tuned_f1 > baseline_f1 THEN 'tuned' ELSE 'baseline' END AS chosen FROM f"""
)
def best_of_two_choice(spark, sf_dir):
    df = scored_lines(spark, sf_dir).select(
        "l_linestatus",
        "label",
        F.inline(
            F.array(
                F.struct(F.lit("baseline").alias("stage"), F.col("prediction").alias("guess")),
                F.struct(F.lit("tuned").alias("stage"), (F.col("l_quantity") >= 10).cast("int").alias("guess")),
            )
        ),
    )
    metrics = evaluate.binary_metrics(df, "label", "guess", ["stage", "l_linestatus"])
    metrics = metrics.withColumn("split", F.when(F.col("l_linestatus") == "O", "val").otherwise("test"))
    return rounded(best_of_two(metrics, "val"), "tuned_f1", "baseline_f1", digits=9)


_MODELS = {"price": "score", "quantity": "l_quantity / 50e0", "tax": "l_tax * 10e0"}


def _documents(spark, sf_dir):
    df = scored_lines(spark, sf_dir)
    documents = {}
    for name, expression in _MODELS.items():
        scored = df.withColumn("score", F.expr(expression.replace("e0", "D")))
        scored = scored.withColumn("prediction", thresholded(F.col("score")))
        path = new_path(spark, "metrics")
        write_document(evaluate.full_metrics(scored, "label", "prediction", "score"), path, name)
        documents[name] = read_document(spark, path)
    return documents


def _comparison_sql(columns):
    parts = []
    for name, expression in _MODELS.items():
        cells = CELLS.replace("prediction", f"(CASE WHEN {expression} >= 0.5 THEN 1 ELSE 0 END)")
        auc = AUC.format(score=expression)
        parts.append(
            f"""SELECT '{name}' AS model, {columns} FROM (SELECT {FOUR}, tn, fp, fn, tp, round({auc}, 9) AS roc_auc
            FROM (SELECT {cells} FROM lines))"""
        )
    return " UNION ALL ".join(parts)


@query(f"WITH {LINES} {_comparison_sql('f1_score, roc_auc, accuracy')}")
def model_comparison_table(spark, sf_dir):
    return rounded(model_comparison(_documents(spark, sf_dir)), "f1_score", "roc_auc", "accuracy", digits=9)


@query(f"WITH {LINES} {_comparison_sql('tn, fp, fn, tp, precision, recall')}")
def metric_documents(spark, sf_dir):
    rows = evaluation_rows(_documents(spark, sf_dir))
    cells = [F.col("confusion_matrix")[i][j] for i in (0, 1) for j in (0, 1)]
    df = rows.select(
        "model", *[c.alias(n) for c, n in zip(cells, ("tn", "fp", "fn", "tp"))], "precision", "recall"
    )
    return rounded(df, "precision", "recall", digits=9)


@query(
    """SELECT l_orderkey, avg(CASE WHEN l_tax > 0.04::DOUBLE THEN 1.0 ELSE 0.0 END) AS share FROM lineitem
    GROUP BY l_orderkey ORDER BY share DESC, l_orderkey LIMIT 10"""
)
def top_ten(spark, sf_dir):
    shares = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("feature")).agg(
        F.avg(F.when(F.col("l_tax") > 0.04, 1.0).otherwise(0.0)).alias("importance")
    )
    return evaluate.top_importances(shares, 10).select(
        F.col("feature").alias("l_orderkey"), F.col("importance").alias("share")
    )


@query(
    f"""WITH {LINES} SELECT position, feature, importance FROM (VALUES (0, 'l_quantity'), (1, 'l_extendedprice'),
      (2, 'l_discount'), (3, 'l_tax')) n(position, feature)
    JOIN (SELECT 0 AS p, round(avg(l_quantity), 9) AS importance FROM lines
      UNION ALL SELECT 1, round(avg(l_extendedprice), 9) FROM lines
      UNION ALL SELECT 2, round(avg(l_discount), 9) FROM lines
      UNION ALL SELECT 3, round(avg(l_tax), 9) FROM lines) ON p = position"""
)
def values_paired_with_names(spark, sf_dir):
    names = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    wide = table(spark, sf_dir, "lineitem").agg(
        F.array(*[F.avg(c) for c in names]).alias("values"), F.array(*[F.lit(c) for c in names]).alias("names")
    )
    return rounded(evaluate.importance_rows(wide, "names", "values"), "importance", digits=9)
