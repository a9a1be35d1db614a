"""Training, tuning and ensemble queries. Their rows hold what is certain about a learner's result, not its values."""

from __future__ import annotations

import warnings
from contextlib import contextmanager
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from siftline.functions.hashing import POISSON_ONE_CDF
from siftline.functions.labels import thresholded
from siftline.operators import evaluate
from siftline.operators.labeling import class_ratio, with_class_weight
from siftline.operators.split import stratified_folds
from siftline.operators.tables import stacked
from siftline.operators.ranking import roc_auc
from siftline.plans import ensemble, importance, staged, training, tuning
from siftline.plans.job import train_boosting
from siftline.plans.prepare import prepare
from siftline.plans.scoring import Scorer
from siftline.plans.trees import fewest_split_rows, first_trees, root_rows
from siftline.session import new_path
from siftline.sources.documents import history_rows, importance_table, read_document
from siftline.sources.models import load_pipelines
from siftline.sources.prepared import read_prepared, write_prepared
from siftline.workload.registry import (
    ORDER_SPEC, SPLIT, TEXT_SPEC, TEXT_SPLIT, orders, query, text_features, texts,
)

# The published settings are in plans.training; the queries that are about a fit, a search or an ensemble use them.
# The small settings serve those about something else, such as saving, scoring or averaging.
SMALL_BOOSTING = {**training.BOOSTING_BASELINE, "n_estimators": 8, "max_depth": 3, "min_child_samples": 5}
SMALL_FOREST = {**training.FOREST_BASELINE, "n_estimators": 20, "max_depth": 6}
SPLITS = ("train", "val", "test")


class Tables:
    """A prepared table, stored once, with its assembled training and validation rows."""

    def __init__(self, spark, raw, spec):
        df, self.state = prepare(raw, spec)
        self.key = list(spec.key)
        path = new_path(spark, "prepared")
        write_prepared(df, path)
        self.spark, self.path, self.spec = spark, path, spec
        keep = [*self.key, "label", "split"]
        self.stored = read_prepared(spark, path)
        weighted = with_class_weight(self.stored, "label", ratio=self._ratio(self.stored))
        self.all = training.assembled(weighted, self.state.inputs, [*keep, "class_weight"])
        self.train = self.all.where(F.col("split") == "train")
        self.val = self.all.where(F.col("split") == "val")
        self.test = self.all.where(F.col("split") == "test")

    @staticmethod
    def _ratio(stored):
        ratio = stored.where(F.col("split") == "train").agg(class_ratio("label")).first()[0]
        if ratio is None:
            raise ValueError("no positive row among the training rows")
        return ratio

    @contextmanager
    def kept(self):
        with training.Kept(self.train, self.val) as tables:
            yield tables


def order_tables(spark, sf_dir):
    return Tables(spark, orders(spark, sf_dir), ORDER_SPEC)


def text_tables(spark, sf_dir):
    return Tables(spark, texts(spark, sf_dir), TEXT_SPEC)


# What is certain about a learner's rows: every key once, with the label and the split that SQL finds,
# a probability between 0 and 1, and a label that follows from it (trees and networks: class 1 above 0.5).
def _checked(scored, *keep):
    rule = F.when(F.col("score") > 0.5, 1).when(F.col("score") < 0.5, 0).otherwise(F.col("prediction"))
    return scored.select(
        *keep,
        F.col("score").between(0, 1).alias("score_valid"),
        (F.col("prediction") == rule).alias("prediction_valid"),
    )


def _checked_sql(split, key):
    return f"WITH {split} SELECT {key}, label, split, true AS score_valid, true AS prediction_valid FROM members"


def _history_rows(name, stage, fitted, tables):
    """Metrics of each split beside those counted a second way from the scored rows."""
    rows = training.history(name, stage, fitted, tables.all)
    right, hit = F.col("label") == F.col("prediction"), (F.col("label") == 1) & (F.col("prediction") == 1)
    counted = training.scored(fitted.model, tables.all).groupBy("split").agg(
        F.count("*").alias("rows"),
        F.avg(right.cast("double")).alias("c_accuracy"),
        F.coalesce(F.try_divide(F.sum(hit.cast("double")), F.sum("prediction")), F.lit(0.0)).alias("c_precision"),
        F.coalesce(F.try_divide(F.sum(hit.cast("double")), F.sum("label")), F.lit(0.0)).alias("c_recall"),
    )
    both = F.col("c_precision") + F.col("c_recall")
    f1 = F.coalesce(F.try_divide(2 * F.col("c_precision") * F.col("c_recall"), both), F.lit(0.0))
    counted = counted.withColumn("c_f1_score", f1)
    same = reduce(lambda a, b: a & b, [F.abs(F.col(m) - F.col(f"c_{m}")) < 1e-9 for m in evaluate.METRICS])
    return rows.join(counted, "split").select(
        "model", "stage", "split", "rows", same.alias("metrics_agree"), (F.col("seconds") > 0).alias("timed")
    )


def _history_sql(split, name, stage):
    return f"""WITH {split} SELECT '{name}' AS model, '{stage}' AS stage, split, count(*) AS rows,
      true AS metrics_agree, true AS timed FROM members GROUP BY split"""


def _fit_boosting(tables, settings=training.BOOSTING_BASELINE):
    with tables.kept() as (train, _):
        return training.fit(training.boosted_trees(settings, weight="class_weight"), train)


def _fit_forest(tables, settings=training.FOREST_BASELINE):
    with tables.kept() as (train, _):
        return training.fit_forest(settings, train)


def fit_seconds(spark, sf_dir):
    """Wall-clock seconds of a fit alone, on the labelled documents with the queries' settings."""
    tables = text_tables(spark, sf_dir)
    fits = {"boosting": _fit_boosting, "forest": _fit_forest}
    return {name: round(fit(tables).seconds, 3) for name, fit in fits.items()}


@query(_checked_sql(SPLIT, "o_orderkey"))
def gbt_train_score(spark, sf_dir):
    tables = order_tables(spark, sf_dir)
    scored = training.scored(_fit_boosting(tables).model, tables.all)
    return _checked(scored, "o_orderkey", "label", "split")


@query(_history_sql(TEXT_SPLIT, "boosting", "baseline"))
def gbt_history(spark, sf_dir):
    tables = text_tables(spark, sf_dir)
    return _history_rows("boosting", "baseline", _fit_boosting(tables), tables)


_PATIENCE = 20


@query(
    f"""WITH {TEXT_SPLIT} SELECT true AS rule_agrees, true AS ends_after_the_stop, true AS aucs_agree, count(*) AS rows,
      0::BIGINT AS differing FROM members"""
)
def gbt_early_stop(spark, sf_dir):
    """Stopped on log-loss and AUC with the published patience, against a fit of all rounds.

    The kept rounds are those that the rule gives for the whole fit, the kept model is its first trees, and no
    fit went beyond twice the round of the stop. The AUC of some rounds is found a second way, from a
    model that is cut there.
    """
    tables = text_tables(spark, sf_dir)
    estimator = training.boosted_trees(weight="class_weight")
    metrics = ("logloss", "auc")
    with tables.kept() as (train, val):
        stopped = training.fit_early_stopped(estimator, train, val, _PATIENCE, metrics)
        whole = training.fit(estimator, train).model
        losses = training.validation_losses(whole, val, metrics)
        agree = True
        for rounds in (1, 7, whole.getNumTrees):
            scored = training.scored(first_trees(spark, whole, rounds), val)
            again = roc_auc(scored, "label", "score").first()[0]
            agree &= again is None or abs(1 - again - losses["auc"][rounds - 1]) < 1e-9
    kept = training.rounds_by_metrics(losses, _PATIENCE)
    expected = training.scored(first_trees(spark, whole, kept), tables.all)
    expected = expected.select("doc_id", F.col("score").alias("expected"))
    rows = training.scored(stopped.model, tables.all).join(expected, "doc_id")
    bound = max(2 * _PATIENCE, 2 * (kept + _PATIENCE))
    return rows.agg(
        F.lit(kept == stopped.notes["rounds"] == stopped.model.getNumTrees).alias("rule_agrees"),
        F.lit(stopped.notes["tried"][-1] <= bound).alias("ends_after_the_stop"),
        F.lit(bool(agree)).alias("aucs_agree"),
        F.count("*").alias("rows"),
        F.count_if(F.abs(F.col("score") - F.col("expected")) > 1e-12).alias("differing"),
    )


@query("SELECT doc_id, true AS score_valid, true AS prediction_valid FROM documents")
def rf_train_score(spark, sf_dir):
    """Fitted on the labelled documents, applied to all of them."""
    tables = text_tables(spark, sf_dir)
    scorer = Scorer.of(tables.state, _fit_forest(tables).model)
    scored = scorer.transform(text_features(spark, sf_dir)).withColumnRenamed("probability", "score")
    return _checked(scored, "doc_id")


@query(_history_sql(TEXT_SPLIT, "forest", "baseline"))
def rf_history(spark, sf_dir):
    tables = text_tables(spark, sf_dir)
    return _history_rows("forest", "baseline", _fit_forest(tables), tables)


def _folds_sql(rows, folds):
    """Rows and positives of each exact stratified fold: classes one behind the other are dealt in turn."""
    return f"""fc AS (SELECT label, count(*) AS rows FROM {rows} GROUP BY label),
    fw AS (SELECT label, rows, coalesce(sum(rows) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      0) AS start FROM fc),
    ff AS (SELECT label, fold, floor((start + rows - 1 - fold) / {folds}e0) - floor((start - 1 - fold) / {folds}e0) AS size
      FROM fw, range({folds}) t(fold)),
    held AS (SELECT fold::INT AS fold, sum(size)::BIGINT AS held_rows,
      coalesce(sum(size) FILTER (label = 1), 0)::BIGINT AS held_positives FROM ff GROUP BY fold)"""


def _search_sql(combinations, folds):
    names = list(combinations[0])
    values = ", ".join(f"({i}, {', '.join(repr(str(c[n])) for n in names)})" for i, c in enumerate(combinations))
    return f"""WITH {TEXT_SPLIT}, both_parts AS (SELECT * FROM members WHERE split <> 'test'), {_folds_sql('both_parts', folds)}
    SELECT combination, {', '.join(names)}, fold, held_rows, held_positives, true AS f1_valid, true AS mean_is_of_folds,
      true AS best_is_first_largest FROM (VALUES {values}) t(combination, {', '.join(names)}), held"""


def _both(tables, folds):
    return stratified_folds(stacked(tables.train, tables.val), "label", tables.key, folds)


def _search_rows(search, folded, folds):
    """Every combination and fold once, with the rows it was scored on; the best is the first with the largest mean."""
    best = search.combinations.index(search.best)
    largest = min(i for i, score in enumerate(search.scores) if score == max(search.scores))
    rows = [
        (i, {k: str(v) for k, v in c.items()}, fold, 0 <= f1 <= 1,
         abs(sum(search.folds[i]) / folds - search.scores[i]) < 1e-12, best == largest)
        for i, c in enumerate(search.combinations) for fold, f1 in enumerate(search.folds[i])
    ]
    schema = (
        "combination int, settings map<string,string>, fold int, f1_valid boolean, mean_is_of_folds boolean,"
        " best_is_first_largest boolean"
    )
    held = folded.groupBy("fold").agg(F.count("*").alias("held_rows"), F.count_if(F.col("label") == 1).alias("held_positives"))
    scored = folded.sparkSession.createDataFrame(rows, schema).join(held, "fold")
    names = [F.col("settings")[name].alias(name) for name in search.combinations[0]]
    return scored.select(
        "combination", *names, "fold", "held_rows", "held_positives", "f1_valid", "mean_is_of_folds", "best_is_first_largest"
    )


def _searched(tables, learner, combinations, folds):
    folded = _both(tables, folds)
    with training.Kept(folded) as (kept,):
        search = staged.staged_search(learner, combinations, kept, folds, threads=8)
    return search, folded


_GRID = tuning.combinations_of(training.BOOSTING_GRID)
_FOREST_GRID = tuning.combinations_of(training.FOREST_GRID)
#: The points of the grid of forests that one fit a fold answers. All 324 ask for nine, or six where two subsets are as many features.
_ONE_FOREST = [c for c in _FOREST_GRID if c["max_features"] == "sqrt" and c["min_samples_leaf"] == 1]
# Draws of the published searches with their rounds: the first two of 100, and the second of 200 (the first one asks
# for five fits of 1,500 rounds). README.md has the time that all of them would take.
_DRAWS = {
    "boosting": tuning.drawn_combinations(training.BOOSTING_SPACE, 100, 42)[:2],
    "extended": tuning.drawn_combinations(training.EXTENDED_SPACE, 200, 42)[1:2],
}


@query(_search_sql(_GRID, 3))
def grid_search_cv(spark, sf_dir):
    """The published grid of boosted trees, but for the settings that Spark's learner lacks."""
    search, folded = _searched(text_tables(spark, sf_dir), staged.boosting("class_weight"), _GRID, 3)
    return _search_rows(search, folded, 3)


@query(_search_sql(_FOREST_GRID, 3))
def forest_grid_search_cv(spark, sf_dir):
    """All 324 points of the published grid of forests."""
    search, folded = _searched(text_tables(spark, sf_dir), staged.forest(), _FOREST_GRID, 3)
    return _search_rows(search, folded, 3)


@query(_search_sql(_DRAWS["boosting"], 3))
def random_search_cv(spark, sf_dir):
    search, folded = _searched(text_tables(spark, sf_dir), staged.boosting("class_weight"), _DRAWS["boosting"], 3)
    return _search_rows(search, folded, 3)


@query(_search_sql(_DRAWS["extended"], 5))
def random_search_extended(spark, sf_dir):
    search, folded = _searched(text_tables(spark, sf_dir), staged.boosting("class_weight"), _DRAWS["extended"], 5)
    return _search_rows(search, folded, 5)


@query(
    f"""WITH {TEXT_SPLIT} SELECT split, count(*) AS rows, true AS metrics_agree, true AS timed, true AS as_drawn
    FROM members GROUP BY split"""
)
def refit_on_train(spark, sf_dir):
    """The best of 36 points of the grid of forests, fitted on the training rows alone, with its own settings."""
    tables = text_tables(spark, sf_dir)
    search, _ = _searched(tables, staged.forest(), _ONE_FOREST, 3)
    with tables.kept() as (train, _):
        fitted = staged.fit_best(staged.forest(), search, train)
        fewest = fewest_split_rows(spark, fitted.model)
    as_drawn = fitted.model.getNumTrees == search.best["n_estimators"] and (
        fewest is None or fewest >= search.best["min_samples_split"]
    )
    rows = _history_rows("forest", "tuned", fitted, tables)
    return rows.select("split", "rows", "metrics_agree", "timed", F.lit(as_drawn).alias("as_drawn"))


@query(
    f"""WITH {TEXT_SPLIT} SELECT 5 AS members, count(*) AS rows, true AS best_is_first_largest, true AS metrics_agree
    FROM members WHERE split = 'test'"""
)
def seed_ensemble(spark, sf_dir):
    """Five members of up to 500 rounds, each stopped early, as published."""
    tables = text_tables(spark, sf_dir)
    with tables.kept() as (train, val):
        found = ensemble.fit_seed_ensemble(train, val, weight="class_weight", threads=5)
    scored = ensemble.ensemble_scored(found.models, tables.test)
    metrics = evaluate.full_metrics(scored, "label", "prediction", "score").first()
    right = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    largest = found.validation_f1.index(max(found.validation_f1))
    return scored.agg(
        F.lit(len(found.models)).alias("members"),
        F.count("*").alias("rows"),
        F.lit(found.best == largest).alias("best_is_first_largest"),
        (F.abs(right - F.lit(metrics["accuracy"])) < 1e-9).alias("metrics_agree"),
    )


@query(
    """SELECT count(*) AS rows, 0::BIGINT AS differing FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""
)
def ensemble_is_mean_of_members(spark, sf_dir):
    """Each member scored on its own and averaged must give the ensemble's score."""
    tables = text_tables(spark, sf_dir)
    with tables.kept() as (train, val):
        found = ensemble.fit_seed_ensemble(train, val, {**SMALL_BOOSTING, "n_estimators": 3}, members=3, patience=3)
    joint = ensemble.ensemble_scored(found.models, tables.all).select("doc_id", "score", "prediction")
    alone = None
    for model in found.models:
        one = training.scored(model, tables.all).select("doc_id", F.col("score").alias("own"))
        alone = one if alone is None else alone.unionByName(one)
    mean = alone.groupBy("doc_id").agg(F.avg("own").alias("mean"))
    differs = (F.abs(F.col("mean") - F.col("score")) > 1e-9) | (thresholded(F.col("score")) != F.col("prediction"))
    return joint.join(mean, "doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(differs).alias("differing")
    )


def _stopped_network(inputs, hidden, metric):
    def candidate(train, val):
        return training.fit_network_early_stopped(training.network(inputs, hidden), train, val, metric=metric)

    return candidate


@query(
    f"""WITH {TEXT_SPLIT} SELECT candidate, count(*) AS val_rows, true AS f1_valid, true AS choice_valid, true AS rule_valid
    FROM members, range(4) t(candidate) WHERE split = 'val' GROUP BY candidate"""
)
def mlp_candidates(spark, sf_dir):
    """Candidates that differ in size and in the metric that stops them; the first of the best on validation is chosen.

    The value that a candidate is kept for is found again from the kept network.
    """
    tables = text_tables(spark, sf_dir)
    inputs = len(tables.state.inputs)
    shapes = [(hidden, metric) for hidden in ((8,), (16,)) for metric in ("auc", "accuracy")]
    candidates = [_stopped_network(inputs, hidden, metric) for hidden, metric in shapes]
    with tables.kept() as (train, val):
        best, fitted, scores = tuning.select_on_validation(candidates, train, val, threads=4)
        again = [training.validation_value(f.model, val, f.notes["metric"]) for f in fitted]
    first = scores.index(max(scores))
    rows = []
    for i, (f, score, value) in enumerate(zip(fitted, scores, again, strict=True)):
        values = f.notes["values"]
        kept = f.notes["steps"] == 5 * (values.index(max(values)) + 1) and f.notes["tried"] - f.notes["steps"] <= 15
        rows.append((i, 0 <= score <= 1, (i == best) == (i == first), kept and abs(value - max(values)) < 1e-9))
    checked = spark.createDataFrame(rows, "candidate bigint, f1_valid boolean, choice_valid boolean, rule_valid boolean")
    return checked.join(F.broadcast(tables.val.agg(F.count("*").alias("val_rows"))))


@query(_checked_sql(SPLIT, "o_orderkey"))
def mlp_train_score(spark, sf_dir):
    tables = order_tables(spark, sf_dir)
    with tables.kept() as (train, val):
        network = training.network(len(tables.state.inputs))
        fitted = training.fit_network_early_stopped(network, train, val)
    return _checked(training.scored(fitted.model, tables.all), "o_orderkey", "label", "split")


def _job(spark, sf_dir):
    tables = text_tables(spark, sf_dir)
    path = new_path(spark, "job")
    done = train_boosting(tables.stored, tables.state, tables.key, path, _GRID)
    return tables, path, done


@query("SELECT true AS choice_valid, true AS f1_stored WHERE EXISTS (SELECT 1 FROM labels)")
def tuned_or_baseline(spark, sf_dir):
    """A searched model against the baseline: the stored F1 on validation decide, strictly."""
    _, path, done = _job(spark, sf_dir)
    rows = history_rows("boosting", read_document(spark, f"{path}/document"))
    scores = rows.select("stage", "split", F.col("f1").alias("f1_score"))
    best = tuning.best_of_two(scores, "val")
    return best.select(
        (F.col("chosen") == done.chosen).alias("choice_valid"),
        (F.col("tuned_f1").between(0, 1) & F.col("baseline_f1").between(0, 1)).alias("f1_stored"),
    )


@query(
    f"""WITH {TEXT_SPLIT} SELECT part, rows, true AS valid FROM (VALUES ('history', 6), ('importances', 6),
    ('best_params', 1), ('model_parameters', 1)) t(part, rows)
    UNION ALL SELECT 'evaluation_metrics', count(*), true FROM members WHERE split = 'test'"""
)
def training_job_document(spark, sf_dir):
    """The document that a training job writes has all its fields and reads back as tables; it counts the test rows."""
    tables, path, done = _job(spark, sf_dir)
    document = read_document(spark, f"{path}/document")
    history, weights = history_rows("boosting", document), importance_table(document)
    scored = training.scored(Scorer.load(spark, f"{path}/scorer").models[0], tables.test)
    again = evaluate.binary_metrics(scored, "label", "prediction").first()
    metrics = document.select("evaluation_metrics.*")
    checks = {
        "history": history.agg(F.count("*"), F.count_if(F.col("seconds") > 0) == 6),
        "importances": weights.agg(F.count("*"), F.abs(F.sum("importance") - 1) < 1e-6),
        "evaluation_metrics": metrics.agg(
            F.sum(F.aggregate(F.flatten("confusion_matrix"), F.lit(0).cast("bigint"), lambda a, n: a + n)),
            F.max(F.abs(F.col("f1_score") - again["f1_score"])) < 1e-9,
        ),
        "best_params": document.select("best_params.*").agg(
            F.count("*"), F.max(F.col("max_depth")) == done.document["best_params"]["max_depth"]
        ),
        "model_parameters": document.select("model_parameters.*").agg(F.count("*"), F.max("chosen") == done.chosen),
    }
    rows = [(part, *df.first()) for part, df in checks.items()]
    return spark.createDataFrame(rows, "part string, rows bigint, valid boolean")


_TEXT_NAMES = "(VALUES ('n_chars'), ('n_words'), ('digit_share'), ('upper_share'), ('n_lines'), ('word_length')) t(feature)"


@query(
    f"""SELECT feature, true AS valid, true AS total_is_one, true AS ordered, true AS gains_agree FROM {_TEXT_NAMES}
    WHERE EXISTS (SELECT 1 FROM labels)"""
)
def feature_importance(spark, sf_dir):
    """Importances of a forest, and the same from the gains of its nodes: shares by tree, then their mean."""
    tables = text_tables(spark, sf_dir)
    model = _fit_forest(tables, SMALL_FOREST).model
    rows = importance.gain_importance(spark, model, tables.state.features).collect()
    again = importance.gains_of_nodes(spark, model, tables.state.features)
    values = [r["importance"] for r in rows]
    one, ordered = abs(sum(values) - 1) < 1e-9, values == sorted(values, reverse=True)
    checked = [
        (r["feature"], 0 <= r["importance"] <= 1, one, ordered, abs(again[r["feature"]] - r["importance"]) < 1e-9)
        for r in rows
    ]
    return spark.createDataFrame(
        checked, "feature string, valid boolean, total_is_one boolean, ordered boolean, gains_agree boolean"
    )


@query(
    f"""WITH {TEXT_SPLIT} SELECT feature, true AS valid, true AS total_is_inner_nodes, count(*) AS root_rows
    FROM members, {_TEXT_NAMES} WHERE split = 'train' GROUP BY feature"""
)
def split_count_importance(spark, sf_dir):
    """Splits by feature; together they are the inner nodes, of which a binary tree has one less than leaves.

    Without subsampling the root of each tree has seen all training rows.
    """
    tables = text_tables(spark, sf_dir)
    model = _fit_boosting(tables, {**SMALL_BOOSTING, "subsample": 1.0}).model
    rows = importance.split_importance(spark, model, tables.state.features).collect()
    inner = sum((tree.numNodes - 1) // 2 for tree in model.trees)
    whole = sum(r["importance"] for r in rows) == inner
    seen = root_rows(spark, model)
    checked = [(r["feature"], r["importance"] >= 0, whole, seen) for r in rows]
    return spark.createDataFrame(
        checked, "feature string, valid boolean, total_is_inner_nodes boolean, root_rows bigint"
    )


_OOB_BAGS = training.FOREST_BASELINE["n_estimators"]


@query(
    f"""WITH {TEXT_SPLIT}, drawn AS (SELECT m.doc_id, count_if(u < {POISSON_ONE_CDF[0]}::DOUBLE) AS unseen FROM (
        SELECT doc_id, bag, CAST('0x' || substr(md5((42000 + bag) || ':' || doc_id), 1, 8) AS BIGINT) / 4294967296e0 AS u
        FROM members, range({_OOB_BAGS}) b(bag) WHERE split = 'train') m GROUP BY m.doc_id)
    SELECT {_OOB_BAGS} AS bags, count(*) AS rows, count_if(unseen > 0) AS rows_with_votes, sum(unseen)::BIGINT AS votes,
      true AS accuracy_valid FROM drawn"""
)
def oob_score(spark, sf_dir):
    """Out-of-bag accuracy of the published forest: every row is voted on by just those trees whose bag it isn't in."""
    tables = text_tables(spark, sf_dir)
    with tables.kept() as (train, _):
        model = ensemble.fit_bags(train, tables.key)
        scored = ensemble.out_of_bag_scored(model, train, tables.key)
        found = ensemble.out_of_bag_accuracy(scored).first()
        votes = scored.agg(F.sum("oob_votes").cast("bigint")).first()[0]
    valid = found["oob_accuracy"] is None or 0 <= found["oob_accuracy"] <= 1
    rows = [(model.getNumTrees, found["rows"], found["rows_with_votes"], votes, valid)]
    return spark.createDataFrame(rows, "bags int, rows bigint, rows_with_votes bigint, votes bigint, accuracy_valid boolean")


_DRAWN = " + ".join(f"(u >= {limit}::DOUBLE)::INT" for limit in POISSON_ONE_CDF)


@query(
    " UNION ALL ".join(
        f"""SELECT {bag} AS bag, drawn, count(*) AS rows FROM (SELECT {_DRAWN} AS drawn FROM (
        SELECT CAST('0x' || substr(md5('{42000 + bag}:' || o_orderkey), 1, 8) AS BIGINT) / 4294967296e0 AS u
        FROM orders)) GROUP BY drawn"""
        for bag in (0, 1)
    )
)
def bag_counts(spark, sf_dir):
    keys = orders(spark, sf_dir).select("o_orderkey")
    drawn = [
        F.struct(F.lit(bag).alias("bag"), ensemble.bag_count(["o_orderkey"], bag, 42).alias("drawn"))
        for bag in (0, 1)
    ]
    return keys.select(F.inline(F.array(*drawn))).groupBy("bag", "drawn").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT count(*) AS rows, 0::BIGINT AS differing FROM orders")
def saved_model_agreement(spark, sf_dir):
    """A saved and reloaded scorer gives every row the score of the original."""
    tables = order_tables(spark, sf_dir)
    with tables.kept() as (train, _):
        model = training.fit(training.forest({**SMALL_FOREST, "n_estimators": 4}), train).model
    scorer = Scorer.of(tables.state, model, ORDER_SPEC.positive_text, ORDER_SPEC.negative_text)
    path = new_path(spark, "scorer")
    scorer.save(spark, path)
    loaded = Scorer.load(spark, path)
    raw = orders(spark, sf_dir)
    before = scorer.transform(raw).select("o_orderkey", "probability", "prediction_text")
    after = loaded.transform(raw).select(
        "o_orderkey", F.col("probability").alias("again"), F.col("prediction_text").alias("text_again")
    )
    same = (F.col("probability") == F.col("again")) & (F.col("prediction_text") == F.col("text_again"))
    return before.join(after, "o_orderkey").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~same).alias("differing"))


@query(
    f"""WITH {TEXT_SPLIT} SELECT 'there' AS model, split, count(*) AS rows, 0::BIGINT AS differing FROM members GROUP BY split"""
)
def missing_model_is_skipped(spark, sf_dir):
    """Of two folders one holds no model; the one that is found scores every row as the fitted model does."""
    tables = text_tables(spark, sf_dir)
    model = training.fit(training.forest({**SMALL_FOREST, "n_estimators": 2}), tables.train).model
    path = new_path(spark, "scorer")
    Scorer.of(tables.state, model).save(spark, path)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = load_pipelines({"absent": f"{path}/nothing", "there": f"{path}/members/0"})
    scored = training.scored(model, tables.all).select("doc_id", "split", F.col("score").alias("expected"))
    rows = None
    for name, loaded in found.items():
        again = loaded.transform(tables.all).select("doc_id", vector_to_array("probability")[1].alias("score"))
        differ = F.count_if(F.abs(F.col("score") - F.col("expected")) > 1e-12).alias("differing")
        one = scored.join(again, "doc_id").groupBy("split").agg(F.count("*").alias("rows"), differ)
        one = one.select(F.lit(name).alias("model"), "split", "rows", "differing")
        rows = one if rows is None else rows.unionByName(one)
    return rows
