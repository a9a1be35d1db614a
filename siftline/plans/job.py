"""The whole training job: baseline, search, refit with early stop, choice, test metrics, saved scorer and document."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators import evaluate
from siftline.operators.labeling import class_ratio, with_class_weight
from siftline.operators.split import stratified_folds
from siftline.operators.tables import stacked
from siftline.plans import staged, training
from siftline.plans.prepare import Preparation
from siftline.plans.scoring import Scorer
from siftline.sources.documents import HISTORY_METRICS, write_training_document

SPLITS = ("train", "val", "test")


@dataclass
class Trained:
    """What a job has found: both fits, the stage it chose, and the written document's content."""

    baseline: training.Fitted
    tuned: training.Fitted
    chosen: str
    document: dict
    scorer: Scorer

    @property
    def model(self) -> Model:
        return (self.tuned if self.chosen == "tuned" else self.baseline).model


def train_boosting(
    table: DataFrame,
    state: Preparation,
    key: Sequence[str],
    path: str,
    combinations: Sequence[Mapping],
    baseline: Mapping[str, object] = training.BOOSTING_BASELINE,
    folds: int = 3,
    patience: int = 20,
    metrics: Sequence[str] = ("logloss", "auc"),
    seed: int = 42,
    threads: int = 4,
) -> Trained:
    """Run the job on a prepared table (a stored one, as it is read often) and write its results below ``path``.

    The search scores every combination by cross-validated F1 over training and validation rows, with one
    fit for those that differ in rounds only; a job that is run again at ``path`` goes on with its scores;
    the best is fitted on the training rows and stopped early on validation. It is chosen where
    its validation F1 is higher than the baseline's. Test rows are used for nothing but metrics.
    """
    spark = table.sparkSession
    ratio = table.where(F.col("split") == "train").agg(class_ratio("label")).first()[0]
    if ratio is None:
        raise ValueError("no positive row among the training rows")
    weighted = with_class_weight(table, "label", ratio=ratio)
    rows = training.assembled(weighted, state.inputs, [*key, "label", "split", "class_weight"])
    parts = {split: rows.where(F.col("split") == split) for split in SPLITS}

    with training.Kept(parts["train"], parts["val"]) as (train, val):
        first = training.fit(training.boosted_trees(baseline, seed, "class_weight"), train)
        both = stratified_folds(stacked(train, val), "label", key, folds, seed)
        with training.Kept(both) as (folded,):
            search = staged.staged_search(
                staged.boosting("class_weight"), combinations, folded, folds, seed=seed, threads=threads,
                path=f"{path}/search",
            )
        best = training.boosted_trees(search.best, seed, "class_weight")
        second = training.fit_early_stopped(best, train, val, patience, metrics)

    history = {
        "baseline": _history(first, rows) | {"training_time": first.seconds},
        "tuned": _history(second, rows) | {"tuning_time": search.seconds + second.seconds},
    }
    better = history["tuned"]["val_f1"] > history["baseline"]["val_f1"]
    chosen = second if better else first
    document = {
        "model_type": type(chosen.model).__name__,
        "best_params": dict(search.best),
        "evaluation_metrics": _test_metrics(chosen.model, parts["test"]),
        "training_history": history,
        "feature_importances": {
            "features": state.features,
            "importances": [float(x) for x in chosen.model.featureImportances.toArray()],
        },
        "model_parameters": {
            "rounds": chosen.model.getNumTrees,
            "chosen": "tuned" if better else "baseline",
            "class_weight": ratio,
        },
    }
    scorer = Scorer.of(state, chosen.model)
    scorer.save(spark, f"{path}/scorer")
    write_training_document(spark, document, f"{path}/document")
    return Trained(first, second, "tuned" if better else "baseline", document, scorer)


def _history(fitted: training.Fitted, rows: DataFrame) -> dict[str, float]:
    """``split_metric`` of all splits, scored in one pass."""
    scored = training.scored(fitted.model, rows)
    found = {r["split"]: r for r in evaluate.binary_metrics(scored, "label", "prediction", ["split"]).collect()}
    named = zip(HISTORY_METRICS, evaluate.METRICS, strict=True)
    return {f"{split}_{short}": found[split][name] for short, name in named for split in SPLITS if split in found}


def _test_metrics(model: Model, test: DataFrame) -> dict[str, object]:
    row = evaluate.full_metrics(training.scored(model, test), "label", "prediction", "score").first()
    return row.asDict(recursive=True)
