"""Training with Spark ML: boosted trees, forests, a small network."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.naming import col
from siftline.operators.evaluate import binary_metrics
from siftline.operators.ranking import roc_auc
from siftline.plans.bagging import can_fit, fit_drawn_bags
from siftline.plans.boosting import fitted_model, growing
from siftline.plans.trees import first_trees, pruned, staged_scores
from siftline.session import ensure_checkpointing

# Baseline settings and search spaces, named as the tree libraries of the Python
# world name them, without the settings that Spark's learners lack.
BOOSTING_BASELINE = {
    "n_estimators": 100,
    "learning_rate": 0.1,
    "max_depth": 6,
    "min_child_samples": 20,
    "subsample": 0.8,
    "colsample_bytree": 0.8,
}
FOREST_BASELINE = {
    "n_estimators": 200, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1, "max_features": "sqrt",
}
BOOSTING_GRID = {
    "n_estimators": [100, 200],
    "learning_rate": [0.05, 0.1],
    "max_depth": [6, 8],
    "min_child_samples": [20],
    "subsample": [0.8],
    "colsample_bytree": [0.8],
}
FOREST_GRID = {
    "n_estimators": [100, 200, 300],
    "max_depth": [None, 10, 20, 30],
    "min_samples_split": [2, 5, 10],
    "min_samples_leaf": [1, 2, 4],
    "max_features": ["sqrt", "log2", None],
}
BOOSTING_SPACE = {
    "n_estimators": [50, 100, 200, 300, 500],
    "learning_rate": [0.01, 0.05, 0.1, 0.15, 0.2],
    "max_depth": [3, 4, 5, 6, 7, 8, 10],
    "min_child_samples": [5, 10, 20, 30, 40],
    "subsample": [0.6, 0.7, 0.8, 0.9, 1.0],
    "colsample_bytree": [0.6, 0.7, 0.8, 0.9, 1.0],
}
EXTENDED_SPACE = {
    "n_estimators": [300, 500, 700, 1000, 1500],
    "learning_rate": [0.01, 0.03, 0.05, 0.08, 0.1, 0.15],
    "max_depth": [3, 4, 5, 6, 7, 8, 10, 12],
    "min_child_samples": [5, 10, 15, 20, 30, 40],
    "subsample": [0.6, 0.7, 0.8, 0.9, 1.0],
    "colsample_bytree": [0.6, 0.7, 0.8, 0.9, 1.0],
    "min_split_gain": [0, 0.001, 0.01, 0.1],
}
ENSEMBLE_DEFAULTS = {
    "n_estimators": 500,
    "learning_rate": 0.05,
    "max_depth": 6,
    "min_child_samples": 20,
    "subsample": 0.8,
    "colsample_bytree": 0.8,
}

MAX_DEPTH = 30
#: Memory for the statistics of the nodes that a pass over the rows splits; a level is one pass where they fit.
GROUP_MB = 1024
#: Training rows for each task, at least: small tables are fitted by few tasks, as a fit is hundreds of short jobs.
ROWS_PER_TASK = 20_000
#: Rows up to which the library's own forest, some short jobs a level, ends sooner than trees that grow together.
LIBRARY_ROWS = 5_000


def _depth(value: int | None) -> int:
    return MAX_DEPTH if value is None or value < 0 else value


def _subset(value: str | float | None) -> str:
    if value is None:
        return "all"
    return value if isinstance(value, str) else str(float(value))


BOOSTING_PARAMS = {
    "n_estimators": ("maxIter", int),
    "learning_rate": ("stepSize", float),
    "max_depth": ("maxDepth", _depth),
    "min_child_samples": ("minInstancesPerNode", int),
    "subsample": ("subsamplingRate", float),
    "colsample_bytree": ("featureSubsetStrategy", _subset),
    "min_split_gain": ("minInfoGain", float),
}
FOREST_PARAMS = {
    "n_estimators": ("numTrees", int),
    "max_depth": ("maxDepth", _depth),
    "min_samples_leaf": ("minInstancesPerNode", int),
    "max_features": ("featureSubsetStrategy", _subset),
    "bootstrap": ("bootstrap", bool),
}
# Settings that have no counterpart in Spark but mean "off" at these values.
_NEUTRAL = {
    "min_samples_split": (2,),
    "reg_alpha": (0,),
    "reg_lambda": (0,),
    "subsample_freq": (0,),
    "boosting_type": ("gbdt",),
}


def spark_params(settings: Mapping[str, object], known: Mapping[str, tuple[str, Callable]]) -> dict[str, object]:
    """Spark names and values; a setting that Spark cannot express is an error."""
    params = {}
    for name, value in settings.items():
        if name in known:
            spark_name, convert = known[name]
            params[spark_name] = convert(value)
        elif value not in _NEUTRAL.get(name, ()):
            raise ValueError(f"{name}={value!r} has no counterpart in Spark's tree learners")
    return params


def boosted_trees(settings: Mapping[str, object] = BOOSTING_BASELINE, seed: int = 42, weight: str | None = None, label: str = "label") -> GBTClassifier:
    params = spark_params(settings, BOOSTING_PARAMS)
    if weight:
        params["weightCol"] = weight
    return GBTClassifier(labelCol=label, seed=seed, **params)


def forest(settings: Mapping[str, object] = FOREST_BASELINE, seed: int = 42, label: str = "label") -> RandomForestClassifier:
    """A forest whose rows remember their node, so that growing trees aren't sent out again for every group of nodes."""
    params = spark_params(settings, FOREST_PARAMS)
    return RandomForestClassifier(labelCol=label, seed=seed, cacheNodeIds=True, maxMemoryInMB=GROUP_MB, **params)


def fit_forest(
    settings: Mapping[str, object], train: DataFrame, seed: int = 42, label: str = "label", loaded: bool = True
) -> Fitted:
    """A fitted forest, of many rows with trees that grow together; with ``min_samples_split`` no node of fewer rows is split.

    Trees that grew together stay a stored forest unless it is to be ``loaded``, into the driver's memory.
    """
    settings, least = dict(settings), int(settings.get("min_samples_split", 2))
    settings.pop("min_samples_split", None)
    estimator = forest(settings, seed, label)
    start = time.perf_counter()
    together = train.count() > LIBRARY_ROWS and can_fit(estimator, train)
    model = fit_drawn_bags(estimator, train) if together else fit(estimator, train).model
    if least > 2:
        model = pruned(train.sparkSession, model, least)
    model = model.load() if together and loaded else model
    return Fitted(model, time.perf_counter() - start)


def network(
    inputs: int,
    hidden: Sequence[int] = (8,),
    max_iter: int = 100,
    step_size: float | None = None,
    seed: int = 42,
    label: str = "label",
) -> MultilayerPerceptronClassifier:
    """A feed-forward network; a different model from an attention network over features.

    A step size belongs to gradient descent and chooses it; without one the quasi-Newton solver
    finds its own steps.
    """
    chosen = {} if step_size is None else {"solver": "gd", "stepSize": step_size}
    return MultilayerPerceptronClassifier(
        labelCol=label, layers=[inputs, *hidden, 2], maxIter=max_iter, seed=seed, **chosen
    )


def with_vector(df: DataFrame, inputs: Sequence[str], output: str = "features") -> DataFrame:
    """A dense vector of the columns in the given order; a missing value is an error.

    The assembler can't read a name with a dot, so it gets columns under names of their own.
    """
    places = {f"_input_{k}": col(name) for k, name in enumerate(inputs)}
    assembler = VectorAssembler(inputCols=list(places), outputCol=output, handleInvalid="error")
    return assembler.transform(df.withColumns(places)).drop(*places)


def assembled(df: DataFrame, inputs: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The vector beside the kept columns."""
    return with_vector(df, inputs).select(*map(col, keep), "features")


def scored(model: Model, df: DataFrame, score: str = "score") -> DataFrame:
    """Integer prediction and class-1 probability; no shuffle."""
    result = model.transform(df)
    return (
        result.withColumn(score, vector_to_array("probability")[1])
        .withColumn("prediction", F.col("prediction").cast("int"))
        .drop("rawPrediction", "probability")
    )


def confidence(probability: str = "probability"):
    """The larger of the two class probabilities."""
    return F.array_max(vector_to_array(probability))


def validation_f1(model: Model, df: DataFrame, label: str = "label") -> float:
    return binary_metrics(model.transform(df), label, "prediction").first()["f1_score"]


@dataclass
class Fitted:
    """A model, how long its fit took, and what was chosen on the way."""

    model: Model
    seconds: float
    notes: dict = field(default_factory=dict)


def gathered(df: DataFrame) -> DataFrame:
    """A stored table's rows in no more partitions than their number asks for."""
    parts = max(1, -(-df.count() // ROWS_PER_TASK))
    return df.coalesce(parts)


class Kept:
    """Hold the rows of a training table on the executors while it is used repeatedly."""

    def __init__(self, *tables: DataFrame):
        self.tables = tuple(gathered(table) for table in tables)

    def __enter__(self) -> tuple[DataFrame, ...]:
        return tuple(t.persist(StorageLevel.MEMORY_AND_DISK) for t in self.tables)

    def __exit__(self, *_) -> None:
        for table in self.tables:
            table.unpersist()


def fit(estimator: Estimator, train: DataFrame) -> Fitted:
    ensure_checkpointing(train.sparkSession)
    start = time.perf_counter()
    model = fitted_model(estimator, train) if isinstance(estimator, GBTClassifier) else estimator.fit(train)
    return Fitted(model, time.perf_counter() - start)


def rounds_to_keep(losses: Sequence[float], patience: int) -> int:
    """Rounds up to the best one before ``patience`` rounds passed without a gain."""
    best, _ = _stop(losses, patience)
    return best + 1


def _stop(losses: Sequence[float], patience: int) -> tuple[int, int]:
    """(best round, round at which the rule stops) from 0; the number of rounds where it doesn't stop."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best, i
    return best, len(losses)


def rounds_by_metrics(losses: Mapping[str, Sequence[float]], patience: int) -> int:
    """Rounds kept by the metric that stops first, the first one on a tie; smaller is better for all."""
    best, _ = min((_stop(values, patience) for values in losses.values()), key=lambda stop: stop[1])
    return best + 1


def validation_losses(
    model: Model, val: DataFrame, metrics: Sequence[str] = ("logloss",), label: str = "label"
) -> dict[str, list[float]]:
    """Per metric its loss after every round: log-loss, or 1 - AUC."""
    spark, losses = val.sparkSession, {}
    for metric in metrics:
        if metric == "logloss":
            losses[metric] = [float(x) for x in model.evaluateEachIteration(val)]
        elif metric == "auc":
            rows = staged_scores(spark, model, val.select(label, "features")).select(label, "round", "score")
            found = {r["round"]: r["roc_auc"] for r in roc_auc(rows, label, "score", ["round"]).collect()}
            losses[metric] = [1 - (0.5 if found[k + 1] is None else found[k + 1]) for k in range(len(found))]
        else:
            raise ValueError(f"early stopping knows logloss and auc, not {metric!r}")
    return losses


def fit_early_stopped(
    estimator: GBTClassifier,
    train: DataFrame,
    val: DataFrame,
    patience: int = 20,
    metrics: Sequence[str] = ("logloss",),
) -> Fitted:
    """Fit until ``patience`` rounds pass without a gain on validation, and keep the trees up to the best round.

    The fit grows: twice the patience first, then twice as many rounds as before, until the rule
    has stopped or ``maxIter`` is reached. It goes on from where it was, so no round is fitted twice, and
    no fit goes beyond twice the round of the stop. With several metrics the one that stops first decides.
    """
    return fit_all_early_stopped([estimator], train, val, patience, metrics)[0]


def fit_all_early_stopped(
    estimators: Sequence[GBTClassifier],
    train: DataFrame,
    val: DataFrame,
    patience: int = 20,
    metrics: Sequence[str] = ("logloss",),
) -> list[Fitted]:
    """``fit_early_stopped`` of estimators that differ in settings and seeds only and grow together.

    The seconds of a fit are those until it stopped, in which the others grew as well.
    """
    most, spark = [e.getMaxIter() for e in estimators], train.sparkSession
    rounds, tried = [min(n, 2 * patience) for n in most], [[] for _ in estimators]
    done: dict[int, Fitted] = {}
    start = time.perf_counter()
    with growing(train, estimators) as grown:
        while live := [i for i in range(len(estimators)) if i not in done]:
            # All that are live have as many rounds, but for those that may have fewer altogether.
            for goal in sorted({rounds[i] for i in live}):
                ahead = [i for i in live if rounds[i] >= goal]
                grown.grow(goal - len(grown.trees[ahead[0]]), ahead)

            def judged(i: int) -> tuple[Model, dict[str, list[float]]]:
                model = grown.model(i, estimators[i])
                return model, validation_losses(model, val, metrics, estimators[i].getLabelCol())

            with ThreadPoolExecutor(4) as pool:
                found = list(pool.map(inheritable_thread_target(spark)(judged), live))
            for i, (model, losses) in zip(live, found, strict=True):
                tried[i].append(rounds[i])
                stopped = any(_stop(values, patience)[1] < rounds[i] for values in losses.values())
                if not stopped and rounds[i] < most[i]:
                    rounds[i] = min(most[i], 2 * rounds[i])
                    continue
                keep = rounds_by_metrics(losses, patience)
                notes = {"rounds": keep, "losses": next(iter(losses.values())), "all_losses": losses, "tried": tried[i]}
                kept = model if keep == rounds[i] else first_trees(spark, model, keep)
                done[i] = Fitted(kept, time.perf_counter() - start, notes)
    return [done[i] for i in range(len(estimators))]


def validation_value(model: Model, val: DataFrame, metric: str, label: str = "label") -> float:
    """Accuracy or AUC on validation rows; larger is better, and an undefined AUC counts as 0.5."""
    rows = scored(model, val)
    if metric == "accuracy":
        return binary_metrics(rows, label, "prediction").first()["accuracy"]
    if metric == "auc":
        found = roc_auc(rows, label, "score").first()["roc_auc"]
        return 0.5 if found is None else found
    raise ValueError(f"a network stops on accuracy or auc, not {metric!r}")


def fit_network_early_stopped(
    estimator: MultilayerPerceptronClassifier,
    train: DataFrame,
    val: DataFrame,
    patience: int = 15,
    steps: int = 5,
    metric: str = "auc",
) -> Fitted:
    """Fit ``steps`` at a time, each time from the weights reached, until ``patience`` steps pass without a gain.

    The network with the best value on validation is kept, the first one on a tie. ``maxIter`` bounds all
    steps together. A restart forgets the solver's curvature, so a fit in pieces isn't the fit in one go.
    """
    most, done, seconds, weights, best, values = estimator.getMaxIter(), 0, 0.0, None, None, []
    while done < most:
        now = min(steps, most - done)
        settings = {estimator.maxIter: now} | ({} if weights is None else {estimator.initialWeights: weights})
        fitted = fit(estimator.copy(settings), train)
        done, seconds, weights = done + now, seconds + fitted.seconds, fitted.model.weights
        values.append(validation_value(fitted.model, val, metric, estimator.getLabelCol()))
        if best is None or values[-1] > best[0]:
            best = (values[-1], done, fitted.model)
        elif done - best[1] >= patience:
            break
    return Fitted(best[2], seconds, {"metric": metric, "values": values, "steps": best[1], "tried": done})


def history(model_name: str, stage: str, fitted: Fitted, table: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """One row per split, all splits scored in one pass."""
    metrics = binary_metrics(scored(fitted.model, table), label, "prediction", [split])
    return metrics.select(
        F.lit(model_name).alias("model"), F.lit(stage).alias("stage"), "*", F.lit(fitted.seconds).alias("seconds")
    )
