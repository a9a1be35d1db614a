"""Several models of one kind: seed ensembles and out-of-bag voting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.hashing import key_fraction, poisson_count
from siftline.functions.labels import mean_probability, thresholded
from siftline.plans.training import (
    ENSEMBLE_DEFAULTS,
    FOREST_BASELINE,
    FOREST_PARAMS,
    Fitted,
    boosted_trees,
    fit,
    fit_all_early_stopped,
    spark_params,
    validation_f1,
)
from siftline.plans.bagging import fit_known_bags
from siftline.plans.trees import StoredForest, stored_forest, unseen_votes
from siftline.plans.tuning import first_best


@dataclass
class SeedEnsemble:
    members: list[Fitted]
    validation_f1: list[float]

    @property
    def best(self) -> int:
        return first_best(self.validation_f1)

    @property
    def models(self) -> list[Model]:
        return [m.model for m in self.members]


def fit_seed_ensemble(
    train: DataFrame,
    val: DataFrame,
    settings: Mapping[str, object] = ENSEMBLE_DEFAULTS,
    members: int = 5,
    seed: int = 42,
    patience: int = 30,
    weight: str | None = None,
    label: str = "label",
    metrics: Sequence[str] = ("logloss",),
    threads: int = 2,
) -> SeedEnsemble:
    """Members that differ in their seed, grown together; ``threads`` of them are scored at a time."""
    estimators = [boosted_trees(settings, seed + i, weight, label) for i in range(members)]
    fitted = fit_all_early_stopped(estimators, train, val, patience, metrics)

    def one(member: Fitted) -> float:
        return validation_f1(member.model, val, label)

    with ThreadPoolExecutor(threads) as pool:
        return SeedEnsemble(fitted, list(pool.map(inheritable_thread_target(train.sparkSession)(one), fitted)))


def with_member_scores(
    models: Sequence[Model], df: DataFrame, predictions: bool = False
) -> tuple[DataFrame, list[str]]:
    """Class-1 probability of every model in its own column; no shuffle. ``predictions``: keep those as well."""
    names = []
    for i, model in enumerate(models):
        renamed = {
            model.predictionCol: f"prediction_{i}",
            model.rawPredictionCol: f"raw_{i}",
            model.probabilityCol: f"probability_{i}",
        }
        extra = [name for name in renamed.values() if not (predictions and name.startswith("prediction"))]
        df = (
            model.copy(renamed)
            .transform(df)
            .withColumn(f"score_{i}", vector_to_array(f"probability_{i}")[1])
            .drop(*extra)
        )
        names.append(f"score_{i}")
    return df, names


def ensemble_scored(models: Sequence[Model], df: DataFrame, score: str = "score") -> DataFrame:
    """Mean class-1 probability; class 1 from 0.5 upwards. One model alone is its own ensemble."""
    df, names = with_member_scores(models, df)
    return (
        df.withColumn(score, mean_probability(names))
        .withColumn("prediction", thresholded(F.col(score)))
        .drop(*names)
    )


def bag_count(key: Sequence[str], bag: int, seed: int) -> Column:
    """How often a row is drawn into a bag: Poisson(1), fixed by key, bag and seed."""
    return poisson_count(key_fraction(seed * 1000 + bag, key))


def bag_counts(key: Sequence[str], bags: int, seed: int) -> Column:
    """``bag_count`` of all bags as one array of bytes' size; a hash a bag, in one expression however many bags."""
    seeds = F.sequence(F.lit(seed * 1000), F.lit(seed * 1000 + bags - 1))
    fractions = F.transform(seeds, lambda number: key_fraction(number, key))  # apart, so that a count hashes once
    return F.transform(fractions, lambda fraction: poisson_count(fraction).cast("tinyint"))


def fit_bags(
    train: DataFrame,
    key: Sequence[str],
    settings: Mapping[str, object] = FOREST_BASELINE,
    bags: int | None = None,
    seed: int = 42,
    label: str = "label",
) -> StoredForest:
    """A forest of one tree per bag with the settings of a forest, rows weighted by their count in the bag.

    Spark's own bags can't be told afterwards, so the bags are made from the keys, and the trees of all bags
    grow together. There are as many as the settings' ``n_estimators``, unless ``bags`` says otherwise.
    The subset of features is the forest's: Spark's own choice for a single tree would be all of them.
    """
    bags = int(settings.get("n_estimators", FOREST_BASELINE["n_estimators"])) if bags is None else bags
    params = spark_params({k: v for k, v in settings.items() if k != "n_estimators"}, FOREST_PARAMS)
    estimator = RandomForestClassifier(labelCol=label, numTrees=bags, seed=seed, **params)
    return fit_known_bags(estimator, train, bag_counts(key, bags, seed), bags)


def out_of_bag_scored(model: Model | StoredForest, train: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Mean class-1 share over the trees that did not see the row; NULL if every tree did.

    The forest is applied once, each tree to the rows whose packed counts say that it hasn't seen them.
    """
    forest = model if isinstance(model, StoredForest) else stored_forest(train.sparkSession, model)
    counted = train.withColumn("_counts", bag_counts(key, model.getNumTrees, seed))
    scored = unseen_votes(forest, counted, "_counts")
    return scored.withColumn(
        "oob_prediction", F.when(F.col("oob_score").isNotNull(), (F.col("oob_score") > 0.5).cast("int"))
    ).drop("_counts")


def out_of_bag_accuracy(oob: DataFrame, label: str = "label") -> DataFrame:
    return oob.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("oob_prediction").alias("rows_with_votes"),
        F.avg((F.col("oob_prediction") == F.col(label)).cast("double")).alias("oob_accuracy"),
    )
