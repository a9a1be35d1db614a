"""Searches that fit once what differs only in how much of a fitted ensemble is used."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from siftline.plans import training
from siftline.plans.bagging import can_fit, search_forests
from siftline.plans.boosting import Growing, Member, features_of
from siftline.plans.trees import StoredForest, leaf_shares, leaf_values, staged_votes, summed
from siftline.plans.tuning import Search
from siftline.session import new_path

Settings = Mapping[str, object]
#: Where a vote of a forest or the margin of boosted trees becomes class 1.
_CUT = 0.0
_VOTES = "_votes"


@dataclass(frozen=True)
class Learner:
    """How an ensemble is fitted, and which of its settings one fit can answer for several values of.

    ``fit`` takes settings, rows and a seed. ``widest`` gives, of the values of the staged settings that a
    search asks for, those to fit with. ``votes`` gives, for a fitted model, rows and settings, each row's
    label and an array with one number a setting, above zero where class 1 is predicted. ``together``, where
    there is one, fits many settings on all but one fold each, and gives the F1 on that fold as fits end, or None
    for a table that it isn't for. ``same`` writes settings so that those are equal that mean the same fit of so many features.
    """

    name: str
    staged: tuple[str, ...]
    fit: Callable[[Settings, DataFrame, int], training.Fitted]
    widest: Callable[[Sequence[Settings]], dict]
    votes: Callable[[SparkSession, Model, DataFrame, Sequence[Settings], str], DataFrame]
    together: Callable[[DataFrame, Sequence[tuple[Sequence[Settings], int]], str, int], Iterator | None] | None = None
    same: Callable[[Settings, int], Settings] = lambda settings, width: settings


def _boosted_votes(spark, model, rows, settings, label) -> DataFrame:
    """The margin after each wanted number of rounds; a fit that ended earlier has no more to add."""
    wanted = [(0, min(int(s["n_estimators"]), model.getNumTrees)) for s in settings]
    return summed(model, rows, [label], [leaf_values(spark, model)], wanted, _VOTES)


def _boosted_together(table, jobs, fold, seed, weight, label) -> Iterator[tuple[int, list[float], float]]:
    """(job, F1 of its settings, seconds until it ended) of jobs of settings, which differ in rounds, and a fold."""
    start = time.perf_counter()
    wanted = [[int(s["n_estimators"]) for s in settings] for settings, _ in jobs]
    fits = [training.boosted_trees({**settings[0], "n_estimators": max(n)}, seed, weight, label)
            for (settings, _), n in zip(jobs, wanted, strict=True)]
    members = [Member.of(e, k) for e, (_, k) in zip(fits, jobs, strict=True)]
    found: list[dict[int, float]] = [{} for _ in jobs]
    with Growing(table, members, label, weight, fold) as grown:
        done = 0
        for rounds in sorted({n for all_n in wanted for n in all_n}):
            live = [i for i, n in enumerate(wanted) if max(n) >= rounds]
            grown.grow(rounds - done, live)
            done = rounds
            asked = [i for i in live if rounds in wanted[i]]
            for i, f1 in grown.held_f1(asked, [jobs[i][1] for i in asked]).items():
                found[i][rounds] = f1
                if rounds == max(wanted[i]):
                    yield i, [found[i][n] for n in wanted[i]], time.perf_counter() - start


def _forest_limits(settings: Settings) -> tuple[int, int]:
    depth = settings.get("max_depth")
    return int(settings.get("min_samples_split", 2)), training.MAX_DEPTH if depth is None else int(depth)


def _forest_votes(spark, model, rows, settings, label) -> DataFrame:
    """Class 1's share less a half, added over the wanted number of trees, each pruned as wanted."""
    limits = sorted({_forest_limits(s) for s in settings})
    wanted = _forest_wanted(settings, limits, model)
    if isinstance(model, StoredForest):
        return staged_votes(model, rows, [label], limits, wanted, _VOTES)
    shares = [[share - 0.5 for share in trees] for trees in leaf_shares(spark, model, limits)]
    return summed(model, rows, [label], shares, wanted, _VOTES)


def _forest_wanted(settings: Sequence[Settings], limits: list, model) -> list[tuple[int, int]]:
    return [(limits.index(_forest_limits(s)), min(int(s["n_estimators"]), model.getNumTrees)) for s in settings]


def _forest_same(settings: Settings, width: int) -> Settings:
    """Two names of a subset of features are one fit where they are as many features."""
    if "max_features" not in settings:
        return settings
    subset = training.forest({"max_features": settings["max_features"]}).getFeatureSubsetStrategy()
    return settings if subset == "auto" else {**settings, "max_features": str(features_of(subset, width))}


def _forest_together(table, jobs, fold, seed, label) -> Iterator[tuple[int, list[float], float]] | None:
    """(job, F1 of its settings, seconds until it ended) of forests of settings and all rows but a fold's.

    Tasks have all rows, binned, and some trees of a job each: they grow those and add up their votes on the fold. So it is
    for tables whose binned rows fit every task, and for those that ``training.fit_forest`` grows together.
    """
    widest = [_widest_forest(settings) for settings, _ in jobs]
    grown = [{k: v for k, v in {**settings[0], **wide}.items() if k != "min_samples_split"} for (settings, _), wide in zip(jobs, widest, strict=True)]
    estimators = [training.forest(settings, seed, label) for settings in grown]
    counts = {r[fold]: r["count"] for r in table.groupBy(fold).count().collect()}
    rows = sum(counts.values())
    least = min(rows - counts.get(k, 0) for _, k in jobs)
    if least <= training.LIBRARY_ROWS or not all(can_fit(e, table) for e in estimators[:1]):
        return None
    limits = [sorted({_forest_limits(s) for s in settings}) for settings, _ in jobs]
    asked = [([(own.index(_forest_limits(s)), int(s["n_estimators"])) for s in settings], own, k)
             for (settings, k), own in zip(jobs, limits, strict=True)]
    return search_forests(table, estimators, asked, fold, label)


def _widest_forest(settings: Sequence[Settings]) -> dict:
    limits = [_forest_limits(s) for s in settings]
    return {
        "n_estimators": max(int(s["n_estimators"]) for s in settings),
        "max_depth": max(depth for _, depth in limits),
        "min_samples_split": min(least for least, _ in limits),
    }


def boosting(weight: str | None = None, label: str = "label") -> Learner:
    """Boosted trees: the first rounds of a longer fit are the shorter fit."""
    return Learner(
        "boosting",
        ("n_estimators",),
        lambda settings, rows, seed: training.fit(training.boosted_trees(settings, seed, weight, label), rows),
        lambda settings: {"n_estimators": max(int(s["n_estimators"]) for s in settings)},
        _boosted_votes,
        lambda table, jobs, fold, seed: _boosted_together(table, jobs, fold, seed, weight, label),
    )


def forest(label: str = "label") -> Learner:
    """A forest: fewer trees are its first ones, and less depth or larger nodes to split prune it.

    Splits are chosen from the root down, so a tree that is cut at a limit is one that was grown to
    it with the same draws.
    """
    return Learner(
        "forest",
        ("n_estimators", "max_depth", "min_samples_split"),
        lambda settings, rows, seed: training.fit_forest(settings, rows, seed, label, loaded=False),
        _widest_forest,
        _forest_votes,
        lambda table, jobs, fold, seed: _forest_together(table, jobs, fold, seed, label),
        _forest_same,
    )


def stages(combinations: Sequence[Settings], staged: Sequence[str]) -> list[tuple[dict, list[int]]]:
    """Combinations that one fit answers: their common settings, and their places in the list."""
    groups: dict[str, tuple[dict, list[int]]] = {}
    for place, settings in enumerate(combinations):
        common = {name: value for name, value in settings.items() if name not in staged}
        groups.setdefault(json.dumps(common, sort_keys=True), (common, []))[1].append(place)
    return list(groups.values())


def f1_of(votes: Sequence[Column], label: str = "label") -> list[Column]:
    """F1 of class 1 where a vote is above zero, 0 where it is undefined."""
    positive = F.col(label) == 1
    out = []
    for vote in votes:
        chosen = vote > _CUT
        hits = F.count_if(chosen & positive)
        out.append(F.coalesce(F.try_divide(2.0 * hits, F.count_if(chosen) + F.count_if(positive)), F.lit(0.0)))
    return out


def _fingerprint(table: DataFrame) -> str:
    """What tells a table's rows, in any order, from others."""
    found = table.agg(F.count("*").alias("n"), F.expr(f"bit_xor(xxhash64({', '.join(map(_quoted, table.columns))}))").alias("x"))
    return json.dumps(list(found.first()))


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


class Scores:
    """Scores of fits that have ended, one small table each below ``path``: a search that is run again goes on."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        try:
            rows = spark.read.schema("key string, f1 array<double>, seconds double").parquet(f"{path}/*").collect()
        except AnalysisException:  # nothing there yet
            rows = []
        self.found = {r.key: r for r in rows}

    def get(self, key: str) -> list[float] | None:
        return list(self.found[key].f1) if key in self.found else None

    def put(self, key: str, f1: Sequence[float], seconds: float) -> None:
        rows = self.spark.createDataFrame([(key, list(f1), seconds)], "key string, f1 array<double>, seconds double")
        name = hashlib.sha256(key.encode()).hexdigest()[:32]
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}")


def staged_search(
    learner: Learner,
    combinations: Sequence[Settings],
    table: DataFrame,
    folds: int = 3,
    fold: str = "fold",
    label: str = "label",
    seed: int = 42,
    threads: int = 4,
    path: str | None = None,
    features: str = "features",
) -> Search:
    """Mean F1 of each combination over the folds, with one fit for all that differ in staged settings only.

    ``table`` carries a fold column (``stratified_folds``) and should be kept. Boosted trees of all settings and
    folds grow together, and so do forests of many rows; others go through one pool of ``threads``, the longest first; the
    rows of a fold are scored for every staged value in one pass. Scores are stored below ``path`` as fits end, by settings, fold, seed and rows,
    and fits that are found there aren't repeated. No model is kept: see ``fit_best``.
    """
    spark, start = table.sparkSession, time.perf_counter()
    combinations = [dict(c) for c in combinations]
    size = table.select(F.size(vector_to_array(features))).first()
    groups = stages([learner.same(c, size[0] if size else 0) for c in combinations], learner.staged)
    scores = Scores(spark, path or new_path(spark, "search"))
    fingerprint = _fingerprint(table)
    results = [[0.0] * folds for _ in combinations]
    jobs = [(places, common, k) for common, places in groups for k in range(folds)]
    jobs.sort(key=lambda job: -_cost(learner, [combinations[place] for place in job[0]]))

    def key_of(places: list[int], k: int) -> str:
        wanted = [combinations[place] for place in places]
        asked = {"learner": learner.name, "settings": wanted, "fold": k, "folds": folds, "seed": seed, "rows": fingerprint}
        return json.dumps(asked, sort_keys=True)

    def enter(places: list[int], k: int, values: Sequence[float]) -> None:
        for place, value in zip(places, values, strict=True):
            results[place][k] = value

    def one(job: tuple[list[int], dict, int]) -> None:
        places, common, k = job
        wanted = [combinations[place] for place in places]
        train, held = table.where(F.col(fold) != k), table.where(F.col(fold) == k)
        fitted = learner.fit({**wanted[0], **learner.widest(wanted)}, train, seed)
        rows = learner.votes(spark, fitted.model, held, wanted, label)
        votes = [F.col(_VOTES)[i] for i in range(len(wanted))]
        values = rows.agg(*(f1.alias(f"f{i}") for i, f1 in enumerate(f1_of(votes, label)))).first()
        scores.put(key_of(places, k), list(values), fitted.seconds)
        enter(places, k, values)

    new = []
    for places, common, k in jobs:
        stored_f1 = scores.get(key_of(places, k))
        if stored_f1:
            enter(places, k, stored_f1)
        else:
            new.append((places, common, k))
    asked = [([combinations[place] for place in places], k) for places, _, k in new]
    found = learner.together(table, asked, fold, seed) if learner.together and new else None
    if found is not None:
        for i, values, seconds in found:
            scores.put(key_of(new[i][0], new[i][2]), values, seconds)
            enter(new[i][0], new[i][2], values)
    else:
        with ThreadPoolExecutor(threads) as pool:
            list(pool.map(inheritable_thread_target(spark)(one), new))
    fits = len(new)
    means = [sum(row) / folds for row in results]
    return Search(combinations, means, None, time.perf_counter() - start, results, fits)


def _cost(learner: Learner, settings: Sequence[Settings]) -> int:
    depth = settings[0].get("max_depth", 1)
    return int(learner.widest(settings)["n_estimators"]) * (training.MAX_DEPTH if depth is None else int(depth))


def fit_best(learner: Learner, search: Search, rows: DataFrame, seed: int = 42) -> training.Fitted:
    """The best settings of a search as they were drawn, fitted on ``rows``."""
    return learner.fit(search.best, rows, seed)
