"""Boosted trees that grow together."""

import uuid

import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from siftline.operators.split import stratified_folds
from siftline.plans import bagging, boosting, ensemble, staged, training, tuning
from siftline.plans.trees import first_trees, saved

SETTINGS = {"n_estimators": 4, "learning_rate": 0.3, "max_depth": 4, "min_child_samples": 3}


@pytest.fixture(scope="module")
def rows(spark):
    noise = [F.pmod(F.xxhash64("key", F.lit(i)), F.lit(1000)) / 1000.0 for i in range(4)]
    df = spark.range(500).withColumnRenamed("id", "key").select("key", *(c.alias(f"x{i}") for i, c in enumerate(noise)))
    df = df.withColumn("label", ((F.col("x0") + F.col("x1") / 2 + F.col("x3") / 3) > 0.95).cast("int"))
    df = df.withColumn("w", F.when(F.col("label") == 1, 2.0).otherwise(1.0))
    return training.assembled(df, ["x0", "x1", "x2"], ["key", "label", "w"]).coalesce(1).persist()


@pytest.mark.parametrize("weight", [None, "w"])
def test_a_fit_is_that_of_the_library(rows, weight):
    estimator = training.boosted_trees(SETTINGS, weight=weight)
    own, other = boosting.fitted_model(estimator, rows), GBTClassifier.fit(estimator, rows)
    assert own.getNumTrees == 4 and own.treeWeights == other.treeWeights and own.getMaxDepth() == 4
    score = lambda model, name: training.scored(model, rows, name).select("key", name)
    both = score(own, "a").join(score(other, "b"), "key")
    assert both.where(F.abs(F.col("a") - F.col("b")) > 1e-9).count() == 0 and both.count() == 500
    assert own.featureImportances.toArray() == pytest.approx(other.featureImportances.toArray())


def test_more_fits_need_no_more_jobs(spark, rows):
    folded = stratified_folds(rows, "label", ["key"], 3).persist()

    def jobs(rates):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "search")
        grid = tuning.combinations_of({"n_estimators": [2], "max_depth": [3], "learning_rate": rates})
        search = staged.staged_search(staged.boosting(), grid, folded)
        assert search.fits == 3 * len(rates)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    # Each fit stores its scores, in a job or two; by itself it would have a job a level besides.
    assert jobs([0.1, 0.2, 0.3]) <= jobs([0.1]) + 6 * 2
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_blocks_and_sums_of_a_shuffle_give_the_same_fit(rows, monkeypatch):
    estimator = training.boosted_trees(SETTINGS)
    one = boosting.fitted_model(estimator, rows)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    monkeypatch.setattr(boosting, "CHUNK", 2)
    for size in (0, 10**9):
        monkeypatch.setattr(boosting, "DRIVER_BYTES", size)
        many = boosting.fitted_model(estimator, rows)
        score = lambda model, name: training.scored(model, rows, name).select("key", name)
        far = score(one, "a").join(score(many, "b"), "key").where(F.abs(F.col("a") - F.col("b")) > 1e-9)
        assert far.count() == 0


def test_a_growing_fit_repeats_no_round(rows, monkeypatch):
    grown = []
    grow = boosting.Growing.grow
    monkeypatch.setattr(boosting.Growing, "grow", lambda self, n, live=None: (grown.append(n), grow(self, n, live))[1])
    fitted = training.fit_early_stopped(training.boosted_trees({**SETTINGS, "n_estimators": 8}), rows, rows, 2)
    assert sum(grown) == fitted.notes["tried"][-1] <= 8


def test_no_rows_and_other_labels_are_errors(rows):
    estimator = training.boosted_trees(SETTINGS)
    with pytest.raises(ValueError, match="no rows"):
        training.fit(estimator, rows.where("key < 0"))
    with pytest.raises(ValueError, match="1 of 500 rows"):
        training.fit(estimator, rows.withColumn("label", F.when(F.col("key") == 3, 2).otherwise(F.col("label"))))


def test_known_bags_are_trees_of_the_library(spark, rows, monkeypatch):
    """Weights of one row a row: the tree is that of a forest without bags, whether nodes meet in a task or not."""
    estimator = RandomForestClassifier(numTrees=1, bootstrap=False, maxDepth=30, minInstancesPerNode=2, featureSubsetStrategy="all")
    other = estimator.fit(rows)
    ones = F.array_repeat(F.lit(1).cast("tinyint"), 3)
    for block, meet in ((25_000, 20_000), (100, 0), (100, 60)):
        monkeypatch.setattr(boosting, "BLOCK_ROWS", block)
        monkeypatch.setattr(bagging, "MEET_ROWS", meet)
        own = bagging.fit_known_bags(estimator, rows, ones, 3)
        assert own.getNumTrees == 3 and {t.depth for t in own.trees} == {other.trees[0].depth}
        score = lambda model, name: training.scored(model, rows, name).select("key", name)
        far = score(own, "a").join(score(other, "b"), "key").where(F.abs(F.col("a") - F.col("b")) > 1e-9)
        assert far.count() == 0
        assert own.featureImportances.toArray() == pytest.approx(other.featureImportances.toArray())


def test_more_bags_need_no_more_jobs(spark, rows):
    def jobs(bags):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "bags")
        model = ensemble.fit_bags(rows, ["key"], {"max_depth": 6, "max_features": "sqrt"}, bags=bags)
        assert model.getNumTrees == bags
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(12) <= jobs(2) + 2
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_deeper_forest_needs_no_more_jobs(spark, rows, monkeypatch):
    monkeypatch.setattr(training, "LIBRARY_ROWS", 0)

    def jobs(depth):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "forest")
        model = training.fit_forest({"n_estimators": 3, "max_depth": depth}, rows).model
        assert max(t.depth for t in model.trees) > 4 or depth == 2
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(None) <= jobs(2) + 2
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_forest_has_the_trees_of_the_library(spark, rows, monkeypatch):
    """Without bootstrap and subsets every tree is the library's; drawn bags repeat and leave out rows."""
    plain = {"n_estimators": 2, "max_depth": None, "min_samples_leaf": 3, "max_features": None, "bootstrap": False}
    other = training.forest(plain).fit(rows)
    score = lambda model, name: training.scored(model, rows, name).select("key", name)
    monkeypatch.setattr(training, "LIBRARY_ROWS", 0)
    monkeypatch.setattr(bagging, "BAG_ROWS", 100)
    monkeypatch.setattr(bagging, "MEET_ROWS", 60)
    own = training.fit_forest(plain, rows).model
    far = score(own, "a").join(score(other, "b"), "key").where(F.abs(F.col("a") - F.col("b")) > 1e-9)
    assert far.count() == 0
    assert own.featureImportances.toArray() == pytest.approx(other.featureImportances.toArray())
    many, few = (training.fit_forest({"n_estimators": n, "max_depth": 5}, rows).model for n in (6, 3))
    far = score(first_trees(spark, many, 3), "a").join(score(few, "b"), "key").where(F.abs(F.col("a") - F.col("b")) > 1e-9)
    assert far.count() == 0
    with saved(spark, many) as path:
        nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").where("id = 0").collect()
    drawn = [r["rawCount"] for r in nodes]
    assert len(set(drawn)) > 1 and all(400 < n < 600 for n in drawn)
    assert all(sum(r["impurityStats"]) == r["rawCount"] for r in nodes)


def test_a_forest_of_three_classes_is_the_librarys(rows, monkeypatch):
    monkeypatch.setattr(training, "LIBRARY_ROWS", 0)
    three = rows.withColumn("label", F.when(F.col("key") < 50, 2).otherwise(F.col("label")))
    assert training.fit_forest({"n_estimators": 2, "max_depth": 3}, three).model.numClasses == 3


def test_a_task_with_all_rows_grows_the_fit_of_a_job_a_level(spark, rows, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    estimators = [training.boosted_trees({**SETTINGS, "subsample": 0.7, "colsample_bytree": 0.5}, seed) for seed in (1, 2)]
    table = rows.withColumn("fold", (F.col("key") % 3).cast("int"))
    members = [boosting.Member.of(e, k) for e, k in zip(estimators, (0, 2), strict=True)]
    found = []
    for most in (boosting.ALONE_ROWS, 0):
        monkeypatch.setattr(boosting, "ALONE_ROWS", most)
        with boosting.Growing(table, members, fold="fold") as grown:
            assert grown.alone == bool(most) and grown.parts == 5
            grown.grow(1)
            grown.grow(2)
            found.append((grown.trees, grown.held_f1([0, 1], [0, 2])))
    (one, f1), (other, other_f1) = found
    assert f1 == pytest.approx(other_f1) and [len(fit) for fit in one] == [3, 3]
    for a, b in zip([t for fit in one for t in fit], [t for fit in other for t in fit], strict=True):
        assert (a.feature, a.cut, a.left) == (b.feature, b.cut, b.left)
        assert [list(s) for s in a.stats] == [pytest.approx(list(s)) for s in b.stats]


def test_more_rounds_need_no_more_jobs(spark, rows):
    def jobs(rounds):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "rounds")
        with boosting.growing(rows, [training.boosted_trees(SETTINGS)]) as grown:
            grown.grow(rounds)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(8) == jobs(2)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
