"""Fitted ensembles as tables, staged searches, fits that stop, out-of-bag votes."""

import pytest
from pyspark.sql import functions as F

from siftline.functions.hashing import POISSON_ONE_CDF
from siftline.operators.split import stratified_folds
from siftline.plans import bagging, ensemble, staged, training, trees, tuning

FOREST = {"n_estimators": 7, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1, "max_features": "sqrt"}


@pytest.fixture(scope="module")
def rows(spark):
    """A label that two of three features give, with noise, and validation rows apart."""
    noise = [F.pmod(F.xxhash64("key", F.lit(i)), F.lit(1000)) / 1000.0 for i in range(4)]
    df = spark.range(600).withColumnRenamed("id", "key").select("key", *(c.alias(f"x{i}") for i, c in enumerate(noise)))
    df = df.withColumn("label", ((F.col("x0") + F.col("x1") / 2 + F.col("x3") / 3) > 0.95).cast("int"))
    table = training.assembled(df, ["x0", "x1", "x2"], ["key", "label"]).coalesce(1).persist()
    return {"all": table, "train": table.where("key % 4 <> 0"), "val": table.where("key % 4 = 0")}


@pytest.fixture(scope="module")
def forest(rows):
    return training.fit_forest(FOREST, rows["train"]).model


@pytest.fixture(scope="module")
def folded(rows):
    return stratified_folds(rows["all"], "label", ["key"], 3).persist()


def _nodes(spark, model):
    with trees.saved(spark, model) as path:
        return trees._read(spark, path, "data").select("treeID", "nodeData.*").collect()


def _f1(model, df):
    hits, chosen, positives = model.transform(df).agg(
        F.count_if((F.col("prediction") == 1) & (F.col("label") == 1)),
        F.count_if(F.col("prediction") == 1),
        F.count_if(F.col("label") == 1),
    ).first()
    return 2 * hits / (chosen + positives) if chosen + positives else 0.0


@pytest.mark.parametrize("least,depth", [(10, 30), (2, 3), (40, 5), (10_000, 30), (2, 30)])
def test_pruned_trees_have_no_split_below_the_limit(spark, forest, rows, least, depth):
    model = trees.pruned(spark, forest, least, depth)
    before = {(r.treeID, r.id): r for r in _nodes(spark, forest)}
    after = {(r.treeID, r.id): r for r in _nodes(spark, model)}
    inner = [r for r in after.values() if r.leftChild >= 0]
    assert all(r.rawCount >= least for r in inner) and max(t.depth for t in model.trees) <= depth
    assert len(inner) == _kept_splits(before, least, depth)
    for r in inner:  # the rows of a node are those of its children
        children = [after[r.treeID, child] for child in (r.leftChild, r.rightChild)]
        assert sum(c.rawCount for c in children) == r.rawCount
    if least == 2 and depth == 30:
        same = model.transform(rows["val"]).select("key", "probability").exceptAll(
            forest.transform(rows["val"]).select("key", "probability")
        )
        assert same.count() == 0


def _kept_splits(nodes, least, depth):
    def walk(tree, node, level):
        r = nodes[tree, node]
        if r.leftChild < 0 or r.rawCount < least or level >= depth:
            return 0
        return 1 + walk(tree, r.leftChild, level + 1) + walk(tree, r.rightChild, level + 1)

    return sum(walk(tree, 0, 0) for tree in {tree for tree, _ in nodes})


def test_a_fit_with_large_splits_only(spark, rows):
    model = training.fit_forest({**FOREST, "min_samples_split": 30}, rows["train"]).model
    assert trees.fewest_split_rows(spark, model) >= 30 and model.getNumTrees == 7
    with pytest.raises(ValueError, match="min_samples_split"):
        training.forest({"min_samples_split": 30})


def test_merged_forest_votes_like_its_parts(spark, rows):
    parts = [training.fit_forest({**FOREST, "n_estimators": n}, rows["train"], seed).model for n, seed in ((2, 1), (3, 2))]
    whole = trees.merged(spark, parts)
    assert whole.getNumTrees == 5
    joined = training.scored(whole, rows["val"]).select("key", "score")
    for k, part in enumerate(parts):
        joined = joined.join(training.scored(part, rows["val"]).select("key", F.col("score").alias(f"s{k}")), "key")
    assert joined.where(F.abs(F.col("score") * 5 - F.col("s0") * 2 - F.col("s1") * 3) > 1e-9).count() == 0


def test_another_layout_is_an_error(spark, forest):
    with trees.saved(spark, forest) as path:
        spark.read.parquet(f"{path}/data").withColumn("more", F.lit(1)).write.parquet(f"{path}/other")
        with pytest.raises(ValueError, match="unknown layout"):
            trees._read(spark, path, "other")


def test_staged_search_equals_single_fits_of_boosted_trees(folded):
    grid = tuning.combinations_of({"n_estimators": [6, 2, 4], "max_depth": [2, 3], "learning_rate": [0.3]})
    one = staged.staged_search(staged.boosting(), grid, folded)
    each = tuning.cross_validated(training.boosted_trees({}), grid, training.BOOSTING_PARAMS, folded)
    assert one.scores == pytest.approx(each.scores) and one.fits == 2 * 3 and one.best == each.best
    assert [sum(f) / 3 for f in one.folds] == pytest.approx(one.scores)


def test_staged_search_equals_pruned_forests(spark, folded):
    grid = tuning.combinations_of(
        {"n_estimators": [5, 3], "max_depth": [None, 3], "min_samples_split": [2, 40], "max_features": ["sqrt", None]}
    )
    search = staged.staged_search(staged.forest(), grid, folded, folds=3)
    assert len(search.scores) == 16 and search.fits == 2 * 3
    for fold in (0, 2):
        train, held = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        whole = training.fit_forest({"n_estimators": 5, "max_depth": None, "max_features": "sqrt"}, train).model
        for settings, f1 in zip(search.combinations, search.folds, strict=True):
            if settings["max_features"] == "sqrt":
                model = trees.first_trees(spark, whole, settings["n_estimators"])
                model = trees.pruned(spark, model, settings["min_samples_split"], settings["max_depth"] or 30)
                assert f1[fold] == pytest.approx(_f1(model, held))


def test_a_search_that_is_run_again_goes_on(folded, tmp_path, monkeypatch):
    grid = tuning.combinations_of({"n_estimators": [1, 2], "max_depth": [2, 3]})
    learner = staged.boosting()
    first = staged.staged_search(learner, grid[:2], folded, path=str(tmp_path / "s"))
    more = staged.staged_search(learner, grid, folded, path=str(tmp_path / "s"))
    again = staged.staged_search(learner, grid, folded, path=str(tmp_path / "s"))
    other = staged.staged_search(learner, grid[:2], folded.where("key <> 7"), path=str(tmp_path / "s"))
    assert (first.fits, again.fits, other.fits) == (6 if _groups(grid[:2]) == 2 else 3, 0, first.fits)
    assert again.scores == more.scores and more.scores[: len(first.scores)] == pytest.approx(first.scores)


def _groups(grid):
    return len(staged.stages(grid, ("n_estimators",)))


def test_best_of_a_search_is_fitted_as_it_was_asked_for(rows, folded):
    grid = tuning.combinations_of({"n_estimators": [2, 4], "max_depth": [2], "min_samples_split": [50]})
    search = staged.staged_search(staged.forest(), grid, folded)
    fitted = staged.fit_best(staged.forest(), search, rows["train"])
    assert fitted.model.getNumTrees == search.best["n_estimators"]


@pytest.mark.parametrize("patience,metrics", [(2, ("logloss",)), (3, ("logloss", "auc")), (50, ("auc",))])
def test_a_growing_fit_stops_where_the_whole_fit_does(rows, patience, metrics):
    settings = {"n_estimators": 24, "learning_rate": 0.8, "max_depth": 4, "min_child_samples": 2}
    estimator = training.boosted_trees(settings)
    short = training.fit_early_stopped(estimator, rows["train"], rows["val"], patience, metrics)
    whole = training.fit(estimator, rows["train"]).model
    losses = training.validation_losses(whole, rows["val"], metrics)
    kept = training.rounds_by_metrics(losses, patience)
    assert short.notes["rounds"] == kept == short.model.getNumTrees
    assert short.notes["tried"][-1] <= min(24, max(2 * patience, 2 * (kept + patience)))
    for name, values in short.notes["all_losses"].items():
        assert values == pytest.approx(losses[name][: len(values)])


def test_a_network_stops_and_keeps_its_best_step(rows):
    fitted = training.fit_network_early_stopped(
        training.network(3, (4,), max_iter=60), rows["train"], rows["val"], patience=10, steps=5, metric="auc"
    )
    values = fitted.notes["values"]
    assert fitted.notes["steps"] == 5 * (values.index(max(values)) + 1)
    assert fitted.notes["tried"] == 5 * len(values) <= 60
    assert fitted.notes["tried"] in (60, fitted.notes["steps"] + 10)
    assert training.validation_value(fitted.model, rows["val"], "auc") == pytest.approx(max(values)) and max(values) > 0.8
    with pytest.raises(ValueError, match="accuracy or auc"):
        training.validation_value(fitted.model, rows["val"], "f1")


def test_out_of_bag_votes_equal_those_of_single_trees(rows, plan):
    bags = ensemble.fit_bags(rows["train"], ["key"], {**FOREST, "min_samples_leaf": 3}, bags=5)
    found = ensemble.out_of_bag_scored(bags, rows["train"], ["key"])
    alone = rows["train"]
    for k, tree in enumerate(bags.trees):
        votes = tree.transform(alone).select(*alone.columns, F.col("probability").alias(f"p{k}"))
        alone = votes
    counts = [ensemble.bag_count(["key"], k, 42).alias(f"n{k}") for k in range(5)]
    expected = {}
    for r in alone.select("*", *counts).collect():
        unseen = [float(r[f"p{k}"][1]) for k in range(5) if r[f"n{k}"] == 0]
        expected[r["key"]] = (len(unseen), sum(unseen) / len(unseen) if unseen else None)
    for r in found.collect():
        votes, mean = expected[r["key"]]
        assert r["oob_votes"] == votes and (mean is None) == (r["oob_score"] is None)
        assert mean is None or r["oob_score"] == pytest.approx(mean)
    assert plan(found).count("UDF(features") <= 4  # one model is applied, not one for each bag


def test_packed_bag_counts_are_the_single_ones(spark):
    df = spark.range(500).select("id", ensemble.bag_counts(["id"], 3, 42).alias("all"))
    for k in range(3):
        differ = F.col("all")[k] != ensemble.bag_count(["id"], k, 42)
        assert df.where(differ).count() == 0
    assert len(POISSON_ONE_CDF) < 127


@pytest.fixture
def together(monkeypatch):
    """Forests of few rows grow together as well."""
    monkeypatch.setattr(training, "LIBRARY_ROWS", 0)


def test_a_stored_forest_scores_as_spark_does_and_is_not_loaded(spark, rows, together):
    stored = training.fit_forest({**FOREST, "min_samples_split": 20}, rows["train"], loaded=False).model
    mine = training.scored(stored, rows["val"]).select("key", "score", "prediction")
    assert isinstance(stored, trees.StoredForest) and stored.getNumTrees == 7 and trees.fewest_split_rows(spark, stored) >= 20
    assert stored._loaded is None
    theirs = training.scored(stored.load(), rows["val"]).select("key", F.col("score").alias("s"), F.col("prediction").alias("p"))
    both = mine.join(theirs, "key")
    assert both.count() == rows["val"].count()
    assert both.where((F.abs(F.col("score") - F.col("s")) > 1e-12) | (F.col("prediction") != F.col("p"))).count() == 0


def test_groups_of_trees_and_blocks_of_rows_add_up(spark, rows, together, monkeypatch):
    stored = training.fit_forest(FOREST, rows["train"], loaded=False).model
    one = training.scored(stored, rows["all"]).select("key", "score")
    monkeypatch.setattr(trees, "APPLIED_BYTES", 3_000)
    monkeypatch.setattr(trees, "APPLIED_ROWS", 100)
    many = training.scored(stored, rows["all"].repartition(3)).select("key", F.col("score").alias("s"))
    assert one.join(many, "key").where(F.abs(F.col("score") - F.col("s")) < 1e-12).count() == 600


@pytest.mark.parametrize("apart", [False, True])
def test_a_search_of_forests_in_one_job_equals_fits(spark, folded, together, monkeypatch, apart):
    """Or, where no task may hold all rows, of fits by themselves."""
    grid = tuning.combinations_of(
        {"n_estimators": [5, 3], "max_depth": [None, 3], "min_samples_split": [2, 40], "max_features": ["sqrt", None]}
    )
    if apart:
        monkeypatch.setattr(bagging, "TOGETHER_BYTES", 10)
    search = staged.staged_search(staged.forest(), grid, folded, folds=3)
    assert search.fits == 2 * 3
    train, held = folded.where("fold <> 1"), folded.where("fold = 1")
    whole = training.fit_forest({"n_estimators": 5, "max_depth": None, "max_features": "sqrt"}, train).model
    for settings, f1 in zip(search.combinations, search.folds, strict=True):
        if settings["max_features"] == "sqrt":
            model = trees.first_trees(spark, whole, settings["n_estimators"])
            model = trees.pruned(spark, model, settings["min_samples_split"], settings["max_depth"] or 30)
            assert f1[1] == pytest.approx(_f1(model, held))


def test_subsets_of_as_many_features_are_one_fit(folded):
    points = [{"n_estimators": 2, "max_features": name} for name in ("sqrt", "log2", "auto", None)]
    search = staged.staged_search(staged.forest(), points, folded)
    assert search.fits == 3 * 3 and search.folds[0] == search.folds[1]  # two of three features, by either name
    alone = staged.staged_search(staged.forest(), points[1:2], folded)
    assert alone.folds[0] == search.folds[1]


def test_out_of_bag_votes_load_no_forest(rows):
    bags = ensemble.fit_bags(rows["train"], ["key"], FOREST, bags=3)
    found = ensemble.out_of_bag_scored(bags, rows["train"], ["key"])
    assert found.count() == rows["train"].count() and found.columns[-3:] == ["oob_votes", "oob_score", "oob_prediction"]
    assert isinstance(bags, trees.StoredForest) and bags._loaded is None


def test_a_packed_count_hashes_once(spark):
    df = spark.range(1).select(ensemble.bag_counts(["id"], 3, 42).alias("all"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
