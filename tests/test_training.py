import pytest
from pyspark.sql import functions as F

from siftline.operators.labeling import with_class_weight
from siftline.operators.split import stratified_folds
from siftline.plans import ensemble, importance, training, tuning
from siftline.plans.prepare import prepare
from siftline.plans.scoring import Scorer
from siftline.sources.models import load_pipelines
from siftline.spec import KOI
from siftline.streaming.scoring import arriving_files, run_available

SMALL = {"n_estimators": 6, "learning_rate": 0.3, "max_depth": 3, "min_child_samples": 5}


@pytest.fixture(scope="module")
def catalogue(spark):
    """Classes that the period and the depth tell apart, with noise and gaps."""
    noise = [F.pmod(F.xxhash64("record_id", F.lit(i)), F.lit(1000)) / 100.0 for i in range(12)]
    planet = (noise[0] + noise[1] / 2 + noise[2] / 4) > 8.5
    columns = [c.alias(name) for c, name in zip(noise, KOI.features)]
    df = spark.range(1500).withColumnRenamed("id", "record_id")
    df = df.select(
        "record_id",
        F.when(~planet, "FALSE POSITIVE").when(F.col("record_id") % 2 == 0, "CONFIRMED").otherwise("CANDIDATE").alias("koi_disposition"),
        *columns,
    )
    gaps = F.when(F.col("record_id") % 11 != 0, F.col("koi_teq"))
    return df.withColumn("koi_teq", gaps).persist()


@pytest.fixture(scope="module")
def tables(catalogue):
    df, state = prepare(catalogue, KOI)
    vectors = training.assembled(df, state.inputs, ["record_id", "label", "split"]).persist()
    return {
        "state": state,
        "prepared": df,
        "all": vectors,
        **{s: vectors.where(F.col("split") == s) for s in ("train", "val", "test")},
    }


@pytest.fixture(scope="module")
def boosted(tables):
    return training.fit(training.boosted_trees(SMALL), tables["train"])


def test_settings_map_to_spark_parameters(spark):
    model = training.boosted_trees(training.BOOSTING_BASELINE, weight="w")
    assert model.getMaxIter() == 100 and model.getStepSize() == 0.1 and model.getMaxDepth() == 6
    assert model.getMinInstancesPerNode() == 20 and model.getFeatureSubsetStrategy() == "0.8"
    assert model.getWeightCol() == "w" and model.getSeed() == 42
    forest = training.forest()
    assert forest.getNumTrees() == 200 and forest.getMaxDepth() == 30
    assert forest.getFeatureSubsetStrategy() == "sqrt"
    assert training.forest({"max_features": None}).getFeatureSubsetStrategy() == "all"
    assert training.forest({"min_samples_split": 2}).getNumTrees() == 20


@pytest.mark.parametrize("name,value", [("min_samples_split", 5), ("num_leaves", 31), ("reg_alpha", 0.1), ("boosting_type", "dart")])
def test_settings_without_counterpart_are_refused(spark, name, value):
    with pytest.raises(ValueError, match=name):
        training.boosted_trees({name: value})


@pytest.mark.parametrize(
    "losses,patience,kept",
    [([3, 2, 1], 2, 3), ([3, 1, 2, 2, 0], 2, 2), ([3, 1, 2, 2, 0], 4, 5), ([1, 1, 1], 5, 1), ([5], 1, 1)],
)
def test_patience_rule(losses, patience, kept):
    assert training.rounds_to_keep(losses, patience) == kept


def test_early_stop_keeps_the_first_trees(tables, monkeypatch):
    monkeypatch.setattr(training, "rounds_by_metrics", lambda losses, patience: 3)
    short = training.fit_early_stopped(training.boosted_trees(SMALL), tables["train"], tables["val"], 3)
    full = training.fit(training.boosted_trees(SMALL), tables["train"])
    assert len(short.notes["losses"]) == 6 and short.model.getNumTrees == 3
    assert [t.toDebugString.split("\n", 1)[1] for t in short.model.trees] == [
        t.toDebugString.split("\n", 1)[1] for t in full.model.trees[:3]
    ]


def test_model_learns_and_probabilities_are_valid(boosted, tables):
    scored = training.scored(boosted.model, tables["all"])
    limits = scored.agg(F.min("score"), F.max("score"), F.count("score")).first()
    assert 0 <= limits[0] and limits[1] <= 1 and limits[2] == 1500
    rows = {r["split"]: r for r in training.history("boosting", "baseline", boosted, tables["all"]).collect()}
    assert set(rows) == {"train", "val", "test"}
    assert rows["test"]["f1_score"] > 0.8
    assert rows["val"]["f1_score"] == pytest.approx(training.validation_f1(boosted.model, tables["val"]))
    assert rows["val"]["f1_score"] == pytest.approx(
        tuning.positive_f1().evaluate(boosted.model.transform(tables["val"]))
    )
    assert rows["train"]["seconds"] > 0


def test_importances(spark, boosted, tables):
    gain = importance.gain_importance(spark, boosted.model, tables["state"].features).collect()
    assert gain[0]["feature"] == "koi_period" and sum(r["importance"] for r in gain) == pytest.approx(1.0)
    splits = importance.split_importance(spark, boosted.model, tables["state"].features).collect()
    internal = sum(t.numNodes // 2 for t in boosted.model.trees)
    assert sum(r["importance"] for r in splits) == internal and len(splits) == 12


def test_grid_and_random_combinations():
    assert len(tuning.combinations_of(training.BOOSTING_GRID)) == 8
    assert len(tuning.combinations_of(training.FOREST_GRID)) == 324
    space = {"a": list(range(50)), "b": list(range(40)), "c": list(range(30))}
    drawn = tuning.drawn_combinations(space, 100, 7)
    assert len({tuple(c.values()) for c in drawn}) == 100
    assert drawn == tuning.drawn_combinations(space, 100, 7) != tuning.drawn_combinations(space, 100, 8)
    assert len(tuning.drawn_combinations({"a": [1, 2]}, 10, 1)) == 2


def test_cross_validated_search(tables):
    folded = stratified_folds(tables["train"], "label", ["record_id"], 3).persist()
    grid = tuning.combinations_of({"n_estimators": [1, 5], "max_depth": [3]})
    search = tuning.cross_validated(training.boosted_trees({"learning_rate": 0.3}), grid, training.BOOSTING_PARAMS, folded)
    assert search.best == {"n_estimators": 5, "max_depth": 3} and search.best_score == max(search.scores)
    assert search.model.getNumTrees == 5
    assert tuning.search_rows(search, folded).count() == 2


def test_first_of_equal_candidates_wins(tables):
    same = [training.boosted_trees({**SMALL, "n_estimators": 2}) for _ in range(2)]
    best, fitted, scores = tuning.select_on_validation(same, tables["train"], tables["val"])
    assert best == 0 and scores[0] == scores[1] and len(fitted) == 2
    assert tuning.first_best([0.1, 0.3, 0.3]) == 1


# Stored test and validation F1 of the two stages.
@pytest.mark.parametrize(
    "baseline,tuned,chosen",
    [(0.8306878306878307, 0.8292422625400213, "baseline"), (0.7925058548009367, 0.793233082706767, "tuned"), (0.8, 0.8, "baseline")],
)
def test_best_of_two(spark, baseline, tuned, chosen):
    rows = [("baseline", "test", baseline), ("tuned", "test", tuned), ("baseline", "val", 0.9), ("tuned", "val", 0.1)]
    df = spark.createDataFrame(rows, "stage string, split string, f1_score double")
    assert tuning.best_of_two(df, "test").first()["chosen"] == chosen
    assert tuning.best_of_two(df).first()["chosen"] == "baseline"


def test_seed_ensemble(tables):
    found = ensemble.fit_seed_ensemble(
        tables["train"], tables["val"], {**SMALL, "n_estimators": 3, "subsample": 0.7}, members=2, patience=3
    )
    assert found.best == tuning.first_best(found.validation_f1)
    joint = ensemble.ensemble_scored(found.models, tables["test"])
    members, names = ensemble.with_member_scores(found.models, tables["test"])
    pairs = joint.join(members, "record_id").select("score", "prediction", *names).collect()
    assert len(pairs) == tables["test"].count()
    assert any(r["score_0"] != r["score_1"] for r in pairs)
    for r in pairs:
        assert r["score"] == pytest.approx((r["score_0"] + r["score_1"]) / 2)
        assert r["prediction"] == (r["score"] >= 0.5)


def test_out_of_bag(tables):
    bags = ensemble.fit_bags(tables["train"], ["record_id"], {"max_depth": 5, "max_features": "sqrt"}, bags=4)
    assert bags.getNumTrees == 4 and bags.getOrDefault("featureSubsetStrategy") == "sqrt"
    scored = ensemble.out_of_bag_scored(bags, tables["train"], ["record_id"]).persist()
    row = ensemble.out_of_bag_accuracy(scored).first()
    assert row["rows"] == tables["train"].count() and 0.7 < row["oob_accuracy"] <= 1
    # A row misses a bag with probability 1/e, so all four contain it with (1 - 1/e) ** 4 = 0.16.
    assert row["rows_with_votes"] / row["rows"] == pytest.approx(0.84, abs=0.05)
    assert scored.where("oob_votes = 0 AND oob_score IS NOT NULL").count() == 0


def test_bag_counts_are_poisson(spark):
    counts = spark.range(20_000).select(ensemble.bag_count(["id"], 0, 42).alias("n"))
    mean, zero = counts.agg(F.avg("n"), F.avg((F.col("n") == 0).cast("double"))).first()
    assert mean == pytest.approx(1.0, abs=0.03) and zero == pytest.approx(0.3679, abs=0.015)


def test_network(tables):
    fitted = training.fit(training.network(12, (5,), 40), tables["train"])
    assert training.validation_f1(fitted.model, tables["val"]) > 0.7


def test_step_size_chooses_the_solver_that_uses_it():
    assert training.network(3).getSolver() == "l-bfgs"
    stepped = training.network(3, step_size=0.5)
    assert stepped.getSolver() == "gd" and stepped.getStepSize() == 0.5


@pytest.mark.parametrize(
    "losses,patience,kept",
    [({"a": [3, 1, 2, 2, 0], "b": [5, 4, 3, 2, 1]}, 2, 2), ({"a": [5, 4, 3, 2, 1], "b": [1, 2, 3, 4, 5]}, 3, 1), ({"a": [3, 2, 1]}, 5, 3)],
)
def test_the_metric_that_stops_first_decides(losses, patience, kept):
    assert training.rounds_by_metrics(losses, patience) == kept


def test_staged_scores_are_those_of_cut_models(spark, boosted, tables):
    from siftline.plans.trees import first_trees, staged_scores

    staged = staged_scores(spark, boosted.model, tables["val"].select("record_id", "features"))
    assert staged.select("round").distinct().count() == boosted.model.getNumTrees
    for rounds in (1, boosted.model.getNumTrees):
        cut = first_trees(spark, boosted.model, rounds)
        alone = training.scored(cut, tables["val"]).select("record_id", F.col("score").alias("own"))
        far = staged.where(F.col("round") == rounds).join(alone, "record_id").where(F.abs(F.col("score") - F.col("own")) > 1e-12)
        assert cut.getNumTrees == rounds and far.count() == 0


def test_class_weight_column(tables):
    weighted = with_class_weight(tables["train"], "label")
    row = weighted.groupBy().agg(F.sum(F.when(F.col("label") == 1, F.col("class_weight"))), F.sum((F.col("label") == 0).cast("int"))).first()
    assert row[0] == pytest.approx(row[1])
    model = training.fit(training.boosted_trees({**SMALL, "n_estimators": 1}, weight="class_weight"), weighted).model
    assert model.getNumTrees == 1


@pytest.fixture(scope="module")
def scorer(boosted, tables):
    return Scorer.of(tables["state"], boosted.model, KOI.positive_text, KOI.negative_text)


def test_scoring_fills_missing_values_but_reports_the_input(catalogue, scorer, plan):
    scored = scorer.transform(catalogue)
    assert scored.columns[: len(catalogue.columns)] == catalogue.columns
    assert scored.where("koi_teq IS NULL").count() == catalogue.where("koi_teq IS NULL").count() > 0
    assert scored.where("probability IS NULL").count() == 0
    assert scorer.report_columns(scored).columns == ["prediction_text", "probability", *KOI.features[:4]]
    row = scored.agg(
        F.count_if(F.col("confidence") < 0.5).alias("low"),
        F.count_if((F.col("prediction") == 1) != (F.col("prediction_text") == "Planet")).alias("wrong"),
    ).first()
    assert tuple(row) == (0, 0)
    assert "Exchange" not in plan(scorer.transform(catalogue)) and "PythonUDF" not in plan(scored)


def test_scoring_equals_the_prepared_path(catalogue, scorer, boosted, tables):
    again = scorer.transform(catalogue).select("record_id", "probability")
    direct = training.scored(boosted.model, tables["all"]).select("record_id", "score")
    differing = again.join(direct, "record_id").where(F.abs(F.col("probability") - F.col("score")) > 1e-12)
    assert differing.count() == 0


def test_single_record(spark, scorer):
    defaults = {name: default for name, (_, _, default) in KOI.ranges.items()}
    row = scorer.score_record(spark, defaults).first()
    assert row["prediction_text"] in ("Planet", "False Positive")
    assert row["confidence"] == pytest.approx(max(row["probability"], 1 - row["probability"]))
    partial = scorer.score_record(spark, {"koi_period": 10.0}).first()
    assert partial["koi_depth"] is None and 0 <= partial["probability"] <= 1


def test_missing_feature_fails_before_any_job(catalogue, scorer):
    with pytest.raises(ValueError, match="Missing columns: koi_insol"):
        scorer.transform(catalogue.drop("koi_insol"))


def test_scorer_survives_saving_and_csv(spark, catalogue, scorer, tmp_path):
    scorer.save(spark, str(tmp_path / "s"))
    loaded = Scorer.load(spark, str(tmp_path / "s"))
    catalogue.write.csv(str(tmp_path / "in"), header=True)
    result, path = loaded.score_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert result.count() == 1500 and "predictions_" in path
    expected = scorer.transform(catalogue).select(F.col("record_id").cast("string"), F.col("probability").alias("p"))
    assert result.join(expected, "record_id").where(F.abs(F.col("p") - F.col("probability")) > 1e-9).count() == 0


def test_engineered_ensemble_survives_saving_and_undefined_features(spark, catalogue, tables, boosted, tmp_path):
    from siftline.functions.derived import KOI_DERIVED
    from siftline.plans.engineer import engineer

    ready, engineering = engineer(tables["prepared"], tables["state"], KOI_DERIVED)
    assert len(engineering.inputs) == 12
    inputs = [*tables["state"].inputs, *engineering.inputs]
    rows = training.assembled(ready, inputs, ["record_id", "label", "split"]).where("split = 'train'")
    models = [training.fit(training.boosted_trees({"n_estimators": 2, "max_depth": 3}, seed), rows).model for seed in (1, 2)]
    scorer = Scorer.of(tables["state"], models, engineering=engineering)
    scorer.save(spark, str(tmp_path / "s"))
    loaded = Scorer.load(spark, str(tmp_path / "s"))
    assert (loaded.positive, loaded.negative) == ("Planet", "False Positive") and len(loaded.models) == 2
    # Values far below the training range: logarithms of -1 and less, and a division by zero.
    strange = catalogue.withColumn("koi_depth", F.lit(-1e9)).withColumn("koi_period", F.lit(-1e9))
    one, two = (s.transform(strange).select("record_id", "probability") for s in (scorer, loaded))
    assert one.exceptAll(two).count() == 0 and one.where("probability IS NULL").count() == 0
    alone = Scorer.of(tables["state"], boosted.model).transform(catalogue)
    assert alone.where("prediction <> CAST(probability > 0.5 AS INT) AND probability <> 0.5").count() == 0


def test_a_folder_without_scaling_or_inputs_is_refused(spark, scorer, tmp_path):
    import shutil

    for part in ("preparation/settings", "scorer", "members/0"):
        folder = tmp_path / part.replace("/", "-")
        scorer.save(spark, str(folder))
        shutil.move(str(folder / part), str(tmp_path / f"away-{part.replace('/', '-')}"))
        with pytest.raises(Exception):
            Scorer.load(spark, str(folder))


def test_missing_models_are_skipped_and_none_is_an_error(spark, scorer, tmp_path):
    scorer.save(spark, str(tmp_path / "s"))
    with pytest.warns(UserWarning, match="could not load gone"):
        found = load_pipelines({"gone": str(tmp_path / "gone"), "here": str(tmp_path / "s/members/0")})
    assert list(found) == ["here"]
    with pytest.warns(UserWarning), pytest.raises(FileNotFoundError):
        load_pipelines({"gone": str(tmp_path / "gone")})


def test_stream_scores_each_row_once_across_restarts(spark, catalogue, scorer, tmp_path):
    inbox, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for part in (0, 1):
        catalogue.where(F.col("record_id") % 2 == part).write.mode("append").parquet(inbox)
        run_available(arriving_files(spark, inbox, catalogue.schema), scorer.transform, out, progress)
    streamed = spark.read.parquet(out).select("record_id", "probability")
    batch = scorer.transform(catalogue).select("record_id", "probability")
    assert streamed.exceptAll(batch).count() == batch.exceptAll(streamed).count() == 0
