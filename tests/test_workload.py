"""Every query with SQL gives the SQL's rows; the others give rows."""

import os

import pytest

import __spark_entry__ as entry_points
from comparison import connection, differences
from siftline.plans import training

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()
#: Published searches and jobs, one to four minutes each, whose parts ``test_trees.py`` tests; run with SLOW=1.
SLOW = {
    "grid_search_cv", "forest_grid_search_cv", "random_search_cv", "random_search_extended", "seed_ensemble",
    "training_job_document", "tuned_or_baseline",
}
FAST = set(ORACLES) - (set() if os.environ.get("SLOW") else SLOW)


@pytest.fixture(scope="module")
def db(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(FAST))
def test_rows_equal_the_sql(spark, sf_dir, db, name):
    assert differences(QUERIES[name](spark, sf_dir), ORACLES[name], db) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_are_there(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() == 3


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython")


@pytest.mark.parametrize(
    "name",
    [
        "category_counts", "correlation_matrix", "histogram_50", "roc_auc", "roc_auc_by_group", "roc_curve",
        "all_metrics", "calibration_curve", "prepared_table", "fold_assignment", "features_with_labels",
    ],
)
def test_plans_have_no_cross_join_and_no_python(spark, sf_dir, plan, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert not [word for word in FORBIDDEN if word in text]


def test_scans_read_only_the_needed_columns(spark, sf_dir, plan):
    text = plan(QUERIES["binary_metrics"](spark, sf_dir))
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string>" in text
    assert "PushedFilters: [IsNotNull(l_returnflag)]" in text


class _Stop(Exception):
    pass


def test_searches_are_the_published_ones():
    from siftline.plans import tuning

    points = tuning.combinations_of(training.FOREST_GRID)
    assert len(points) == 324 and ORACLES["forest_grid_search_cv"].count("'sqrt'") >= 108
    assert ORACLES["random_search_cv"].count("'500'") + ORACLES["random_search_cv"].count("'200'") >= 1


@pytest.mark.parametrize("name", ["gbt_train_score", "gbt_history", "rf_train_score", "rf_history"])
def test_single_fits_have_the_published_settings(spark, sf_dir, monkeypatch, name):
    asked = []

    def fit(estimator, train):
        asked.append(estimator)
        raise _Stop

    monkeypatch.setattr(training, "fit", fit)
    with pytest.raises(_Stop):
        QUERIES[name](spark, sf_dir)
    if name.startswith("gbt"):
        assert (asked[0].getMaxIter(), asked[0].getMaxDepth(), asked[0].getMinInstancesPerNode()) == (100, 6, 20)
    else:
        assert (asked[0].getNumTrees(), asked[0].getMaxDepth()) == (200, training.MAX_DEPTH)


def test_the_search_of_forests_is_the_whole_grid(spark, sf_dir, monkeypatch):
    from siftline.plans import staged, tuning

    asked = []

    def search(learner, combinations, *args, **kwargs):
        asked.extend(combinations)
        raise _Stop

    monkeypatch.setattr(staged, "staged_search", search)
    with pytest.raises(_Stop):
        QUERIES["forest_grid_search_cv"](spark, sf_dir)
    assert asked == tuning.combinations_of(training.FOREST_GRID) and len(asked) == 324
    assert [ORACLES["forest_grid_search_cv"].count(f"'{name}')") for name in ("sqrt", "log2", "None")] == [108] * 3


def test_the_training_job_searches_the_whole_grid(spark, sf_dir, monkeypatch):
    from siftline.plans import tuning
    from siftline.workload import models

    asked = []

    def job(table, state, key, path, combinations, **kwargs):
        asked.extend(combinations)
        raise _Stop

    monkeypatch.setattr(models, "train_boosting", job)
    with pytest.raises(_Stop):
        QUERIES["tuned_or_baseline"](spark, sf_dir)
    assert asked == tuning.combinations_of(training.BOOSTING_GRID) and len(asked) == 8
