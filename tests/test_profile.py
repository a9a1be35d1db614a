import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.functions.labels import membership_flag
from siftline.operators import correlation, histogram, labeling, profile, tables

MAP = {"FALSE POSITIVE": 0, "CANDIDATE": 1, "CONFIRMED": 1}


@pytest.fixture
def dispositions(spark):
    names = ["FALSE POSITIVE", "CANDIDATE", "CONFIRMED", "WHO KNOWS", None]
    return spark.createDataFrame(list(enumerate(names)), "record_id long, koi_disposition string")


def test_label_map_drops_unknown_and_missing(dispositions):
    labelled = labeling.with_label(dispositions, "koi_disposition", MAP)
    assert [r["label"] for r in labelled.orderBy("record_id").collect()] == [0, 1, 1]
    assert dict(labelled.dtypes)["label"] == "int"
    unknown = labeling.unmapped_values(dispositions, "koi_disposition", MAP).collect()
    assert {r[0] for r in unknown} == {"WHO KNOWS", None}


def test_membership_keeps_unknown_and_missing_as_zero(dispositions):
    flags = dispositions.select(membership_flag("koi_disposition", ["CONFIRMED", "CANDIDATE"]).alias("f"))
    assert [r["f"] for r in flags.collect()] == [0, 1, 1, 0, 0]


def test_category_percentages_are_of_all_rows(dispositions):
    rows = labeling.category_counts(dispositions, "koi_disposition").collect()
    assert [(r["koi_disposition"], r["rows"], r["percent"]) for r in rows] == [
        (n, 1, 20.0) for n in ("CANDIDATE", "CONFIRMED", "FALSE POSITIVE", "WHO KNOWS")
    ]


def test_describe_edge_frame(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    row = profile.describe(df, ["x"]).first()
    assert (row["rows"], row["p25"], row["p50"], row["max"]) == (4, 1.75, 2.5, 10.0)
    assert row["std"] == pytest.approx(4.0825, abs=1e-4)


def test_missing_counts_null_and_nan(spark):
    df = spark.createDataFrame(
        [(1.0, "a", 1), (float("nan"), None, 2), (None, "c", 3), (4.0, "d", 4)], "x double, s string, n int"
    )
    rows = [tuple(r) for r in profile.missing_by_column(df).collect()]
    assert rows == [("x", 2, 50.0), ("s", 1, 25.0)]
    assert tuple(profile.missing_totals(df).first()) == (2, 3, 25.0)


def test_a_column_missing_in_exactly_half_is_kept(spark):
    df = spark.createDataFrame(
        [(1.0, None, 1.0), (2.0, None, None), (None, None, None), (None, 1.0, None)], "half double, more double, most double"
    )
    assert profile.dense_features(df, ["half", "more", "most"]) == ["half"]


def test_correlation_with_constant_and_missing(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), None if i % 4 == 0 else float(x * x), 5.0, i % 2) for i, x in enumerate(rng.normal(size=60))]
    df = spark.createDataFrame(rows, "x double, y double, k double, label int")
    expected = df.toPandas().corr()
    found = {r["feature"]: r["r"] for r in correlation.correlation_with_target(df, ["x", "y", "k"], "label").collect()}
    assert found["x"] == pytest.approx(expected.loc["x", "label"])
    assert found["y"] == pytest.approx(expected.loc["y", "label"])
    assert found["k"] is None
    matrix = {(r[0], r[1]): r[2] for r in correlation.correlation_matrix(df, ["x", "y", "k"]).collect()}
    assert matrix["x", "y"] == matrix["y", "x"] == pytest.approx(expected.loc["x", "y"])
    assert matrix["x", "x"] == 1.0 and matrix["k", "k"] is None and matrix["x", "k"] is None


@pytest.mark.parametrize("values", [[0.0, 1.0, 2.0, 3.0, 3.0, None], [4.0, 4.0, None], list(np.linspace(0, 1, 41))])
def test_histogram_matches_numpy(spark, values):
    df = spark.createDataFrame([(v if v is None else float(v),) for v in values], "x double")
    rows = histogram.histogram(df, ["x"], 10).orderBy("bin").collect()
    counts, edges = np.histogram([v for v in values if v is not None], 10)
    assert [r["rows"] for r in rows] == counts.tolist()
    assert [r["bin_low"] for r in rows] == pytest.approx(edges[:-1].tolist())
    assert rows[-1]["bin_high"] == edges[-1]


def test_histogram_without_values(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert histogram.histogram(df, ["x"], 5).count() == 0


def test_class_histogram_density_sums_to_one(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("label"), F.sqrt("id").alias("x"))
    rows = histogram.histogram_by_class(df, ["x"], "label").collect()
    for c in (0, 1):
        mass = sum(r["density"] * (r["bin_high"] - r["bin_low"]) for r in rows if r["label"] == c)
        assert mass == pytest.approx(1.0)


def test_class_ratio_and_weights(spark):
    df = spark.createDataFrame([(0,)] * 3387 + [(1,)] * 3307, "label int")
    assert df.agg(labeling.class_ratio("label")).first()[0] == pytest.approx(1.0242, abs=1e-4)
    negatives = spark.createDataFrame([(0,)] * 3, "label int")
    assert negatives.agg(labeling.class_ratio("label")).first()[0] is None
    with pytest.raises(ValueError):
        labeling.with_class_weight(negatives, "label")


def test_ranges(spark):
    df = spark.createDataFrame([(1, 5.0, 0.5), (2, -1.0, 3.0), (3, None, 2.0)], "id int, a double, b double")
    ranges = {"a": (0.0, 10.0), "b": (0.0, 2.0)}
    assert [tuple(r) for r in profile.range_violations(df, ranges).collect()] == [("a", 1), ("b", 1)]
    named = profile.with_range_violations(df, ranges).orderBy("id").collect()
    assert [r["violations"] for r in named] == [[], ["a", "b"], []]


def test_column_checks(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "n int, s string, d double")
    assert tables.available(df, ["d", "x", "n"]) == ["d", "n"]
    assert tables.numeric_columns(df) == ["n", "d"]
    with pytest.raises(ValueError, match="x, y"):
        tables.require_columns(df, ["n", "x", "y"])
    assert profile.column_types(df) == [("n", "int"), ("s", "string"), ("d", "double")]


def test_profile_report_is_one_pass(spark, plan):
    df = spark.range(10).select((F.col("id") % 2).cast("int").alias("label"), F.col("id").cast("double").alias("x"))
    report = profile.profile_report(df, "label")
    assert report.first()["class_ratio"] == 1.0
    assert plan(report).count("Range (") == 1
    assert not math.isnan(report.first()["missing_percent"])
