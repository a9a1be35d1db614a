import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.operators import quantiles


def values_frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


@pytest.mark.parametrize(
    "values",
    [[1, 2, 3, 10, None], [5.0], [1, 2], [3, 3, 3, 3], [1, 2, 3], [-1.5, 0, 0, 7, None, None]],
)
def test_small_frames_match_linear_interpolation(spark, values):
    df = values_frame(spark, values)
    found = quantiles.exact_quantiles(df, {"x": F.col("x")}, (0.0, 0.25, 0.5, 0.75, 1.0))[0]["x"]
    present = [v for v in values if v is not None]
    assert found == pytest.approx(np.quantile(present, (0.0, 0.25, 0.5, 0.75, 1.0)).tolist())


def test_no_values(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert quantiles.exact_quantiles(df, {"x": F.col("x")}, (0.25, 0.5)) == ({"x": [None, None]}, None)


def test_large_frame_with_a_value_held_by_a_third_of_the_rows(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(100_003)) / 13.0).alias("x"),
        F.pow(F.col("id") / 1000.0, 3).alias("y"),
    )
    columns = {"x": F.col("x"), "y": F.col("y")}
    found, row = quantiles.exact_quantiles(df, columns, (0.1, 0.25, 0.5, 0.75), [F.count("x").alias("n")])
    assert row["n"] == 60_000
    pdf = df.toPandas()
    for name in columns:
        assert found[name] == pytest.approx(pdf[name].quantile([0.1, 0.25, 0.5, 0.75]).tolist(), abs=1e-9)


@pytest.mark.parametrize("error", [0.0, 0.1])
def test_repeated_narrowing_and_failed_intervals(spark, monkeypatch, error):
    """A coarse sketch proposes intervals that miss or stay wide; the result stays exact."""
    monkeypatch.setattr(quantiles, "SKETCH_SIZE", 64)
    monkeypatch.setattr(quantiles, "RANKED_ROWS", 200)
    monkeypatch.setattr(quantiles, "rank_error", lambda: error)
    checked = []
    check = quantiles._check
    monkeypatch.setattr(quantiles, "_check", lambda df, p, a, **o: (checked.append(len(p)), check(df, p, a, **o))[1])
    df = spark.range(20_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("x"))
    found, _ = quantiles.exact_quantiles(df, {"x": F.col("x")}, (0.05, 0.5, 0.95))
    expected = df.toPandas()["x"].quantile([0.05, 0.5, 0.95]).tolist()
    assert found["x"] == pytest.approx(expected, abs=1e-9)
    assert len(checked) > 1


def test_heavy_values_next_to_the_median(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "RANKED_ROWS", 10)
    df = spark.range(40_000).select(F.when(F.col("id") < 20_000, 1.0).otherwise(2.0).alias("x"))
    assert quantiles.exact_quantiles(df, {"x": F.col("x")}, (0.5,))[0] == {"x": [1.5]}


def test_sketches_of_sorted_partitions_are_merged(spark):
    df = spark.range(0, 100_000, 1, 16).select(F.col("id").cast("double").alias("x"))
    size, points = quantiles.sketch_quantiles(df, {"x": (F.col("x"), (0.1, 0.5, 0.9))})["x"]
    assert size == 100_000
    assert points == pytest.approx([10_000, 50_000, 90_000], abs=100_000 * quantiles.rank_error())


def test_edges_balance_rows_and_skip_ties(spark):
    df = spark.range(50_000).select(
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / 50_000.0).alias("x")
    )
    edges = quantiles.balanced_edges(df, F.col("x"), 8)
    assert edges == sorted(set(edges)) and 4 <= len(edges) <= 7
    assert quantiles.balanced_edges(df.where("x > 2"), F.col("x"), 8) == []
