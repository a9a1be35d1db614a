import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.functions import derived
from siftline.operators import impute as imputing
from siftline.plans.prepare import Preparation, prepare
from siftline.sources.prepared import preparation_summary, read_prepared, write_prepared
from siftline.spec import KOI, TableSpec


@pytest.fixture(scope="module")
def catalogue(spark):
    """A synthetic catalogue of the real one's size and class counts, with gaps and a sparse column."""
    columns = [
        (F.pmod(F.xxhash64("record_id", F.lit(i)), F.lit(10_007)) / 100.0).alias(name)
        for i, name in enumerate(KOI.features)
    ]
    df = spark.range(9564).withColumnRenamed("id", "record_id")
    df = df.select(
        "record_id",
        F.when(F.col("record_id") < 4839, "FALSE POSITIVE")
        .when(F.col("record_id") % 2 == 0, "CONFIRMED")
        .otherwise("CANDIDATE")
        .alias("koi_disposition"),
        *columns,
    )
    gaps = {
        "koi_prad": F.when(F.col("record_id") % 9 != 0, F.col("koi_prad")),
        "koi_teq": F.when(F.col("record_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("koi_teq")),
        "koi_insol": F.when(F.col("record_id") % 2 == 0, F.col("koi_insol")),
        "koi_kepmag": F.when(F.col("record_id") % 3 == 0, F.col("koi_kepmag")),
    }
    return df.withColumns(gaps).persist()


@pytest.fixture(scope="module")
def prepared(catalogue):
    return prepare(catalogue, KOI)


def test_sparse_feature_goes_half_missing_stays(prepared):
    _, state = prepared
    assert state.features == [n for n in KOI.features if n != "koi_kepmag"]


def test_splits_are_disjoint_complete_and_sized_as_the_catalogue(prepared):
    df, state = prepared
    rows = {r["split"]: r for r in preparation_summary(df, state.features).collect()}
    assert {s: r["rows"] for s, r in rows.items()} == {"train": 6694, "val": 957, "test": 1913}
    assert all(round(r["positive_percent"], 1) == 49.4 for r in rows.values())
    assert rows["train"]["features"].startswith("koi_period, koi_depth, koi_prad")
    assert df.select("record_id").distinct().count() == 9564


def test_medians_and_scales_against_pandas(catalogue, prepared):
    df, state = prepared
    raw = catalogue.toPandas().set_index("record_id")
    splits = df.select("record_id", "split").toPandas().set_index("record_id")["split"]
    for name in state.features:
        values = raw[name].astype(float)
        assert state.medians[name] == pytest.approx(values.median())
        filled = values.fillna(values.median())[splits[splits == "train"].index]
        scale = state.scales[name]
        assert (scale["min"], scale["max"]) == (filled.min(), filled.max())
        assert scale["mean"] == pytest.approx(filled.mean())
        assert scale["std_pop"] == pytest.approx(filled.std(ddof=0))


def test_nothing_missing_and_train_fills_zero_to_one(prepared):
    df, state = prepared
    aggregates = [F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(state.inputs)]
    assert set(df.agg(*aggregates).first()) == {0}
    train = df.where("split = 'train'").agg(*[F.min(c) for c in state.inputs], *[F.max(c) for c in state.inputs])
    assert set(train.first()) == {0.0, 1.0}


def test_fitting_on_train_differs_and_bad_option_fails(catalogue):
    _, everywhere = prepare(catalogue, KOI)
    df, train = prepare(catalogue, KOI, fit_on="train")
    kept = df.where("split = 'train'").select("record_id").join(catalogue, "record_id").toPandas()
    assert train.medians["koi_prad"] == pytest.approx(kept["koi_prad"].median())
    assert train.medians != everywhere.medians
    with pytest.raises(ValueError):
        prepare(catalogue, KOI, fit_on="some")


def test_preparation_survives_saving(spark, prepared, tmp_path):
    _, state = prepared
    state.save(spark, str(tmp_path / "p"))
    loaded = Preparation.load(spark, str(tmp_path / "p"))
    assert loaded.features == state.features
    assert loaded == state


def test_written_table_prunes_splits(spark, prepared, tmp_path, plan):
    df, _ = prepared
    write_prepared(df, str(tmp_path / "t"))
    train = read_prepared(spark, str(tmp_path / "t"), ["train"])
    assert train.count() == 6694
    assert "PartitionFilters: [isnotnull(split" in plan(train)


def test_scoring_transform_needs_no_shuffle(catalogue, prepared, plan):
    _, state = prepared
    text = plan(state.transform(catalogue.drop("koi_disposition")))
    assert "Exchange" not in text and "Join" not in text


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(5.0,)] * 5, "x double")
    scales = imputing.fit_scales(df, ["x"])
    for method in ("minmax", "standard"):
        assert {r["x_scaled"] for r in imputing.scale(df, scales, method).collect()} == {0.0}


def test_scaling_does_not_clip_and_can_be_undone(spark):
    train = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    new = spark.createDataFrame([(0.0,), (5.0,)], "x double")
    scales = imputing.fit_scales(train, ["x"])
    scaled = imputing.scale(new, scales)
    assert [r["x_scaled"] for r in scaled.collect()] == [-0.5, 2.0]
    for method in ("minmax", "standard"):
        back = imputing.unscale(imputing.scale(new, scales, method).drop("x"), scales, method)
        assert [r["x"] for r in back.collect()] == pytest.approx([0.0, 5.0])
    with pytest.raises(ValueError):
        imputing.scale(new, scales, "other")


def test_median_is_not_the_lower_middle(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    assert imputing.fit_medians(df, ["x"]) == {"x": 2.5}
    assert imputing.fit_medians(df, ["x"], approximate=True) == {"x": 2.0}


def test_filled_moments_match_a_second_pass(spark):
    values = [1.0, 2.0, None, 7.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    raw = imputing.fit_scales(df, ["x"])["x"]
    found = imputing.scale_after_filling(raw, 3, 2, -4.0)
    filled = np.array([-4.0 if v is None else v for v in values])
    assert found == pytest.approx(
        {"min": -4.0, "max": 7.0, "mean": filled.mean(), "std_pop": filled.std()}
    )
    assert imputing.scale_after_filling(raw, 0, 2, 9.0) == {"min": 9.0, "max": 9.0, "mean": 9.0, "std_pop": 0.0}


def test_twelve_derived_features(spark):
    row = {name: 0.5 for name in KOI.features}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} double" for n in row))
    result = derived.with_derived(df, derived.KOI_DERIVED)
    assert len(result.columns) == 24
    assert derived.KOI_DERIVED.names(df.columns) == result.columns[12:]
    first = result.first()
    assert first["depth_period_ratio"] == pytest.approx(0.5 / 1.5)
    assert first["koi_prad_log"] == pytest.approx(np.log1p(0.5))
    assert first["koi_depth_squared"] == first["snr_depth_product"] == 0.25


def test_derived_edges(spark):
    df = spark.createDataFrame([(1.0, -1.0), (None, 2.0)], "a double, b double")
    wanted = derived.DerivedFeatures(ratios={"r": ("a", "b")}, logs=("b", "absent"), squares=("a",))
    rows = derived.with_derived(df, wanted).collect()
    assert rows[0]["r"] is None and rows[0]["b_log"] is None and rows[0]["a_squared"] == 1.0
    assert rows[1]["r"] is None and rows[1]["b_log"] == pytest.approx(np.log(3))


def test_spec_defaults():
    assert KOI.positives() == ("CANDIDATE", "CONFIRMED")
    assert len(KOI.features) == 12 and set(KOI.ranges) == set(KOI.features)
    assert TableSpec((), (), "c", {}, positive_categories=("x",)).positives() == ("x",)


def test_feature_names_with_dots(spark):
    from siftline.operators import histogram, profile
    from siftline.operators.correlation import correlation_matrix
    from siftline.plans import training
    from siftline.plans.scoring import Scorer
    from siftline.spec import TableSpec

    rows = [(i, "p" if i % 3 else "n", float(i % 7) if i % 5 else None, float(i % 11), 1.0 * i) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, kind string, `a.b` double, `a` double, `c.d` double")
    spec = TableSpec(key=("id",), features=("a.b", "a", "c.d"), category="kind", label_map={"n": 0, "p": 1})
    table, state = prepare(df, spec)
    assert state.features == ["a.b", "a", "c.d"] and "a.b_scaled" in table.columns
    rows = training.assembled(table, state.inputs, ["id", "label", "split"])
    model = training.fit(training.forest({"n_estimators": 2, "max_depth": 2}), rows.where("split = 'train'")).model
    scored = Scorer.of(state, model).transform(df)
    assert scored.columns[:5] == df.columns and scored.where("probability IS NULL").count() == 0
    names = ["a.b", "a", "c.d"]
    assert {r["feature"] for r in profile.describe(df, names).collect()} == set(names)
    assert {r["feature"] for r in profile.missing_by_column(df).collect()} == {"a.b"}
    assert correlation_matrix(df, names).count() == 9
    assert histogram.histogram(df, names, 4).count() == 12
