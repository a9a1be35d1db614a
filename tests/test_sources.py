import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftline.functions.display import percent, with_unit
from siftline.operators.evaluate import importance_rows, top_importances
from siftline.sources import csv as csv_files
from siftline.sources import documents

CSV = """# leading comment
# another
a,b,name
1.5,,first
# in between
x,2.0,second # trailing
,4.5,third
"""


@pytest.fixture
def csv_path(tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(CSV)
    return str(path)


def test_header_and_comment_lines(spark, csv_path):
    assert csv_files.header_names(spark, csv_path) == ["a", "b", "name"]
    rows = csv_files.read_csv(spark, csv_path, {"a": "double", "b": "double"}).collect()
    assert [tuple(r) for r in rows] == [
        (1.5, None, "first"), (None, 2.0, "second # trailing"), (None, 4.5, "third")
    ]


def test_trailing_comments_are_cut(spark, csv_path):
    rows = csv_files.read_csv(spark, csv_path, {"a": "double", "b": "double"}, trailing_comments=True).collect()
    assert [tuple(r) for r in rows] == [(1.5, None, "first"), (None, 2.0, "second"), (None, 4.5, "third")]


def test_inferred_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("# c\na,b\n1,x\n2,y\n")
    assert csv_files.read_csv(spark, str(path)).dtypes == [("a", "int"), ("b", "string")]


def test_columns_are_matched_by_name(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("b,extra,a\n2,k,1\nNaN,k,3\n")
    rows = csv_files.read_features_csv(spark, str(path), ["a", "b"]).orderBy("a").collect()
    assert [(r["a"], r["b"], r["extra"]) for r in rows] == [(1.0, 2.0, "k"), (3.0, None, "k")]
    with pytest.raises(ValueError, match="Missing columns: c"):
        csv_files.read_features_csv(spark, str(path), ["a", "c"])


def test_unusual_column_names(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("# c\na.b,two words\n1,x # note\n2,y\n")
    for trailing in (False, True):
        rows = csv_files.read_csv(spark, str(path), {"a.b": "int"}, trailing_comments=trailing).collect()
        assert [r["a.b"] for r in rows] == [1, 2]
    assert [r["two words"] for r in rows] == ["x", "y"]


def test_empty_file(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("# nothing\n")
    with pytest.raises(ValueError):
        csv_files.header_names(spark, str(path))


def test_export_name_carries_the_time(spark, tmp_path):
    at = datetime(2025, 9, 19, 13, 14, 36)
    path = csv_files.write_csv(spark.range(3), str(tmp_path), "predictions", at)
    assert path.endswith("predictions_20250919_131436")
    assert spark.read.csv(path, header=True).count() == 3


# Of two stored documents the fields that are asserted below.
FOREST = {
    "model_type": "RandomForest",
    "evaluation_metrics": {
        "accuracy": 0.832723470987977, "f1_score": 0.8306878306878307, "roc_auc": 0.9198839039748131,
        "confusion_matrix": [[808, 160], [160, 785]],
    },
    "training_history": {
        "baseline": {"val_precision": 0.8139059304703476, "val_f1": 0.8274428274428275},
        "tuned": {"val_f1": 0.8278008298755186, "tuning_time": 852.9291534423828, "test_f1": 0.8292422625400213},
    },
    "feature_importances": [
        0.13016679888098912, 0.10102780128719466, 0.15986131903113304, 0.07894157172971138,
        0.0814976809700056, 0.09509462420988687, 0.08126193232962775, 0.052051926242800924,
        0.04527448697188293, 0.04627739076712545, 0.04744090141685614, 0.08110356616278591,
    ],
}
# Fixed values, likewise.
NETWORK = {
    "evaluation_metrics": {
        "accuracy": 0.7699947726084684, "f1_score": 0.793233082706767, "roc_auc": 0.8590559272377454,
        "confusion_matrix": [[629, 339], [101, 844]],
    },
    "training_history": {"baseline": {"val_f1": 0.7815668202764977}},
    "feature_importances": {
        "features": ["koi_depth", "koi_teq", "koi_impact", "koi_duration"],
        "importances": [0.31258543453536347, 0.20213245435796118, 0.1924254623143126, 0.1063342511067384],
    },
}


@pytest.fixture
def stored(spark, tmp_path):
    found = {}
    for name, content in (("forest", FOREST), ("network", NETWORK)):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(content, indent=4))
        found[name] = documents.read_document(spark, str(path))
    return found


def test_comparison_of_documents_with_differing_fields(stored):
    rows = {r["model"]: r for r in documents.model_comparison(stored).collect()}
    assert rows["forest"]["f1_score"] == 0.8306878306878307
    assert rows["network"]["roc_auc"] == 0.8590559272377454
    matrix = {r["model"]: r["confusion_matrix"] for r in documents.evaluation_rows(stored).collect()}
    assert matrix["network"] == [[629, 339], [101, 844]]


def test_history_rows_fill_absent_fields_with_null(stored):
    rows = {(r["stage"], r["split"]): r for r in documents.history_rows("forest", stored["forest"]).collect()}
    assert rows["baseline", "val"]["precision"] == 0.8139059304703476
    assert rows["tuned", "test"]["f1"] == 0.8292422625400213
    assert rows["tuned", "val"]["accuracy"] is None and rows["tuned", "val"]["seconds"] == 852.9291534423828
    assert documents.history_rows("network", stored["network"]).count() == 1


def test_importances_in_both_layouts(stored):
    from siftline.spec import KOI

    forest = documents.importance_table(stored["forest"], list(KOI.features))
    assert [r["feature"] for r in top_importances(forest, 4).collect()] == [
        "koi_prad", "koi_period", "koi_depth", "koi_duration"
    ]
    network = documents.importance_table(stored["network"])
    assert [r["feature"] for r in top_importances(network, 3).collect()] == ["koi_depth", "koi_teq", "koi_impact"]


def test_document_round_trip(spark, tmp_path):
    from siftline.operators.evaluate import full_metrics

    df = spark.createDataFrame([(0, 0, 0.2), (1, 1, 0.9)], "label int, prediction int, score double")
    documents.write_document(full_metrics(df, "label", "prediction", "score"), str(tmp_path / "m"), "boosting")
    row = documents.read_document(spark, str(tmp_path / "m")).first()
    assert row["model_type"] == "boosting"
    assert row["evaluation_metrics"]["confusion_matrix"] == [[1, 0], [0, 1]]
    assert datetime.fromisoformat(row["timestamp"])


def test_names_paired_by_position(spark):
    df = spark.createDataFrame([(["a", "b"], [0.1, 0.2])], "names array<string>, values array<double>")
    assert [tuple(r) for r in importance_rows(df, "names", "values").collect()] == [(0, "a", 0.1), (1, "b", 0.2)]


def test_display(spark):
    row = spark.range(1).select(
        with_unit(F.lit(10.0), 2, "days"), with_unit(F.lit(500.25), 1, "ppm"), percent(F.lit(0.8316))
    ).first()
    assert tuple(row) == ("10.00 days", "500.2 ppm", "83.16%")


@pytest.mark.parametrize("decimals", [0, 1, 2])
def test_display_rounds_by_the_exact_value_with_ties_to_even(spark, decimals):
    chosen = random.Random(decimals)
    values = [500.25, 0.5, 1.5, 2.5, 2.675, 0.15, 0.25, 0.35, 1.005, -0.4, -2.5, -0.125, 1e17, 0.0, 99.995, 1e-9]
    values += [chosen.uniform(-1000, 1000) for _ in range(300)] + [chosen.randrange(100_000) / 8 for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", with_unit(F.col("v"), decimals)).collect()
    assert [r[1] for r in rows] == [f"{r[0]:.{decimals}f}" for r in rows]


def write_files(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return str(tmp_path)


def test_comment_signs_in_quotes_are_text(spark, tmp_path):
    path = write_files(tmp_path, a='a,b # the header\n1,"x # y" # cut\n"# 2","say ""#""" #\n# no row\n3,plain#cut\n')
    rows = csv_files.read_csv(spark, path, {"b": "string"}, trailing_comments=True).collect()
    assert [tuple(r) for r in rows] == [("1", "x # y"), ("# 2", 'say "#"'), ("3", "plain")]


def test_a_hash_in_the_header_is_a_name_without_trailing_comments(spark, tmp_path):
    rows = csv_files.read_csv(spark, write_files(tmp_path, a="a,b#1\n1,2#x\n"), {"a": "int"})
    assert rows.columns == ["a", "b#1"] and [tuple(r) for r in rows.collect()] == [(1, "2#x")]


@pytest.mark.parametrize("trailing", [False, True])
def test_rows_that_equal_the_header_stay_and_columns_go_by_name(spark, tmp_path, trailing):
    path = write_files(tmp_path, a="# c\na,b\n1,2\na,b\n", b="b,a\n4,3\nb,a\n", c="a\n5\n")
    rows = csv_files.read_csv(spark, path, {"a": "string"}, trailing_comments=trailing).collect()
    assert sorted((r["a"], r["b"]) for r in rows if r["b"]) == [("1", "2"), ("3", "4"), ("a", "b"), ("a", "b")]
    assert [r["a"] for r in rows if r["b"] is None] == ["5"]


@pytest.mark.parametrize("trailing", [False, True])
def test_overlong_rows_are_an_error_or_reported_and_short_ones_filled(spark, tmp_path, trailing):
    path = write_files(tmp_path, a='a,b\n1,2\n3\n4,5,6\n7,8,\n"9,10",11\n')
    with pytest.raises(Exception, match="more cells than the header has: 4,5,6|more cells than the header has: 7,8,"):
        csv_files.read_csv(spark, path, {"a": "string"}, trailing_comments=trailing).collect()
    rows = csv_files.read_csv(spark, path, {"a": "string"}, trailing_comments=trailing, corrupt="whole")
    assert [tuple(r) for r in rows.collect()] == [
        ("1", "2", None), ("3", None, None), ("4", "5", "4,5,6"), ("7", "8", "7,8,"), ("9,10", "11", None)
    ]


def test_names_with_dots(spark, tmp_path):
    path = write_files(tmp_path, a="id,x.y\n1,2.5\n2,\n")
    rows = csv_files.read_features_csv(spark, path, ["x.y"])
    assert [r["x.y"] for r in rows.collect()] == [2.5, None]


def test_training_document_round_trip(spark, tmp_path):
    content = {"best_params": {"max_depth": 4}, "training_history": {"tuned": {"val_f1": 0.5, "tuning_time": 2.0}}}
    documents.write_training_document(spark, content, str(tmp_path / "d"))
    document = documents.read_document(spark, str(tmp_path / "d"))
    assert document.first()["best_params"]["max_depth"] == 4 and document.first()["timestamp"]
    assert [(r["split"], r["f1"], r["seconds"]) for r in documents.history_rows("m", document).collect()] == [("val", 0.5, 2.0)]


def test_key_parts_are_kept_apart(spark):
    from siftline.functions.hashing import key_hash

    rows = spark.createDataFrame([("a:", "b"), ("a", ":b"), ("1", "1:b"), (None, "")], "x string, y string")
    assert rows.select(key_hash(1, ["x", "y"])).distinct().count() == 4


def test_shared_folder_comes_from_the_session(spark):
    from siftline.session import new_path, shared_folder

    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    first, second = new_path(spark, "x"), new_path(spark, "x")
    assert first != second and first.startswith(f"{folder}/")
