"""Cuts in key order, folds that aren't shuffled, inferred types, arriving files that can't be read."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import ordered
from siftline.operators.split import fold_sizes, stratified_folds
from siftline.plans import training
from siftline.plans.prepare import prepare
from siftline.plans.scoring import Scorer
from siftline.sources import csv as csv_source
from siftline.sources.csv import inferred_types, read_csv
from siftline.spec import TableSpec
from siftline.streaming import scoring


def slow_folds(rows, folds):
    """Row -> fold of ``(key..., label)`` rows: each class is cut into runs in the order of its keys."""
    counts = {c: sum(1 for r in rows if r[-1] == c) for c in (0, 1)}
    out = {}
    for c, sizes in fold_sizes({c: n for c, n in counts.items() if n}, folds).items():
        keys = sorted((r[:-1] for r in rows if r[-1] == c), key=lambda k: [(v is not None, v or 0 if v is None else v) for v in k])
        edges = [fold for fold, size in enumerate(sizes) for _ in range(size)]
        out |= {(*key, c): fold for key, fold in zip(keys, edges, strict=True)}
    return out


@pytest.mark.parametrize("ranked,sample", [(200_000, 20_000), (40, 60), (3, 500)])
@pytest.mark.parametrize("folds", [2, 3, 7])
def test_folds_in_key_order(spark, monkeypatch, ranked, sample, folds):
    monkeypatch.setattr(ordered, "RANKED_ROWS", ranked)
    monkeypatch.setattr(ordered, "SAMPLE", sample)
    chosen = random.Random(folds)
    rows = [(f"k{chosen.randrange(40):02d}", i - 300, int(chosen.random() < 0.3)) for i in range(600)]
    rows += [(None, 1, 1), ("a", None, 0)]
    df = spark.createDataFrame(rows, "name string, number int, label int").repartition(5)
    found = stratified_folds(df, "label", ["name", "number"], folds, shuffle=False)
    assert {(r["name"], r["number"], r["label"]): r["fold"] for r in found.collect()} == slow_folds(rows, folds)


def test_small_and_odd_tables_in_key_order(spark):
    df = spark.createDataFrame([(1.5, 1), (0.5, 1)], "key double, label int")
    assert {r["key"]: r["fold"] for r in stratified_folds(df, "label", ["key"], 3, shuffle=False).collect()} == {0.5: 0, 1.5: 1}
    assert stratified_folds(df.limit(0), "label", ["key"], 3, shuffle=False).collect() == []
    with pytest.raises(ValueError, match="another label"):
        stratified_folds(df.withColumn("label", F.lit(2)), "label", ["key"], 3, shuffle=False)
    same = spark.createDataFrame([(1, 1)] * 6, "key int, label int")
    with pytest.raises(ValueError, match="must identify a row"):
        stratified_folds(same, "label", ["key"], 3, shuffle=False).collect()


def test_narrowest_types(spark):
    cells = {
        "int": [" 1", "-2", None, ""], "bigint": ["1", "3000000000", "", "2"], "double": ["1", "2.5", "1e3", "nan"],
        "boolean": ["true", "False", None, ""], "date": ["2020-01-31", "2021-1-2", "", None],
        "timestamp": ["2020-01-31 10:00:00", "2020-01-31", "2020-01-31T10:00", None],
        "string": ["1", "x", "", None], "nothing": ["", None, " ", ""], "suffix": ["1d", "2f", "3", "4"],
        "bad day": ["2020-02-31", "2020-01-01", "", None], "too long": ["99999999999999999999", "1", "", None],
    }
    df = spark.createDataFrame(list(zip(*cells.values(), strict=True)), ", ".join(f"`{n}` string" for n in cells))
    found = inferred_types(df, list(cells))
    expected = {n: n for n in cells} | {"nothing": "string", "suffix": "string", "bad day": "string", "too long": "double"}
    assert found == expected


def test_types_go_by_name_over_all_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# c\nid,x,flag # head\n1,2.5,true # one\n2,,false\n")
    (tmp_path / "b.csv").write_text("flag,more,id\ntrue,text,3\n")
    df = read_csv(spark, str(tmp_path), trailing_comments=True)
    assert dict(df.dtypes) == {"id": "int", "x": "double", "flag": "boolean", "more": "string"}
    rows = {r["id"]: (r["x"], r["flag"], r["more"]) for r in df.collect()}
    assert rows == {1: (2.5, True, None), 2: (None, False, None), 3: (None, True, "text")}


def test_headers_are_read_from_heads_alone(spark, tmp_path, monkeypatch):
    """A header behind more comments than one read holds, in packed files too, and no job over the lines."""
    monkeypatch.setattr(csv_source, "HEAD_BYTES", 16)
    comments = "".join(f"# comment {k}\n" for k in range(40))
    (tmp_path / "a.csv").write_text(comments + '\n"x, y",b # head\n1,2\n')
    with gzip.open(tmp_path / "b.csv.gz", "wt") as packed:
        packed.write(comments + "b,c\r\n3,4\r\n")
    (tmp_path / "c.csv").write_text(comments)
    (tmp_path / "d.csv").write_text("b,c")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    groups = csv_source.header_groups(spark, str(tmp_path), trailing_comments=True)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    names = {header: [file.rsplit("/", 1)[1] for file in files] for header, files in groups.items()}
    assert names == {("x, y", "b"): ["a.csv"], ("b", "c"): ["b.csv.gz", "d.csv"]}
    assert csv_source.header_groups(spark, str(tmp_path / "c.csv")) == {}


@pytest.fixture(scope="module")
def scorer(spark):
    spec = TableSpec(key=("id",), features=("a", "b"), category="kind", label_map={"n": 0, "y": 1})
    rows = [(i, float(i % 10), float(i % 7), "y" if i % 10 > 4 else "n") for i in range(200)]
    table, state = prepare(spark.createDataFrame(rows, "id int, a double, b double, kind string"), spec)
    vectors = training.assembled(table, state.inputs, ["id", "label", "split"])
    model = training.fit(training.boosted_trees({"n_estimators": 2, "max_depth": 2}), vectors.where("split = 'train'")).model
    return Scorer.of(state, model)


def test_arriving_files_are_scored_once_and_bad_ones_reported(spark, scorer, tmp_path):
    inbox, out, progress = (tmp_path / n for n in ("in", "out", "progress"))
    inbox.mkdir()
    (inbox / "one file.csv").write_text("id,a,b\n1,2,3\n2,,4\n3,9,1,7\n")
    (inbox / "other.csv").write_text("b,extra,a\n1,x,2\n")
    (inbox / "lacking.csv").write_text("id,a\n1,2\n")
    (inbox / "empty.csv").write_text("# nothing but a comment\n")
    run = lambda: scoring.score_arriving_csv(spark, str(inbox), scorer, str(out), str(progress), files_per_batch=2)
    done = run()
    assert done.totals(spark).first().asDict() | {"positives": 0} == {
        "rows": 3, "positives": 0, "refused_rows": 1, "refused_files": 2,
    }
    reasons = {r["file"].rsplit("/", 1)[1]: r["reason"] for r in done.refused_files(spark).collect()}
    assert reasons == {"lacking.csv": "Missing columns: b", "empty.csv": "no header"}
    assert [r["line"] for r in done.refused_rows(spark).collect()] == ["3,9,1,7"]
    assert run().totals(spark).first()["rows"] == 3
    (inbox / "late.csv").write_text("a,b\n5,5\n")
    assert run().scored(spark).count() == 4


def test_a_repeated_batch_replaces_its_first_attempt(spark, scorer, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.csv").write_text("a,b\n5,5\n6,1\n")
    batch = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    inbox = scoring.Inbox(str(tmp_path / "out"))
    for _ in range(2):
        scoring._score_batch(batch, 0, scorer, inbox, False)
    assert inbox.scored(spark).count() == 2 and inbox.totals(spark).first()["rows"] == 2
