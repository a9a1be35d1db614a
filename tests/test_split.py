import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftline.functions.hashing import key_hash
from siftline.operators import split

# Class 0 and class 1 rows per split of the catalogue's label files.
GOLDEN = {"train": (3387, 3307), "val": (484, 473), "test": (968, 945)}


def catalogue_labels(spark, partitions=4):
    return spark.range(0, 9564, 1, partitions).select(
        F.col("id").alias("record_id"), (F.col("id") >= 4839).cast("int").alias("label")
    )


def counted(df, *by):
    return {tuple(r)[: len(by)]: r["count"] for r in df.groupBy(*by).count().collect()}


def test_catalogue_class_counts(spark):
    found = counted(split.stratified_split(catalogue_labels(spark), "label", ["record_id"]), "split", "label")
    assert found == {(s, c): rows for s, both in GOLDEN.items() for c, rows in enumerate(both)}


def test_same_members_whatever_the_layout(spark):
    few = split.stratified_split(catalogue_labels(spark, 1), "label", ["record_id"])
    many = split.stratified_split(catalogue_labels(spark, 13).orderBy(F.desc("record_id")), "label", ["record_id"])
    assert few.join(many, ["record_id", "label", "split"]).count() == 9564


def test_members_equal_a_plain_window(spark):
    df = catalogue_labels(spark)
    order = Window.partitionBy("label").orderBy(key_hash(5, ["record_id"]))
    expected = df.withColumn("place", F.row_number().over(order))
    found = split.stratified_split(df, "label", ["record_id"], seed=5)
    joined = found.join(expected, ["record_id", "label"])
    stops = {0: (968, 968 + 484), 1: (945, 945 + 473)}
    for c, (test, val) in stops.items():
        wrong = joined.where(F.col("label") == c).where(
            F.col("split")
            != F.when(F.col("place") <= test, "test").when(F.col("place") <= val, "val").otherwise("train")
        )
        assert wrong.count() == 0


def test_refined_prefixes_give_the_same_members(spark, monkeypatch):
    plain = split.stratified_split(catalogue_labels(spark), "label", ["record_id"])
    monkeypatch.setattr(split, "DIGITS", 1)
    monkeypatch.setattr(split, "RANKED_ROWS", 5)
    refined = split.stratified_split(catalogue_labels(spark), "label", ["record_id"])
    assert plain.join(refined, ["record_id", "label", "split"]).count() == 9564


def test_splitting_needs_no_shuffle(spark, plan):
    text = plan(split.stratified_split(catalogue_labels(spark), "label", ["record_id"]))
    assert "Exchange" not in text and "Window" not in text and "Join" not in text


def test_a_key_shared_at_the_cut_is_reported(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("key"), F.lit(1).alias("label")
    )
    order = split.KeyOrder(df, "label", ["key"], 42)
    first = {
        r["hash"]: r["before"]
        for r in df.select(key_hash(42, ["key"]).alias("hash"))
        .groupBy("hash")
        .count()
        .withColumn("before", F.sum("count").over(Window.orderBy("hash")) - F.col("count"))
        .where("count = 400")
        .collect()
    }
    start = next(iter(first.values()))
    with pytest.raises(ValueError, match="400 rows share one key"):
        order.cut_values({1: [start + 7]})
    if start > 0:
        assert order.cut_values({1: [start]})[1] == list(first)


def test_rows_of_another_label_are_an_error(spark):
    for other in (F.lit(2), F.lit(12), F.lit(-1), F.lit(None).cast("int")):
        df = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, other).otherwise(F.col("id") % 2).alias("label"))
        with pytest.raises(ValueError, match="another label than 0 and 1"):
            split.stratified_split(df, "label", ["id"])


def test_small_and_single_class_tables(spark):
    df = spark.range(7).select("id", F.lit(1).alias("label"))
    found = counted(split.stratified_split(df, "label", ["id"]), "split")
    assert found == {("test",): 2, ("val",): 1, ("train",): 4}
    one = spark.range(1).select("id", F.lit(0).alias("label"))
    assert counted(split.stratified_split(one, "label", ["id"]), "split") == {("test",): 1}


@pytest.mark.parametrize("counts", [{0: 7, 1: 5}, {0: 1, 1: 9}, {0: 100, 1: 3}, {0: 3, 1: 0}])
@pytest.mark.parametrize("folds", [2, 3, 5])
def test_fold_sizes_deal_out_class_sorted_rows(counts, folds):
    labels = [c for c in sorted(counts) for _ in range(counts[c])]
    expected = {c: [0] * folds for c in counts}
    for position, c in enumerate(labels):
        expected[c][position % folds] += 1
    assert split.fold_sizes(counts, folds) == expected


def test_folds_cover_every_row_once(spark):
    df = split.stratified_folds(catalogue_labels(spark), "label", ["record_id"], 3)
    found = counted(df, "fold", "label")
    assert sum(found.values()) == 9564
    for c, sizes in split.fold_sizes({0: 4839, 1: 4725}, 3).items():
        assert [found[(i, c)] for i in range(3)] == sizes


def test_quotas():
    assert split.class_quotas({0: 4839, 1: 4725}, 7651) == {0: 3871, 1: 3780}
    assert split.class_quotas({0: 1, 1: 1}, 1) == {0: 1, 1: 0}
    sizes = split.split_sizes({0: 4933, 1: 10067}, 0.2, 0.125)
    assert (sizes[0][0], sizes[1][0]) == (987, 2013)
    assert math.ceil(0.2 * 15000) == 3000
