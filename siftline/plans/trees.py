"""Fitted tree ensembles as tables: their nodes, their first trees, their scores round by round."""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siftline.session import discard, drop_stored, new_path, ship_package, stored

#: Rows of a block that trees are applied to, and bytes of trees that a task holds beside it.
APPLIED_ROWS = 25_000
APPLIED_BYTES = 16_000_000


class StoredForest:
    """A forest in the folder of a saved model: its trees are applied a group at a time, and the driver holds none.

    What only Spark's own model has is asked of that one, which is then loaded.
    """

    def __init__(self, spark: SparkSession, path: str, count: int, features: str):
        self.spark, self.path, self.getNumTrees, self.features = spark, path, count, features
        self._loaded: RandomForestClassificationModel | None = None

    def load(self) -> RandomForestClassificationModel:
        if self._loaded is None:
            self._loaded = RandomForestClassificationModel.load(self.path)
        return self._loaded

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.load(), name)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the columns that Spark's model adds; the rows are stored."""
        trees = self.getNumTrees

        def vote(out: np.ndarray, _: int, tree: Arrays, x: np.ndarray, counts: None) -> None:
            out[0] += tree.share[tree.reached(x)]

        def finish(out: np.ndarray) -> list[pa.Array]:
            return [pa.array(out[0])]

        rows = applied(self, df, vote, 1, finish, [T.StructField("_votes", T.DoubleType())])
        votes, share = F.col("_votes"), F.col("_votes") / trees
        return rows.withColumns(
            {
                "rawPrediction": array_to_vector(F.array(trees - votes, votes)),
                "probability": array_to_vector(F.array(1 - share, share)),
                "prediction": (votes > trees - votes).cast("double"),
            }
        ).drop("_votes")


@contextmanager
def saved(spark: SparkSession, model: Model | StoredForest) -> Iterator[str]:
    """The folder of a saved model, deleted afterwards; that of a stored forest stays."""
    if isinstance(model, StoredForest):
        yield model.path
        return
    path = new_path(spark, "model")
    model.save(path)
    yield path
    discard(spark, path)


#: Columns of a saved ensemble's node and tree tables, the only layout that is read and written here (fixed value).
NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>,"
    " rawCount: bigint, gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int,"
    " leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)
_TREES = "_1 int, _2 string, _3 double"
_TREE_OF = {"data": "treeID", "treesMetadata": "_1"}


def _read(spark: SparkSession, path: str, part: str) -> DataFrame:
    """A table of a saved ensemble; another layout than the known one is an error, not a wrong model."""
    table = spark.read.parquet(f"{path}/{part}")
    known = spark.createDataFrame([], NODES if part == "data" else _TREES).schema
    if table.schema.simpleString() != known.simpleString():
        raise ValueError(f"unknown layout of saved trees: {table.schema.simpleString()}")
    return table


def _replace(spark: SparkSession, path: str, count: int, nodes: DataFrame, trees: DataFrame, counted: str) -> None:
    """Give the model that is saved at ``path`` other nodes and trees; ``counted`` is the setting that holds their number."""
    about = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    about["numTrees"] = count
    about["paramMap"][counted] = count
    nodes.write.mode("overwrite").parquet(f"{path}/data")
    trees.write.mode("overwrite").parquet(f"{path}/treesMetadata")
    line = spark.createDataFrame([(json.dumps(about),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def _written(spark: SparkSession, model: Model, count: int, nodes: DataFrame, trees: DataFrame, counted: str) -> Model:
    """A model like ``model`` with other nodes and trees."""
    model = model.load() if isinstance(model, StoredForest) else model
    with saved(spark, model) as path:
        _replace(spark, path, count, nodes, trees, counted)
        return type(model).load(path)


def stored_forest(
    spark: SparkSession, model: RandomForestClassificationModel, nodes: DataFrame | None = None, trees: int | None = None
) -> StoredForest:
    """``model`` as a stored forest, with ``nodes`` of so many trees in place of its own where they are given."""
    path = new_path(spark, "forest")
    model.save(path)
    if nodes is not None:
        _read(spark, path, "data")  # raises for an unknown layout
        one = _read(spark, path, "treesMetadata").first()["_2"]
        about = spark.range(trees).select(F.col("id").cast("int").alias("_1"), F.lit(one).alias("_2"), F.lit(1.0).alias("_3"))
        _replace(spark, path, trees, nodes, about.coalesce(1), "numTrees")
    return StoredForest(spark, path, model.getNumTrees if trees is None else trees, model.getFeaturesCol())


def first_trees(spark: SparkSession, model: Model, keep: int) -> Model:
    """The model of the first ``keep`` trees: of boosted ones what a fit of so many rounds gives, without a second fit."""
    counted = "maxIter" if isinstance(model, GBTClassificationModel) else "numTrees"
    with saved(spark, model) as path:
        nodes = _read(spark, path, "data").where(F.col("treeID") < keep)
        trees = _read(spark, path, "treesMetadata").where(F.col("_1") < keep)
        return _written(spark, model, keep, nodes, trees, counted)


def ensemble_of(
    spark: SparkSession, model: Model, trees: Sequence[Sequence[tuple]] | DataFrame, weights: Sequence[float], counted: str
) -> Model:
    """``model`` with other trees: of each its nodes as they are saved, in a list or a table, and its weight."""
    with saved(spark, model) as path:
        known = spark.createDataFrame([], NODES).schema
        kinds = _read(spark, path, "data").schema  # raises for an unknown layout
        one = _read(spark, path, "treesMetadata").first()
        if not isinstance(trees, DataFrame):
            names = [f.name for f in known["nodeData"].dataType.fields]
            split = [f.name for f in known["nodeData"].dataType["split"].dataType.fields]
            flat = [
                {"treeID": k, "nodeData": {**dict(zip(names, row[:-1])), "split": dict(zip(split, row[-1], strict=True))}}
                for k, tree in enumerate(trees) for row in tree
            ]
            trees = spark.createDataFrame(pa.Table.from_pylist(flat, to_arrow_schema(kinds))).coalesce(1)
        about = spark.createDataFrame([(k, one["_2"], float(w)) for k, w in enumerate(weights)], _TREES)
        return _written(spark, model, len(weights), trees, about.coalesce(1), counted)


def merged(
    spark: SparkSession, models: Sequence[RandomForestClassificationModel], threads: int = 8
) -> RandomForestClassificationModel:
    """One forest of all trees of ``models``, in their order. Their tables are read together, however many there are."""
    folder = new_path(spark, "models")

    def save(k: int) -> None:
        models[k].save(f"{folder}/{k}")

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(inheritable_thread_target(spark)(save), range(len(models))))
    firsts = F.lit(np.cumsum([0, *(model.getNumTrees for model in models)])[:-1].astype(np.int32))
    owner = F.regexp_extract("_metadata.file_path", r"/([0-9]+)/[^/]+/[^/]+$", 1).cast("int")
    nodes, trees = (
        table.withColumn(tree, F.col(tree) + F.get(firsts, owner)).select(*table.columns)
        for table, tree in ((_read(spark, f"{folder}/*", part), tree) for part, tree in _TREE_OF.items())
    )
    out = _written(spark, models[0], sum(m.getNumTrees for m in models), nodes, trees, "numTrees")
    discard(spark, folder)
    return out


def _stops(left: np.ndarray, right: np.ndarray, rows: np.ndarray, least: int, depth: int) -> np.ndarray:
    """For each node of some trees where a row that passes it stops, or -1 if not yet there.

    A row stops at the first node that is a leaf, has fewer than ``least`` rows or lies at ``depth``.
    Nodes go level by level from those that are no node's child, all trees together.
    """
    stop, inner = np.full(len(left), -1), left >= 0
    root = np.ones(len(left), bool)
    root[left[inner]] = root[right[inner]] = False
    nodes, level = np.nonzero(root)[0], 0
    while len(nodes):
        ends = (stop[nodes] < 0) & (~inner[nodes] | (rows[nodes] < least) | (level >= depth))
        stop[nodes[ends]] = nodes[ends]
        parents = nodes[inner[nodes]]
        stop[left[parents]] = stop[right[parents]] = stop[parents]
        nodes, level = np.concatenate([left[parents], right[parents]]), level + 1
    return stop


def _prune(least: int, depth: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(tree: pd.DataFrame) -> pd.DataFrame:
        tree = tree.sort_values("id").reset_index(drop=True)
        stop = _stops(*(tree[name].to_numpy() for name in ("leftChild", "rightChild", "rawCount")), least, depth)
        kept = np.nonzero((stop < 0) | (stop == np.arange(len(tree))))[0]
        place = np.full(len(tree), -1)
        place[kept] = np.arange(len(kept))
        leaf = stop[kept] >= 0
        out = tree.iloc[kept].copy()
        out["id"] = np.arange(len(kept))
        for child in ("leftChild", "rightChild"):
            out[child] = np.where(leaf, -1, place[np.maximum(out[child].to_numpy(), 0)])
        out["gain"] = np.where(leaf, -1.0, out["gain"])
        out["featureIndex"] = np.where(leaf, -1, out["featureIndex"])
        out["leftCategoriesOrThreshold"] = [
            [] if gone else values for gone, values in zip(leaf, out["leftCategoriesOrThreshold"])
        ]
        out["numCategories"] = np.where(leaf, -1, out["numCategories"])
        return out

    return run


def pruned(
    spark: SparkSession, model: RandomForestClassificationModel | StoredForest, least: int, depth: int = 30
) -> RandomForestClassificationModel | StoredForest:
    """The forest without splits of nodes that have fewer than ``least`` rows of their bag, or that lie at ``depth``.

    A node has no more rows than its parent, so what a limit forbids is all below the first such
    node. Each tree is pruned by itself. What is stored stays so.
    """
    ship_package(spark)
    with saved(spark, model) as path:
        nodes = _read(spark, path, "data").select("treeID", "nodeData.*").select("*", "split.*").drop("split")
        kept = nodes.groupBy("treeID").applyInPandas(_prune(least, depth), nodes.schema)
        split = F.struct("featureIndex", "leftCategoriesOrThreshold", "numCategories").alias("split")
        names = [name for name in nodes.columns if name not in ("treeID", "featureIndex", "leftCategoriesOrThreshold", "numCategories")]
        kept = kept.select("treeID", F.struct(*names, split).alias("nodeData"))
        if isinstance(model, StoredForest):
            new = new_path(spark, "forest")
            for part in ("metadata", "treesMetadata"):
                table = spark.read.format("text" if part == "metadata" else "parquet").load(f"{path}/{part}").coalesce(1)
                table.write.format("text" if part == "metadata" else "parquet").save(f"{new}/{part}")
            kept.write.parquet(f"{new}/data")
            return StoredForest(spark, new, model.getNumTrees, model.features)
        return _written(spark, model, model.getNumTrees, kept, _read(spark, path, "treesMetadata"), "numTrees")


def fewest_split_rows(spark: SparkSession, model: Model) -> int | None:
    """The smallest number of rows of a node that is split; none where no tree has a split."""
    with saved(spark, model) as path:
        inner = _read(spark, path, "data").where("nodeData.leftChild >= 0")
        return inner.agg(F.min("nodeData.rawCount")).first()[0]


def root_rows(spark: SparkSession, model: Model) -> int:
    """The smallest number of rows at the root of a tree."""
    with saved(spark, model) as path:
        return _read(spark, path, "data").where("nodeData.id = 0").agg(F.min("nodeData.rawCount")).first()[0]


def inner_gains(spark: SparkSession, model: Model) -> list[Row]:
    """``(treeID, featureIndex, gain)``: the gains of each tree's splits by a feature, times the weight of their rows."""
    with saved(spark, model) as path:
        nodes = _read(spark, path, "data").select("treeID", "nodeData.*").where("leftChild >= 0")
        weight = F.aggregate("impurityStats", F.lit(0.0), lambda a, b: a + b)
        gains = nodes.groupBy("treeID", F.col("split.featureIndex").alias("featureIndex"))
        return gains.agg(F.sum(F.col("gain") * weight).alias("gain")).collect()  # a row for each tree and feature


def _leaf_order(spark: SparkSession, model: Model) -> pd.DataFrame:
    """The nodes of a model, by tree and id; leaves in this order are those that ``leafCol`` counts."""
    with saved(spark, model) as path:
        columns = ["treeID", *(f"nodeData.{n}" for n in ("id", "prediction", "rawCount", "leftChild", "rightChild"))]
        columns += [F.col("nodeData.impurityStats")[k].alias(f"class_{k}") for k in (0, 1)]
        nodes = _read(spark, path, "data").select(*columns).toPandas()  # the driver holds the model as well
    return nodes.sort_values(["treeID", "id"]).reset_index(drop=True)


def leaf_values(spark: SparkSession, model: GBTClassificationModel) -> list[np.ndarray]:
    """Of each tree the weighted values of its leaves, in the order of ``leafCol``."""
    nodes = _leaf_order(spark, model)
    leaves = nodes[nodes["leftChild"] < 0]
    values = [leaves["prediction"].to_numpy()[leaves["treeID"] == k] for k in range(model.getNumTrees)]
    return [v * w for v, w in zip(values, model.treeWeights, strict=True)]


def leaf_shares(
    spark: SparkSession, model: RandomForestClassificationModel, limits: Sequence[tuple[int, int]] = ((2, 30),)
) -> list[list[np.ndarray]]:
    """For each ``(least rows, depth)`` and each tree: class 1's share at the node where the rows of each leaf stop.

    So one fitted forest gives the votes of all the forests that it can be pruned to.
    """
    nodes = _leaf_order(spark, model)
    share = (nodes["class_1"] / (nodes["class_0"] + nodes["class_1"])).to_numpy()
    tree, left, right, rows = (nodes[name].to_numpy() for name in ("treeID", "leftChild", "rightChild", "rawCount"))
    edges = np.searchsorted(tree, np.arange(model.getNumTrees + 1))
    first, leaf = edges[tree], left < 0
    left, right = np.where(leaf, -1, left + first), np.where(leaf, -1, right + first)
    ends = np.cumsum(np.bincount(tree[leaf], minlength=model.getNumTrees))[:-1]
    return [np.split(share[_stops(left, right, rows, least, depth)[leaf]], ends) for least, depth in limits]


def with_terms(model: Model, df: DataFrame, values: Sequence[Sequence[np.ndarray]], names: Sequence[str]) -> DataFrame:
    """``df`` with one array column for each name: what each tree of the model adds to the row, by its leaf's value.

    The model is applied once, however many sets of leaf values there are.
    """
    leaves = vector_to_array("_leaves").cast("array<int>")
    staged = model.copy({model.leafCol: "_leaves"}).transform(df.drop("rawPrediction", "probability", "prediction"))
    staged = staged.drop("rawPrediction", "probability", "prediction").withColumn("_leaves", leaves)
    starts = F.lit(np.cumsum([0, *map(len, values[0])])[:-1].astype(np.int32))
    at = staged.withColumn("_leaves", F.zip_with("_leaves", starts, lambda leaf, start: leaf + start))
    return at.withColumns(
        {name: _looked_up(np.concatenate(trees)) for name, trees in zip(names, values, strict=True)}
    ).drop("_leaves")


def _looked_up(values: np.ndarray) -> Column:
    flat = F.lit(values)  # one literal, however many leaves
    return F.transform("_leaves", lambda leaf: F.get(flat, leaf))


def summed(
    model: Model,
    df: DataFrame,
    keep: Sequence[str],
    values: Sequence[Sequence[np.ndarray]],
    wanted: Sequence[tuple[int, int]],
    name: str,
) -> DataFrame:
    """The columns ``keep`` and an array ``name``: for each ``(k, n)`` of ``wanted`` what the first n trees add by ``values[k]``.

    The model is applied once; the sums of a batch of rows are made together, in the task that has the rows.
    """
    ship_package(df.sparkSession)
    starts = np.cumsum([0, *map(len, values[0])])[:-1]
    flat = [np.concatenate(trees) for trees in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = len(batch)
            leaves = batch.column("_leaves").values.to_numpy().reshape(rows, len(starts)).astype(np.int64) + starts
            out = np.zeros((rows, len(wanted)))
            for k, own in enumerate(flat):
                sums = np.cumsum(own[leaves], axis=1)
                for place, (which, n) in enumerate(wanted):
                    if which == k:
                        out[:, place] = sums[:, n - 1]
            offsets = pa.array(np.arange(rows + 1) * len(wanted), pa.int32())
            found = pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*keep, name])

    leaves = vector_to_array("_leaves").cast("array<int>").alias("_leaves")
    staged = model.copy({model.leafCol: "_leaves"}).transform(df.select(*keep, model.getFeaturesCol()))
    rows = staged.select(*keep, leaves)
    kinds = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, `{name}` array<double>")


@dataclass
class Arrays:
    """A tree's nodes: what they split by, their left child, behind which the right one is, their rows and class 1's share."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    rows: np.ndarray
    share: np.ndarray

    def reached(self, x: np.ndarray) -> np.ndarray:
        return reached_nodes((self.feature, self.cut, self.left), x, len(self.left))

    def stops(self, least: int, depth: int) -> np.ndarray:
        """The node at which the rows of each node stop, or -1 above those."""
        return _stops(self.left, np.where(self.left < 0, -1, self.left + 1), self.rows, least, depth)


def reached_nodes(arrays: Sequence[np.ndarray], values: np.ndarray, depth: int) -> np.ndarray:
    """The node that each row has reached; ``values`` has a row of the array for each feature. A right child follows its left one."""
    feature, cut, left = arrays
    rows = values.shape[1]
    node, flat, at, own = np.zeros(rows, np.int32), values.ravel(), None, np.zeros(rows, np.int32)
    for _ in range(min(depth, len(feature))):
        by = feature[own]
        inner = by >= 0
        if not inner.all():
            kept = np.nonzero(inner)[0]
            if not len(kept):
                break
            at, own, by = kept if at is None else at[kept], own[kept], by[kept]
        place = by.astype(np.int64) * rows
        place += np.arange(rows) if at is None else at
        own = left[own] + (flat[place] > cut[own])
        if at is None:
            node = own
        else:
            node[at] = own
    return node


def _packed(tree: pd.DataFrame) -> pd.DataFrame:
    """A saved tree's nodes as ``Arrays``, numbered so that a right child follows its left one."""
    tree = tree.sort_values("id")
    left, right = tree["left"].to_numpy(), tree["right"].to_numpy()
    inner = np.nonzero(left >= 0)[0]
    order = np.zeros(len(tree), np.int64)
    order[1::2], order[2::2] = left[inner], right[inner]
    place = np.empty(len(tree), np.int64)
    place[order] = np.arange(len(tree))
    values = {name: tree[name].to_numpy()[order] for name in ("feature", "cut", "rows", "none", "one")}
    moved = np.where(left[order] >= 0, place[np.maximum(left[order], 0)], -1)
    whole = values["none"] + values["one"]
    arrays = Arrays(
        values["feature"].astype(np.int16), values["cut"].astype(np.float64), moved.astype(np.int32),
        values["rows"].astype(np.int64), values["one"] / np.where(whole > 0, whole, 1),
    )
    return pd.DataFrame({"number": [int(tree["treeID"].iloc[0])], "tree": [pickle.dumps(arrays)]})


def applied(
    forest: StoredForest,
    df: DataFrame,
    vote: Callable[[np.ndarray, int, Arrays, np.ndarray, np.ndarray | None], None],
    outputs: int,
    finish: Callable[[np.ndarray], list[pa.Array]],
    fields: Sequence[T.StructField],
    counts: str | None = None,
) -> DataFrame:
    """``df`` with ``fields``, which ``finish`` makes of what all trees have added to each row's ``outputs`` numbers.

    ``vote`` adds those of a tree, from its number and arrays, to a block's rows, features first; the array column
    ``counts`` comes with them. A task has one block of rows and one group of trees; sums of groups are added in
    the order of the trees. The rows are stored.
    """
    spark = forest.spark
    ship_package(spark)
    table = spark.read.parquet(f"{forest.path}/data")
    node = lambda name: F.col(f"nodeData.{name}")
    columns = ["treeID", node("id").alias("id"), node("leftChild").alias("left"), node("rightChild").alias("right"),
               node("rawCount").alias("rows"), node("split.featureIndex").alias("feature"),
               F.coalesce(F.get(node("split.leftCategoriesOrThreshold"), F.lit(0)), F.lit(0.0)).alias("cut"),
               *(node("impurityStats")[k].alias(name) for k, name in enumerate(("none", "one")))]
    packed = stored(table.select(*columns).groupBy("treeID").applyInPandas(_packed, "number int, tree binary"), "trees")
    size = packed.agg(F.sum(F.length("tree"))).first()[0] or 0
    given = df.select(*(f"`{name}`" for name in df.columns), vector_to_array(forest.features).alias("_x"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, made = [], 0, 0

        def block() -> pa.RecordBatch:
            one = pa.Table.from_batches(held).combine_chunks()
            x = np.ascontiguousarray(one.column("_x").combine_chunks().flatten().to_numpy().reshape(len(one), -1).T)
            own = None
            if counts:
                own = one.column(counts).combine_chunks().flatten().to_numpy().reshape(len(one), -1)
                own = np.ascontiguousarray(own.T)
            one, sink = one.drop_columns(["_x"]), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, one.schema) as writer:
                writer.write_table(one)
            number = (TaskContext.get().partitionId() << 24) + made
            values = [pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([pickle.dumps((x, own))], pa.binary())]
            return pa.RecordBatch.from_arrays(values, ["number", "rows", "x"])

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= APPLIED_ROWS:
                yield block()
                held, rows, made = [], 0, made + 1
        if rows:
            yield block()

    parts = stored(given.mapInArrow(blocks, "number bigint, rows binary, x binary"), "applied")
    trees, cores = forest.getNumTrees, spark.sparkContext.defaultParallelism
    found = parts.select("number", "x").rdd
    groups = min(trees, max(-(-size // APPLIED_BYTES), -(-2 * cores // max(1, found.getNumPartitions()))))
    own = packed.rdd.map(lambda r: (r["number"] * groups // trees, (r["number"], bytes(r["tree"]))))
    grouped = own.partitionBy(groups, lambda g: g).mapPartitions(lambda some: [_group(some)]).persist(StorageLevel.MEMORY_AND_DISK)

    def added(pair: tuple) -> tuple:
        block, (group, some) = pair
        x, unseen = pickle.loads(block["x"])
        out = np.zeros((outputs, x.shape[1]))
        for number, tree in some:
            vote(out, number, pickle.loads(tree), x, unseen)
        return block["number"], (group, out)

    sums = found.cartesian(grouped).map(added)
    rest = parts.select("number", "rows").rdd.map(lambda r: (r["number"], (-1, bytes(r["rows"]))))

    def summed_up(item: tuple) -> tuple:
        found = sorted(item[1], key=lambda part: part[0])
        return bytearray(found[0][1]), bytearray(pickle.dumps(sum(part[1] for part in found[1:])))

    tasks = max(1, min(4 * cores, found.getNumPartitions()))
    ready = spark.createDataFrame(rest.union(sums).groupByKey(tasks).map(summed_up), "rows binary, sums binary")
    kinds = T.StructType([*df.schema.fields, *fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kept, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = pa.ipc.open_stream(kept).read_all().combine_chunks()
                more = finish(pickle.loads(sums))
                columns = [*(c.combine_chunks() for c in one.columns), *more]
                yield pa.RecordBatch.from_arrays(columns, [field.name for field in kinds.fields])

    out = stored(ready.mapInArrow(rows, kinds), "scored")
    grouped.unpersist()
    for table in (parts, packed):
        drop_stored(table)
    return out


def _group(some: Iterator[tuple[int, tuple[int, bytes]]]) -> tuple[int, list[tuple[int, bytes]]]:
    found = list(some)
    return (found[0][0] if found else 0), sorted((tree for _, tree in found), key=lambda tree: tree[0])


def staged_votes(
    forest: StoredForest, df: DataFrame, keep: Sequence[str], limits: Sequence[tuple[int, int]],
    wanted: Sequence[tuple[int, int]], name: str,
) -> DataFrame:
    """The columns ``keep`` and an array ``name``: for each ``(k, n)`` what the first n trees, cut at ``limits[k]``, say beyond a half."""

    def vote(out: np.ndarray, number: int, tree: Arrays, x: np.ndarray, counts: None) -> None:
        leaf = tree.reached(x)
        for k, limit in enumerate(limits):
            own = tree.share[np.maximum(tree.stops(*limit), 0)][leaf] - 0.5
            for place, (which, n) in enumerate(wanted):
                if which == k and number < n:
                    out[place] += own

    def finish(out: np.ndarray) -> list[pa.Array]:
        offsets = pa.array(np.arange(out.shape[1] + 1) * len(wanted), pa.int32())
        return [pa.ListArray.from_arrays(offsets, pa.array(out.T.ravel()))]

    rows = df.select(*keep, forest.features)
    found = applied(forest, rows, vote, len(wanted), finish, [T.StructField(name, T.ArrayType(T.DoubleType()))])
    return found.select(*keep, name)


def unseen_votes(forest: StoredForest, df: DataFrame, counts: str) -> DataFrame:
    """``df`` with ``oob_votes`` and ``oob_score``: how many trees have a count of zero, and the mean of their leaves' shares."""

    def vote(out: np.ndarray, number: int, tree: Arrays, x: np.ndarray, counts: np.ndarray) -> None:
        unseen = np.nonzero(counts[number] == 0)[0]
        out[0, unseen] += 1
        out[1, unseen] += tree.share[tree.reached(x[:, unseen])]

    def finish(out: np.ndarray) -> list[pa.Array]:
        votes, total = out
        return [pa.array(votes.astype(np.int32)), pa.array(total / np.maximum(votes, 1), mask=votes == 0)]

    fields = [T.StructField("oob_votes", T.IntegerType()), T.StructField("oob_score", T.DoubleType())]
    return applied(forest, df, vote, 2, finish, fields, counts)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = batch.column("_terms")
        sums = np.cumsum(terms.values.to_numpy().reshape(len(terms), -1), axis=1) if len(terms) else np.zeros((0, 0))
        offsets = pa.array(np.arange(len(terms) + 1) * (sums.shape[1] if len(terms) else 0), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))], batch.schema.names
        )


def staged_scores(spark: SparkSession, model: GBTClassificationModel, df: DataFrame) -> DataFrame:
    """``df``, but for the vector, with ``round`` and ``score``: each row's class-1 probability after every round.

    A row's running sums are made in one go, so the work grows with the rounds and not with their square.
    """
    ship_package(spark)
    kept = [name for name in df.columns if name != model.getFeaturesCol()]
    flat = with_terms(model, df, [leaf_values(spark, model)], ["_terms"]).select(*kept, "_terms")
    margins = flat.mapInArrow(_running, flat.schema)
    rows = margins.select(*kept, F.posexplode("_terms").alias("_round", "_margin"))
    score = 1 / (1 + F.exp(-2 * F.col("_margin")))
    return rows.select(*kept, (F.col("_round") + 1).alias("round"), score.alias("score"))
