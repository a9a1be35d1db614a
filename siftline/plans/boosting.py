"""Boosted trees that grow together: fits that differ in settings, seed or held-out fold share every pass over the rows.

A fit by itself is a chain of very short jobs, one for each level of each tree. Here a level of all
fits is one job: tasks add up the rows of each node by binned feature value, a shuffle by fit and node
adds those sums, and the best splits are found where they meet. Tables whose blocks fit a task need no job a level:
a task has all blocks and grows one fit, with the same draws and sums. The steps are those of Spark's
boosted trees for two classes: log-loss, a first tree on the labels as -1 and 1, later ones on the
loss's gradient, variance as impurity, 32 bins a feature found as Spark finds them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.naming import col
from siftline.plans.trees import ensemble_of, reached_nodes
from siftline.session import drop_stored, ensure_checkpointing, ship_package, stored

BINS = 32
#: Rows of a block, which is what a task holds at a time; small tables are one block, as a level is a short job.
BLOCK_ROWS = 25_000
#: Rows from which the bounds of the bins are found, in expectation, as Spark's learner does; every row is fitted.
BOUND_ROWS = 10_000
#: Nodes whose sums travel together.
CHUNK = 256
#: Bytes of sums that the driver adds up by itself, over all tasks; more are added up by a shuffle.
DRIVER_BYTES = 8_000_000
#: Rows of a table, and bytes of its blocks, up to which a task holds all and grows a fit by itself, without a job a level.
ALONE_ROWS = 1_000_000
ALONE_BYTES = 64_000_000
#: Rounds after which the rows' state is written to the checkpoint folder.
CHECKPOINT = 10


@dataclass(frozen=True)
class Member:
    """One of the fits that grow together; rows of the fold ``without`` aren't seen by it."""

    depth: int
    step: float
    least: int
    gain: float
    rate: float
    subset: str
    seed: int
    without: int | None = None

    @staticmethod
    def of(estimator: GBTClassifier, without: int | None = None) -> Member:
        return Member(
            estimator.getMaxDepth(), estimator.getStepSize(), estimator.getMinInstancesPerNode(), estimator.getMinInfoGain(),
            estimator.getSubsamplingRate(), estimator.getFeatureSubsetStrategy(), estimator.getSeed(), without,
        )

    def features(self, width: int) -> int:
        """Features that a node may split by."""
        return features_of(self.subset, width)


def features_of(subset: str, width: int) -> int:
    """Features that a node may split by, of so many, as Spark reads a subset's name."""
    named = {
        "auto": width, "all": width, "sqrt": ceil(width**0.5), "log2": max(1, ceil(log2(width))) if width else 0,
        "onethird": ceil(width / 3),
    }
    if subset in named:
        return named[subset]
    return min(width, int(subset) if subset.isdigit() else ceil(float(subset) * width))


def _bounds(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Values between which the bins of a feature lie: all middles between neighbours, or some at equal strides."""
    distinct, place = np.unique(values, return_inverse=True)
    middles = (distinct[:-1] + distinct[1:]) / 2
    if len(middles) < bins:
        return middles
    counts = np.cumsum(np.bincount(place, weights))
    stride, target, out = counts[-1] / bins, counts[-1] / bins, []
    for i in range(1, len(distinct)):
        if abs(counts[i - 1] - target) < abs(counts[i] - target):
            out.append(middles[i - 1])
            target += stride
    return np.array(out)


@dataclass
class Tree:
    """Nodes in the order in which they were found; a leaf's feature is -1, a right child follows its left one."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    gain: list[float] = field(default_factory=lambda: [-1.0])
    stats: list[np.ndarray] = field(default_factory=lambda: [np.zeros(4)])
    open: list[int] = field(default_factory=lambda: [0])  # nodes to split, all of one level

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature, np.int16), np.array(self.cut, np.int16), np.array(self.left, np.int32)

    def values(self) -> np.ndarray:
        """What a node says: the mean of its rows."""
        stats = np.array(self.stats)
        return stats[:, 2] / stats[:, 1]

    def split(self, node: int, feature: int, cut: int, gain: float, left: np.ndarray, right: np.ndarray) -> list[int]:
        self.feature[node], self.cut[node], self.gain[node], self.left[node] = feature, cut, gain, len(self.left)
        for stats in (left, right):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(-1)
            self.gain.append(-1.0)
            self.stats.append(stats)
        return [len(self.left) - 2, len(self.left) - 1]


def impurity(stats: np.ndarray) -> np.ndarray:
    """Variance from (rows, weight, weighted sum, weighted sum of squares)."""
    weight = np.where(stats[..., 1] > 0, stats[..., 1], 1.0)
    return (stats[..., 3] - stats[..., 2] ** 2 / weight) / weight


@dataclass
class Block:
    """Rows in a task: labels, weights, folds, bins by set of bounds, and the margin that each fit has reached."""

    number: int
    label: np.ndarray
    weight: np.ndarray
    fold: np.ndarray
    bins: np.ndarray
    margin: np.ndarray
    counts: np.ndarray | None = None  # of bags: how often a row is in each
    repeats: bool = False  # a row of a bag is as many rows as it is in it

    def drawn(self, fit: int, member: Member, round_: int) -> np.ndarray:
        """Places of the rows that a fit sees in a round."""
        if self.counts is not None:
            return np.nonzero(self.counts[fit])[0]
        seen = np.ones(len(self.label), bool) if member.without is None else self.fold != member.without
        if member.rate < 1:
            draw = np.random.default_rng([member.seed & 0xFFFFFFFF, round_, self.number])
            seen &= draw.random(len(seen)) < member.rate
        return np.nonzero(seen)[0]

    def target(self, fit: int, rows: np.ndarray, round_: int) -> np.ndarray:
        if self.counts is not None:
            return self.label[rows].astype(np.float64)
        sign = 2.0 * self.label[rows] - 1
        return sign if round_ == 0 else 4 * sign / (1 + np.exp(np.minimum(2 * sign * self.margin[fit, rows], 700)))

    def sums(self, fit: int, member: Member, which: int, round_: int, arrays, opened: np.ndarray) -> np.ndarray:
        """Of each open node, feature and bin: rows, weight, weighted sum and sum of squares of the target."""
        rows = self.drawn(fit, member, round_)
        slots = np.full(len(arrays[0]), -1)
        slots[opened] = np.arange(len(opened))
        slot = slots[self.reached(arrays, which, rows, member.depth)]
        inside = np.nonzero(slot >= 0)[0]
        slot, rows = slot[inside], rows[inside]
        weight = self.weight[rows] if self.counts is None else self.counts[fit, rows].astype(np.float64)
        return node_sums(slot, self.bins[which][:, rows], weight, self.target(fit, rows, round_), len(opened), self.repeats)

    def reached(self, arrays, which: int, rows: np.ndarray, depth: int) -> np.ndarray:
        """The nodes of a tree at which rows are."""
        return reached_nodes(arrays, self.bins[which][:, rows], depth)


def node_sums(
    slot: np.ndarray, bins: np.ndarray, weight: np.ndarray, target: np.ndarray, nodes: int, repeats: bool = False
) -> np.ndarray:
    """Of each node, feature and bin: rows, weight, weighted sum and sum of squares of the target.

    With ``repeats`` a weight is a number of rows and the target 0 or 1: two sums say what the four do.
    """
    at = np.empty(len(slot), np.int64)
    if repeats:
        out, place = np.empty((nodes, len(bins), BINS, 2)), slot * (2 * BINS) + target.astype(np.int64)
        for k, own in enumerate(bins):
            np.multiply(own, 2, out=at, dtype=np.int64)
            at += place
            classes = np.bincount(at, weight, nodes * BINS * 2).reshape(-1, BINS, 2)
            out[:, k, :, 0] = classes.sum(axis=-1)
            out[:, k, :, 1] = classes[..., 1]
        return out
    parts = (None, weight, weight * target, weight * target * target)
    out, slot = np.empty((nodes, len(bins), BINS, len(parts))), slot * BINS
    for k, own in enumerate(bins):
        np.add(slot, own, out=at)
        for j, values in enumerate(parts):
            out[:, k, :, j] = np.bincount(at, values, nodes * BINS).reshape(-1, BINS)
    return out


def best_splits(sums: np.ndarray, member: Member, allowed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each node its best split: feature (-1: none), bin, gain, sums of the node and of its left child."""
    running = np.cumsum(sums, axis=2)
    if running.shape[-1] == 2:
        running = running[..., [0, 0, 1, 1]]
    whole = running[:, 0, -1]
    left = running[:, :, :-1]
    right = whole[:, None, None] - left
    weight = np.where(whole[:, 1] > 0, whole[:, 1], 1.0)[:, None, None]
    gain = impurity(whole)[:, None, None] - (left[..., 1] * impurity(left) + right[..., 1] * impurity(right)) / weight
    valid = (left[..., 0] >= member.least) & (right[..., 0] >= member.least) & (gain >= member.gain) & (gain > 0)
    flat = np.where(valid & allowed[:, :, None], gain, -1.0).reshape(len(sums), -1)
    best = flat.argmax(axis=1)
    nodes = np.arange(len(sums))
    feature, cut = np.divmod(best, BINS - 1)
    return np.where(flat[nodes, best] > 0, feature, -1), cut, flat[nodes, best], whole, left[nodes, feature, cut]


def _encode(bounds: Sequence[Sequence[np.ndarray]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if batches else None
        if table is None or not len(table):
            return
        label, weight, fold = (table.column(k).to_numpy() for k in ("label", "weight", "fold"))
        x = table.column("x").combine_chunks().values.to_numpy().reshape(len(table), -1)
        bins = np.array([[np.searchsorted(b, x[:, k]) for k, b in enumerate(own)] for own in bounds], np.uint8)
        counts = table.column("counts").combine_chunks() if "counts" in table.column_names else None
        if counts is not None:
            counts = np.ascontiguousarray(counts.values.to_numpy().reshape(len(table), -1).T)
        block = (label.astype(np.int8), weight, fold.astype(np.int16), bins, counts)
        number = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([pickle.dumps(block)])], ["number", "block"])

    return run


class Growing:
    """Fits that grow together over the rows of ``table``; ``grow`` adds rounds to those named."""

    def __init__(
        self,
        table: DataFrame,
        members: Sequence[Member],
        label: str = "label",
        weight: str | None = None,
        fold: str | None = None,
        features: str = "features",
        counts: Column | Callable[[int, int], np.ndarray] | None = None,
        block_rows: int | None = None,
    ):
        """``counts`` of bags are an array column, or drawn for a block from its number and rows: rows that repeat."""
        self.spark, self.members, self.trees = table.sparkSession, list(members), [[] for _ in members]
        ensure_checkpointing(self.spark)
        ship_package(self.spark)
        rows = table.select(
            col(label).cast("double").alias("label"),
            (col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"),
            (col(fold).cast("int") if fold else F.lit(-1)).alias("fold"),
            vector_to_array(features).alias("x"),
            *([counts.alias("counts")] if isinstance(counts, Column) else []),
        )
        found = rows.agg(F.count("*"), F.count_if(F.col("label").isin(0.0, 1.0)), F.max(F.size("x"))).first()
        count, self.width = found[0], found[2]
        self.count = count
        if not count or found[1] != count:
            raise ValueError(f"{count - found[1]} of {count} rows have another label than 0 and 1" if count else "no rows to fit")
        self.folds = sorted({m.without for m in members}, key=lambda k: (k is not None, k))
        self.bounds = self._bounds_of(rows.drop("counts"), count)
        parts = -(-count // (block_rows or BLOCK_ROWS))
        rows = rows.coalesce(1) if parts == 1 else rows.repartition(parts)
        self.blocks = stored(rows.mapInArrow(_encode(self.bounds), "number bigint, block binary"), "blocks")
        fits = len(members) if counts is None else 0
        draw = None if counts is None or isinstance(counts, Column) else counts

        def unpacked(r) -> Block:
            label, weight, fold, bins, counts = pickle.loads(r["block"])
            if draw:
                counts = draw(r["number"], len(label))
            return Block(r["number"], label, weight, fold, bins, np.zeros((fits, len(label))), counts, draw is not None)

        self.parts, self._rows = parts, None
        self.alone = counts is None and count <= ALONE_ROWS and count * (len(self.folds) * self.width + 20) <= ALONE_BYTES
        self.state: RDD = self.blocks.rdd.map(unpacked).persist(StorageLevel.MEMORY_AND_DISK)
        self._old: list[RDD] = []
        self._updates = 0

    def _bounds_of(self, rows: DataFrame, count: int) -> list[list[np.ndarray]]:
        sample = rows if count <= BOUND_ROWS else rows.sample(BOUND_ROWS / count, seed=self.members[0].seed)
        found = sample.toPandas()  # some ten thousand rows of numbers
        x, weight, fold = np.array(found["x"].tolist()), found["weight"].to_numpy(), found["fold"].to_numpy()
        out = []
        for without in self.folds:
            seen = np.ones(len(fold), bool) if without is None else fold != without
            if not seen.any():
                raise ValueError(f"no rows to fit but those of fold {without}")
            out.append([_bounds(x[seen, k], weight[seen], min(BINS, int(seen.sum()))) for k in range(self.width)])
        return out

    def level(self, trees: Mapping[int, Tree], round_of: Mapping[int, int]) -> None:
        """Split the open nodes of all trees; what is open afterwards lies a level deeper."""
        members, folds = self.members, self.folds
        jobs = [
            (i, folds.index(members[i].without), round_of[i], tree.arrays(), np.array(tree.open))
            for i, tree in trees.items() if tree.open
        ]
        allowed = {
            (i, start): allowed_by(members[i], self.width, round_, opened[start : start + CHUNK])
            for i, _, round_, _, opened in jobs for start in range(0, len(opened), CHUNK)
        }

        def added(blocks: Iterator[Block]) -> Iterator:
            total: dict[int, np.ndarray] = {}
            for block in blocks:
                for i, which, round_, arrays, opened in jobs:
                    own = block.sums(i, members[i], which, round_, arrays, opened)
                    total[i] = total[i] + own if i in total else own
            for i, sums in total.items():
                for start in range(0, len(sums), CHUNK):
                    yield (i, start), sums[start : start + CHUNK]

        sums = self.state.mapPartitions(added)
        size = sum(len(opened) for *_, opened in jobs) * self.width * BINS * 4 * 8
        if self.parts > 1 and self.parts * size <= DRIVER_BYTES:
            total: dict[tuple[int, int], np.ndarray] = {}
            for key, own in sums.collect():
                total[key] = total[key] + own if key in total else own
            found = [(key, best_splits(own, members[key[0]], allowed[key])) for key, own in total.items()]
        else:
            if self.parts > 1:
                sums = sums.reduceByKey(np.add, min(len(allowed), self.spark.sparkContext.defaultParallelism))
            found = sums.map(lambda kv: (kv[0], best_splits(kv[1], members[kv[0][0]], allowed[kv[0]]))).collect()
        deeper: dict[int, list[int]] = {i: [] for i in trees}
        for (i, start), (feature, cut, gain, whole, left) in sorted(found, key=lambda kv: kv[0]):
            deeper[i] += _split(trees[i], trees[i].open[start : start + CHUNK], feature, cut, gain, whole, left)
        for i, tree in trees.items():
            tree.open = deeper[i]

    def grow(self, rounds: int, live: Sequence[int] | None = None) -> None:
        """Add so many rounds to the fits named, or to all."""
        live = list(range(len(self.members)) if live is None else live)
        if self.alone:
            members, folds, rows, width = self.members, self.folds, self._broadcast(), self.width
            jobs = [(i, members[i], folds.index(members[i].without), self.trees[i]) for i in live]

            def more(job: tuple) -> tuple[int, list[Tree]]:
                i, member, which, trees = job
                return i, _grown_alone(rows.value, member, which, trees, rounds, width)

            if rounds and jobs:
                for i, trees in self.spark.sparkContext.parallelize(jobs, len(jobs)).map(more).collect():
                    self.trees[i] += trees
            return
        for _ in range(rounds):
            round_of = {i: len(self.trees[i]) for i in live}
            trees = {i: Tree() for i in live}
            depth = 0
            while open_ := {i: t for i, t in trees.items() if t.open and depth < self.members[i].depth or not depth}:
                self.level(open_, round_of)
                depth += 1
            self._update(trees)
            for i, tree in trees.items():
                self.trees[i].append(tree)

    def _broadcast(self):
        if self._rows is None:
            blocks = [(r["number"], *pickle.loads(r["block"])[:4]) for r in self.blocks.collect()]
            self._rows = self.spark.sparkContext.broadcast(sorted(blocks, key=lambda block: block[0]))
        return self._rows

    def _update(self, trees: Mapping[int, Tree]) -> None:
        """Add the leaves of new trees to the margins, in the next job that reads the rows."""
        members, folds = self.members, self.folds
        steps = [
            (i, folds.index(members[i].without), tree.arrays(), tree.values() * self._weight(i, len(self.trees[i])))
            for i, tree in trees.items()
        ]

        def moved(block: Block) -> Block:
            margin = block.margin.copy()
            for i, which, arrays, values in steps:
                margin[i] += values[reached_nodes(arrays, block.bins[which], members[i].depth)]
            return Block(block.number, block.label, block.weight, block.fold, block.bins, margin)

        self._updates += 1
        before, self.state = self.state, self.state.map(moved).persist(StorageLevel.MEMORY_AND_DISK)
        self._old.append(before)
        if self._updates % CHECKPOINT == 0:
            self.state.checkpoint()
            self.state.count()
        if len(self._old) > 1:  # the newest one is read once more, for the next state
            self._old.pop(0).unpersist()

    def _weight(self, i: int, round_: int) -> float:
        return _weight(self.members[i], round_)

    def held_f1(self, wanted: Sequence[int], fold_of: Sequence[int]) -> dict[int, float]:
        """F1 of class 1 of some fits on the rows of the folds that they haven't seen, 0 where it is undefined."""

        def counted(block: Block) -> np.ndarray:
            out = np.zeros((len(wanted), 3), np.int64)
            for k, (i, fold) in enumerate(zip(wanted, fold_of, strict=True)):
                held = block.fold == fold
                chosen, positive = block.margin[i, held] > 0, block.label[held] == 1
                out[k] = (chosen & positive).sum(), chosen.sum(), positive.sum()
            return out

        if self.alone:
            members, folds, rows = self.members, self.folds, self._broadcast()
            jobs = [(k, members[i], folds.index(members[i].without), self.trees[i], fold)
                    for k, (i, fold) in enumerate(zip(wanted, fold_of, strict=True))]

            def held(job: tuple) -> tuple[int, np.ndarray]:
                k, member, which, trees, fold = job
                out = np.zeros(3, np.int64)
                for block in _moved(rows.value, member, which, trees, fold):
                    chosen, positive = block.margin[0] > 0, block.label == 1
                    out += (chosen & positive).sum(), chosen.sum(), positive.sum()
                return k, out

            found = self.spark.sparkContext.parallelize(jobs, max(1, len(jobs))).map(held).collect()
            found = np.array([counts for _, counts in sorted(found, key=lambda kv: kv[0])])
        else:
            found = self.state.map(counted).reduce(np.add)
        return {i: float(2 * h / (c + p)) if c + p else 0.0 for i, (h, c, p) in zip(wanted, found.tolist(), strict=True)}

    def model(self, i: int, estimator: GBTClassifier) -> Model:
        """The fit so far as Spark's model."""
        trees, bounds = self.trees[i], self.bounds[self.folds.index(self.members[i].without)]
        return ensemble_of(self.spark, _stump(self.spark, estimator, self.width), [
            _rows(tree, bounds) for tree in trees
        ], [self._weight(i, k) for k in range(len(trees))], "maxIter")

    def close(self) -> None:
        for rdd in (*self._old, self.state):
            rdd.unpersist()
        if self._rows is not None:
            self._rows.destroy()
        drop_stored(self.blocks)

    def __enter__(self) -> Growing:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def allowed_by(member: Member, width: int, round_: int, nodes: Sequence[int]) -> np.ndarray:
    """Of each node the features that it may split by."""
    wanted = member.features(width)
    out = np.full((len(nodes), width), member.depth > 0)
    if 0 < member.depth and wanted < width:
        for k, node in enumerate(nodes):
            draw = np.random.default_rng([member.seed & 0xFFFFFFFF, round_, node, 1])
            out[k, draw.permutation(width)[wanted:]] = False
    return out


def _weight(member: Member, round_: int) -> float:
    return 1.0 if round_ == 0 else member.step


def _split(tree: Tree, nodes: Sequence[int], feature, cut, gain, whole, left) -> list[int]:
    """Split nodes of a tree where there is a best split; the children that may be split further."""
    deeper = []
    for k, node in enumerate(nodes):
        if node == 0:
            tree.stats[0] = whole[k]
        if feature[k] >= 0:
            pair = (left[k], whole[k] - left[k])
            children = tree.split(node, int(feature[k]), int(cut[k]), float(gain[k]), *pair)
            deeper += [c for c, stats in zip(children, pair, strict=True) if impurity(stats) > 2.3e-16]
    return deeper


def _moved(blocks: Sequence[tuple], member: Member, which: int, trees: Sequence[Tree], only: int | None = None) -> list[Block]:
    """Blocks, or their rows of one fold, with the margin that a fit has reached."""
    out = []
    for number, label, weight, fold, bins in blocks:
        if only is not None:
            some = fold == only
            label, weight, fold, bins = label[some], weight[some], fold[some], bins[:, :, some]
        out.append(Block(number, label, weight, fold, bins, np.zeros((1, len(label)))))
    for round_, tree in enumerate(trees):
        _move(out, member, which, tree, round_)
    return out


def _move(blocks: Sequence[Block], member: Member, which: int, tree: Tree, round_: int) -> None:
    arrays, values = tree.arrays(), tree.values() * _weight(member, round_)
    for block in blocks:
        block.margin[0] += values[reached_nodes(arrays, block.bins[which], member.depth)]


def _grown_alone(blocks: Sequence[tuple], member: Member, which: int, trees: Sequence[Tree], rounds: int, width: int) -> list[Tree]:
    """So many more rounds of a fit, from all blocks of its table: what ``Growing.level`` does with a job a level."""
    held, new = _moved(blocks, member, which, trees), []
    for round_ in range(len(trees), len(trees) + rounds):
        tree, depth = Tree(), 0
        while tree.open and depth < member.depth or not depth:
            arrays, opened, deeper = tree.arrays(), tree.open, []
            for start in range(0, len(opened), CHUNK):
                some = opened[start : start + CHUNK]
                sums = sum(block.sums(0, member, which, round_, arrays, np.array(some)) for block in held)
                found = best_splits(sums, member, allowed_by(member, width, round_, some))
                deeper += _split(tree, some, *found)
            tree.open, depth = deeper, depth + 1
        _move(held, member, which, tree, round_)
        new.append(tree)
    return new


def _rows(tree: Tree, bounds: Sequence[np.ndarray]) -> list[tuple]:
    """Nodes as Spark saves them, numbered so that a node is followed by its left branch."""
    order, stack = [], [0]
    while stack:
        node = stack.pop()
        order.append(node)
        if tree.feature[node] >= 0:
            stack += [tree.left[node] + 1, tree.left[node]]
    place = {node: k for k, node in enumerate(order)}
    spread, values, out = impurity(np.array(tree.stats)), tree.values(), []
    for k, node in enumerate(order):
        feature, left, stats = tree.feature[node], tree.left[node], tree.stats[node]
        inner = feature >= 0
        split = (feature, [float(bounds[feature][tree.cut[node]])], -1) if inner else (-1, [], -1)
        children = (place[left], place[left + 1]) if inner else (-1, -1)
        out.append((k, float(values[node]), float(spread[node]), [float(v) for v in stats[1:]], int(stats[0]),
                    float(tree.gain[node]), *children, split))
    return out


def _stump(spark: SparkSession, estimator: GBTClassifier, width: int) -> Model:
    """A model with the estimator's settings and nothing learnt, whose trees are then replaced."""
    weight = estimator.getOrDefault("weightCol") if estimator.isDefined("weightCol") else "_weight"
    rows = [(float(k), 1.0, Vectors.dense([float(k)] * width)) for k in (0, 1)]
    tiny = spark.createDataFrame(rows, [estimator.getLabelCol(), weight or "_weight", estimator.getFeaturesCol()])
    return estimator.copy({estimator.maxIter: 1}).fit(tiny.coalesce(1))


def fitted_model(estimator: GBTClassifier, train: DataFrame) -> Model:
    """``estimator`` fitted on ``train``."""
    with growing(train, [estimator]) as grown:
        grown.grow(estimator.getMaxIter())
        return grown.model(0, estimator)


def growing(train: DataFrame, estimators: Sequence[GBTClassifier]) -> Growing:
    """The rows and members of estimators that differ in nothing but settings and seeds."""
    first = estimators[0]
    weight = first.getOrDefault("weightCol") if first.isDefined("weightCol") else None
    return Growing(train, [Member.of(e) for e in estimators], first.getLabelCol(), weight or None, None, first.getFeaturesCol())
