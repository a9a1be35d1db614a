"""Trees over bags of rows, known row by row or drawn, grown together: a pass over the rows a level, for all bags.

Nodes of many rows are split by sums over the whole table, as in ``boosting``. The rows of a node that has become
small meet in one task, which splits them to the end: such a group has no more than ``MEET_ROWS`` rows. The trees
are stored, and not gathered by the driver.
"""

from __future__ import annotations

import pickle
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.plans.boosting import BINS, Block, Growing, Member, Tree, best_splits, impurity, node_sums
from siftline.plans.trees import NODES, Arrays, StoredForest, stored_forest

#: Rows of a node that meet in one task, and values of their features, at most.
MEET_ROWS = 1_000_000
MEET_VALUES = 16_000_000
#: Rows of a block with a forest's drawn bags, a byte a row and bag.
BAG_ROWS = 10_000
#: Rows of all bags for each task that ends subtrees, where there are fewer than four tasks a core.
TASK_ROWS = 50_000
#: Bytes of a table's binned rows that every task of a search may hold, and trees that one grows.
TOGETHER_BYTES = 64_000_000
SEARCH_TREES = 50
#: Nodes whose sums a task holds at a time.
HELD_NODES = 256


def _finish(
    bins: np.ndarray, label: np.ndarray, weight: np.ndarray, member: Member, depth: int, seed: Sequence[int], repeats: bool
) -> Tree:
    """The subtree below a node at ``depth`` from all of its rows."""
    tree, draw, wanted = Tree(), np.random.default_rng(seed), member.features(len(bins))
    label, flat, count = label.astype(np.float64), np.ascontiguousarray(bins).ravel(), len(label)
    rows, at = np.arange(count), np.zeros(count, np.int64)  # by the open node that they have reached
    while tree.open and depth < member.depth:
        deeper, kept_rows, kept_at = [], [], []
        for start in range(0, len(tree.open), HELD_NODES):
            nodes = tree.open[start : start + HELD_NODES]
            a, b = np.searchsorted(at, [start, start + len(nodes)])
            some, own = rows[a:b], at[a:b] - start
            allowed = draw.random((len(nodes), len(bins))).argsort(axis=1) < wanted
            sums = node_sums(own, np.take(bins, some, axis=1), weight[some], label[some], len(nodes), repeats)
            feature, cut, gain, whole, left = best_splits(sums, member, allowed)
            right = whole - left
            open_ = np.stack([impurity(left), impurity(right)], axis=1) > 2.3e-16
            goes_on = np.full((len(nodes), 2), -1, np.int64)  # places of children among the open nodes of the next level
            for k, node in enumerate(nodes):
                if node == 0:
                    tree.stats[0] = whole[k]
                if feature[k] >= 0:
                    children = tree.split(node, int(feature[k]), int(cut[k]), float(gain[k]), left[k], right[k])
                    for side in (0, 1):
                        if open_[k, side]:
                            goes_on[k, side] = len(deeper)
                            deeper.append(children[side])
            by = np.maximum(feature, 0)[own]
            place = goes_on[own, (flat[by * count + some] > cut[own]).astype(np.int8)]
            inside = np.nonzero(place >= 0)[0]
            kept_rows.append(some[inside])
            kept_at.append(place[inside])
        rows, at = np.concatenate(kept_rows), np.concatenate(kept_at)
        order = np.argsort(at.astype(np.uint16) if len(deeper) < 1 << 16 else at, kind="stable")
        rows, at = rows[order], at[order]
        tree.open, depth = deeper, depth + 1
    return tree


def _joined(top: Tree, below: Sequence[tuple[int, Tree]]) -> Tree:
    """A tree whose nodes ``below`` go on with subtrees."""
    for node, sub in below:
        shift = len(top.feature) - 1  # the root of a subtree is a node that is there already
        moved = [left + shift if left >= 0 else -1 for left in sub.left]
        top.feature[node], top.cut[node], top.left[node], top.gain[node] = sub.feature[0], sub.cut[0], moved[0], sub.gain[0]
        if sub.stats[0][1]:
            top.stats[node] = sub.stats[0]
        for own, more in ((top.feature, sub.feature), (top.cut, sub.cut), (top.left, moved), (top.gain, sub.gain)):
            own += more[1:]
        top.stats += sub.stats[1:]
    return top


def _merge_leaves(tree: Tree) -> None:
    """Two leaves of the same class become one, from the bottom up, as in the library's trees."""
    chosen = [2 * stats[2] > stats[1] for stats in tree.stats]
    for node in range(len(tree.feature) - 1, -1, -1):  # a child has a larger number than its parent
        left = tree.left[node]
        if tree.feature[node] >= 0 and tree.feature[left] < 0 and tree.feature[left + 1] < 0 and chosen[left] == chosen[left + 1]:
            tree.feature[node], tree.left[node], tree.gain[node] = -1, -1, -1.0


def _saved(number: int, tree: Tree, bounds: Sequence[np.ndarray]) -> pa.RecordBatch:
    """Nodes as Spark saves those of a forest, numbered so that a node is followed by its left branch."""
    _merge_leaves(tree)
    order, stack = [], [0]
    while stack:
        node = stack.pop()
        order.append(node)
        if tree.feature[node] >= 0:
            stack += [tree.left[node] + 1, tree.left[node]]
    place = np.zeros(len(tree.feature) + 1, np.int64)
    place[order] = np.arange(len(order))
    stats, feature, left = np.array(tree.stats)[order], np.array(tree.feature)[order], np.array(tree.left)[order]
    inner = feature >= 0
    gini = np.column_stack([stats[:, 1] - stats[:, 2], stats[:, 2]])
    cuts = [float(bounds[tree.feature[node]][tree.cut[node]]) for node in order if tree.feature[node] >= 0]
    integer = lambda values: pa.array(values.astype(np.int32))
    split = pa.StructArray.from_arrays(
        [integer(feature), pa.ListArray.from_arrays(integer(np.cumsum([0, *inner])), pa.array(cuts, pa.float64())),
         integer(np.full(len(order), -1))],
        ["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
    )
    columns = {
        "id": integer(np.arange(len(order))),
        "prediction": pa.array((gini[:, 1] > gini[:, 0]).astype(np.float64)),
        "impurity": pa.array(2 * impurity(stats)),  # of two classes: twice the variance
        "impurityStats": pa.ListArray.from_arrays(integer(np.arange(len(order) + 1) * 2), pa.array(gini.ravel())),
        "rawCount": pa.array(stats[:, 0].astype(np.int64)),
        "gain": pa.array(np.where(inner, 2 * np.array(tree.gain)[order], -1.0)),
        "leftChild": integer(np.where(inner, place[np.maximum(left, 0)], -1)),
        "rightChild": integer(np.where(inner, place[np.maximum(left + 1, 0)], -1)),
        "split": split,
    }
    data = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    return pa.RecordBatch.from_arrays([integer(np.full(len(order), number)), data], ["treeID", "nodeData"])


def fit_known_bags(
    estimator: RandomForestClassifier, train: DataFrame, counts: Column, bags: int
) -> StoredForest:
    """A forest of one tree a bag; ``counts`` is an array of how often the row is in each bag."""
    return _grown(estimator, train, [estimator.getSeed() + bag for bag in range(bags)], estimator.getFeatureSubsetStrategy(), counts)


def can_fit(estimator: RandomForestClassifier, train: DataFrame) -> bool:
    """Whether all labels are 0 and 1 and no feature is marked as a category: else the fit is the library's own."""
    attributes = train.schema[estimator.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
    label = F.col(f"`{estimator.getLabelCol()}`").cast("double")
    return not attributes.keys() & {"nominal", "binary"} and train.where(~F.coalesce(label.isin(0.0, 1.0), F.lit(False))).isEmpty()


def fit_drawn_bags(estimator: RandomForestClassifier, train: DataFrame) -> StoredForest:
    """The estimator's forest, trees grown together: a row is in a bag as often as a Poisson draw with mean 1 says.

    The first trees of a larger forest are the smaller forest. Without bootstrap every bag is the table.
    """
    trees, subset, bootstrap = estimator.getNumTrees(), estimator.getFeatureSubsetStrategy(), estimator.getBootstrap()
    seeds = _tree_seeds(estimator, trees)
    if subset == "auto":
        subset = "all" if trees == 1 else "sqrt"

    def counts(number: int, rows: int) -> np.ndarray:
        if not bootstrap:
            return np.ones((trees, rows), np.int8)
        return np.stack([_poisson(own, number, rows) for own in seeds])

    return _grown(estimator, train, seeds, subset, counts, BAG_ROWS)


def search_forests(
    table: DataFrame, estimators: Sequence[RandomForestClassifier], jobs: Sequence[tuple], fold: str, label: str
) -> Iterator[tuple[int, list[float], float]] | None:
    """(job, F1 of what it asks for, seconds) of forests that haven't seen a fold, on the rows of that fold.

    A job is the places ``(limit, trees)`` that it asks for, its limits (least rows of a split, depth) and its fold. Every task
    has all rows, a byte a value and fold; it grows some trees of a job from bags that are drawn as in
    ``fit_drawn_bags``, cuts them at each limit, and adds up their votes. None where the rows are too many for that.
    """
    spark, start = table.sparkSession, time.perf_counter()
    members = [
        [_member(e, e.getFeatureSubsetStrategy(), seed, k) for seed in _tree_seeds(e, e.getNumTrees())]
        for e, (_, _, k) in zip(estimators, jobs, strict=True)
    ]
    with Growing(table, [own[0] for own in members], label, None, fold) as grown:
        folds, width = grown.folds, grown.width
        if grown.count * (len(folds) * width + 2) > TOGETHER_BYTES:
            return None
        parts = [pickle.loads(r["block"]) for r in sorted(grown.blocks.collect(), key=lambda r: r["number"])]
        label_, fold_, bins = (np.concatenate([part[k] for part in parts], axis=-1) for k in (0, 2, 3))
    rows = spark.sparkContext.broadcast((label_, fold_, bins))
    bootstrap = [e.getBootstrap() for e in estimators]
    tasks = []
    for i, (wanted, _, _) in enumerate(jobs):
        first = 0
        for last in sorted({n for _, n in wanted}):
            tasks += [(i, last, a, min(last, a + SEARCH_TREES)) for a in range(first, last, SEARCH_TREES)]
            first = last

    def votes(task: tuple[int, int, int, int]) -> tuple:
        i, last, a, b = task
        label_, fold_, bins = rows.value
        own, limits, k = members[i], jobs[i][1], jobs[i][2]
        seen, held = np.nonzero(fold_ != k)[0], np.nonzero(fold_ == k)[0]
        which = folds.index(k)
        train, test, target = np.take(bins[which], seen, axis=1), np.take(bins[which], held, axis=1), label_[seen]
        out = np.zeros((len(limits), len(held)))
        for member in own[a:b]:
            counts = _poisson(member.seed, 0, len(seen)) if bootstrap[i] else np.ones(len(seen), np.int8)
            drawn = np.nonzero(counts)[0]
            weight = counts[drawn].astype(np.float64)
            tree = _finish(np.take(train, drawn, axis=1), target[drawn], weight, member, 0, [member.seed & 0xFFFFFFFF, 0], True)
            _merge_leaves(tree)
            stats = np.array(tree.stats)
            arrays = Arrays(*tree.arrays(), stats[:, 0], stats[:, 2] / np.where(stats[:, 1] > 0, stats[:, 1], 1))
            leaf = arrays.reached(test)
            for place, limit in enumerate(limits):
                out[place] += arrays.share[np.maximum(arrays.stops(*limit), 0)][leaf] - 0.5
        return (i, last), (a, out)

    def added(parts: Iterator[tuple]) -> np.ndarray:
        return sum(out for _, out in sorted(parts, key=lambda part: part[0]))

    def f1(item: tuple) -> tuple[int, list[float]]:
        i, segments = item
        label_, fold_, _ = rows.value
        wanted, _, k = jobs[i]
        positive, total, found = label_[fold_ == k] == 1, 0.0, {}
        for last, out in sorted(segments, key=lambda part: part[0]):
            total = total + out
            for place, n in {w for w in wanted if w[1] == last}:
                chosen = total[place] > 0
                whole = int(chosen.sum() + positive.sum())
                found[place, n] = 2 * int((chosen & positive).sum()) / whole if whole else 0.0
        return i, [found[w] for w in wanted]

    cores = 4 * spark.sparkContext.defaultParallelism
    summed = spark.sparkContext.parallelize(tasks, len(tasks)).map(votes).groupByKey(min(len(tasks), cores)).mapValues(added)
    by_job = summed.map(lambda kv: (kv[0][0], (kv[0][1], kv[1]))).groupByKey(min(len(jobs), cores)).map(f1)
    found = by_job.collect()
    rows.destroy()
    seconds = time.perf_counter() - start
    return ((i, values, seconds) for i, values in sorted(found))


def _tree_seeds(estimator: RandomForestClassifier, trees: int) -> list[int]:
    seed = estimator.getSeed() & 0xFFFFFFFF
    return [int(np.random.default_rng([seed, tree]).integers(1 << 32)) for tree in range(trees)]


def _poisson(seed: int, number: int, rows: int) -> np.ndarray:
    """How often each row of a block is in the bag of a tree's seed."""
    return np.random.default_rng([seed, number]).poisson(1.0, rows).astype(np.int8)


def _member(estimator: RandomForestClassifier, subset: str, seed: int, without: int | None = None) -> Member:
    if subset == "auto":
        subset = "all" if estimator.getNumTrees() == 1 else "sqrt"
    gain = estimator.getMinInfoGain() / 2
    return Member(estimator.getMaxDepth(), 0.0, estimator.getMinInstancesPerNode(), gain, 1.0, subset, seed, without)


def _grown(
    estimator: RandomForestClassifier,
    train: DataFrame,
    seeds: Sequence[int],
    subset: str,
    counts: Column | Callable[[int, int], np.ndarray],
    block_rows: int | None = None,
) -> StoredForest:
    spark, bags, repeats = train.sparkSession, len(seeds), not isinstance(counts, Column)
    members = [_member(estimator, subset, seed) for seed in seeds]
    features = estimator.getFeaturesCol()
    with Growing(train, members, estimator.getLabelCol(), features=features, counts=counts, block_rows=block_rows) as grown:
        tops, late = [Tree() for _ in range(bags)], {bag: {} for bag in range(bags)}
        depth, most = 0, min(MEET_ROWS, MEET_VALUES // max(1, grown.width))
        if grown.count <= most:  # a bag has no more rows than the table
            late = {bag: {0: 0} for bag in range(bags)}
            for top in tops:
                top.open = []
        while opened := {bag: top for bag, top in enumerate(tops) if top.open and depth < members[bag].depth}:
            grown.level(opened, dict.fromkeys(opened, 0))
            depth += 1
            for bag, top in opened.items():
                small = [node for node in top.open if top.stats[node][0] <= most]
                late[bag].update(dict.fromkeys(small, depth))
                top.open = [node for node in top.open if top.stats[node][0] > most]
        arrays = [top.arrays() for top in tops]

        def pieces(block: Block) -> Iterator[tuple]:
            for bag, nodes in late.items():
                if not nodes:
                    continue
                rows = block.drawn(bag, members[bag], 0)
                own = block.reached(arrays[bag], 0, rows, members[bag].depth)
                order = np.argsort(own, kind="stable")
                sorted_own, sorted_rows = own[order], rows[order]
                for node in nodes:
                    a, b = np.searchsorted(sorted_own, [node, node + 1])
                    some = sorted_rows[a:b]
                    if len(some):
                        yield (bag, node), (block.number, block.bins[0][:, some], block.label[some], block.counts[bag, some])

        def grown_below(group: tuple) -> tuple:
            (bag, node), parts = group
            parts = sorted(parts, key=lambda part: part[0])
            bins, label, weight = (np.concatenate([part[k] for part in parts], axis=-1) for k in (1, 2, 3))
            seed = [members[bag].seed & 0xFFFFFFFF, node]
            sub = _finish(bins, label, weight.astype(np.float64), members[bag], late[bag][node], seed, repeats)
            return bag, (node, sub)

        tasks = min(4 * spark.sparkContext.defaultParallelism, 1 + grown.count * bags // TASK_ROWS)
        below = grown.state.flatMap(pieces).groupByKey(tasks).map(grown_below)
        all_bags = spark.sparkContext.parallelize([(bag, None) for bag in range(bags)], 1)
        trees = all_bags.union(below).groupByKey(min(bags, tasks)).map(
            lambda kv: (kv[0], bytearray(pickle.dumps(_joined(tops[kv[0]], sorted((x for x in kv[1] if x), key=lambda x: x[0])))))
        )
        bounds = grown.bounds[0]

        def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, tree in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield _saved(number, pickle.loads(tree), bounds)

        rows = spark.createDataFrame(trees, "treeID int, tree binary").mapInArrow(nodes, NODES)
        tiny = spark.createDataFrame(
            [(float(k), Vectors.dense([float(k)] * grown.width)) for k in (0, 1)],
            [estimator.getLabelCol(), estimator.getFeaturesCol()],
        )
        plain = estimator.copy({estimator.numTrees: 1})
        return stored_forest(spark, plain.fit(tiny.coalesce(1)), rows, bags)
