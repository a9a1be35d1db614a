"""Near-duplicate texts by SimHash fingerprints and a binary trie self-join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.columns import renamed, sent
from siftline.llm.components import components, merge
from siftline.session import stored

#: Fingerprints that a unit of the join is planned for, and the most that one prefix may hold.
SUBTRIE, LARGEST = 16384, 65536
#: Node pairs with so few leaf pairs are compared leaf by leaf; pairs of nodes or leaves handled at once.
LEAF_PAIRS, AT_ONCE = 256, 1 << 20


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64 majority bits over the hashes of all shingles, as a signed number.

    A-Z is lower-cased, words are runs of other bytes than 20 and 09 to 0D. A text with fewer
    words than a shingle is one shingle; a null text or one without words gives zero. A bit is set
    if it is set in more than half of the hashes.
    """
    words = (text or "").encode().lower().split()  # of bytes: lowers and splits ASCII alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    digest, seed = xxhash.xxh64_intdigest, 42
    bounds = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], seed) for a, b in bounds], np.uint64)
    ones = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        some = hashes[first : first + (1 << 16)]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(texts: pd.Series, shingle: int) -> pd.Series:
    return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")


def trie_pairs(
    left: np.ndarray, right: np.ndarray, depth: int, errors: int, budget: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield index arrays of the pairs of two sorted arrays that differ in at most ``budget`` bits.

    A sorted array is a binary trie: a node is the interval of the values that share a prefix.
    ``left`` and ``right`` are the leaves of two nodes at ``depth`` whose prefixes differ in
    ``errors`` bits. Node pairs go down together, one bit at a time; a pair whose prefixes differ
    in more bits than the budget goes no further. If both arrays are the same object, a pair comes
    once, in any order of its two places.
    """
    same = left is right
    start = np.array([[0, len(left), 0, len(right), errors]], np.int64)
    waiting = [(depth, start)] if len(left) and len(right) and errors <= budget else []
    while waiting:
        depth, pairs = waiting.pop()
        leaves = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        few = (leaves <= LEAF_PAIRS) | (depth == 64)
        yield from _leaf_pairs(left, right, pairs[few], leaves[few], budget, same)
        pairs = pairs[~few]
        if not len(pairs):
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        halves = []
        for values, at in ((left, 0), (right, 2)):
            prefix = values[pairs[:, at]] & ~(bit | (bit - np.uint64(1)))
            middle = np.searchsorted(values, prefix | bit).clip(pairs[:, at], pairs[:, at + 1])
            halves.append(((pairs[:, at], middle), (middle, pairs[:, at + 1])))
        children = []
        for x in (0, 1):
            for y in (0, 1):
                (a, b), (c, d) = halves[0][x], halves[1][y]
                error = pairs[:, 4] + (x != y)
                go = (a < b) & (c < d) & (error <= budget)
                if same and x > y:  # the mirror image of a pair of halves of one node
                    go &= (pairs[:, 0] != pairs[:, 2]) | (pairs[:, 1] != pairs[:, 3])
                children.append(np.stack([a, b, c, d, error], axis=1)[go])
        found = np.concatenate(children)
        waiting += [(depth + 1, found[k : k + AT_ONCE]) for k in range(0, len(found), AT_ONCE)]


def _leaf_pairs(left, right, pairs, leaves, budget, same) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    upto = np.cumsum(leaves)
    first = 0
    while first < len(pairs):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + AT_ONCE, "right")))
        size = leaves[first:last]
        owner = np.repeat(np.arange(first, last), size)
        local = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        across = pairs[owner, 3] - pairs[owner, 2]
        i, j = pairs[owner, 0] + local // across, pairs[owner, 2] + local % across
        near = np.bitwise_count(left[i] ^ right[j]) <= budget
        if same:  # of two different nodes the left one comes first
            near &= i < j
        yield i[near], j[near]
        first = last


def _unit(bits: int, budget: int) -> Callable:
    """The join of two subtries: a star of links for each set of fingerprints that they join."""

    def unit(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        first, second = (k.as_py() for k in key)
        values = np.sort(rows["fp"].to_numpy().view(np.uint64))
        if first == second:
            left = right = values
        else:
            prefix = (values >> np.uint64(64 - bits)).astype(np.int64)
            left, right = values[prefix == first], values[prefix == second]
        base = 0 if first == second else len(left)
        nodes = left if first == second else np.concatenate([left, right])
        labels = np.arange(len(nodes))
        for i, j in trie_pairs(left, right, bits, (first ^ second).bit_count(), budget):
            merge(labels, i, j + base)
        joined = np.nonzero(labels != np.arange(len(nodes)))[0]
        signed = nodes.view(np.int64)
        return pa.table({"a": signed[joined], "b": signed[labels[joined]]})

    return unit


def _prefix_bits(distinct: DataFrame) -> int:
    """Bits of the prefix by which the trie is cut, so that no subtrie has too many leaves."""
    count = distinct.count()
    bits = min(24, max(0, -(-count // SUBTRIE) - 1).bit_length())
    while bits < 24:
        prefix = F.shiftrightunsigned("fp", 64 - bits) if bits else F.lit(0)
        largest = distinct.groupBy(prefix.alias("prefix")).count().agg(F.max("count")).first()[0] or 0
        if largest <= LARGEST:
            break
        bits += 2
    return bits


def fingerprint_links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """``(a, b)``: links that join the fingerprints ``fp`` of ``distinct`` as all pairs within ``max_bits`` would.

    The trie is cut at a prefix; a unit of work is a pair of prefixes that differ in at most
    ``max_bits`` bits, and a fingerprint is sent to the units of its prefix.
    """
    bits = _prefix_bits(distinct)
    masks = [0]
    for _ in range(max_bits):
        masks = sorted({m ^ bit for m in masks for bit in (0, *(1 << k for k in range(bits)))})
    prefix = F.shiftrightunsigned("fp", 64 - bits) if bits else F.lit(0).cast("long")
    units = (
        distinct.select("fp", prefix.alias("prefix"))
        .withColumn("other", F.explode(F.array(*[F.col("prefix").bitwiseXOR(F.lit(m)) for m in masks])))
        .select(F.least("prefix", "other").alias("first"), F.greatest("prefix", "other").alias("second"), "fp")
    )
    return units.groupBy("first", "second").applyInArrow(_unit(bits, max_bits), "a long, b long")


def _classes(df: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    """``(id, text_hash, fp, root, component_id)`` for every row; ``root`` names the component."""
    text = F.pandas_udf(lambda texts: fingerprints(texts, shingle), "long")
    rows = stored(
        df.select(
            F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), text(F.col(text_col)).alias("fp")
        ),
        "fingerprints",
    )
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("low_id")), "distinct-fingerprints")
    roots = components(fingerprint_links(distinct, max_bits))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    lowest = classes.groupBy("root").agg(F.min("low_id").alias("component_id"))
    return rows.join(classes.join(lowest, "root").select("fp", "root", "component_id"), "fp")


def near_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2
) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row.

    ``fingerprint`` has 16 lower-case hex digits. Fingerprints that differ in at most ``max_bits``
    bits link; ``component_id`` is the smallest id reachable over links. Equal fingerprints are
    one leaf, so a group of copies of any size costs one. Null and empty texts have fingerprint
    zero and link like any other. A null id takes part, but isn't a smallest id unless all are
    null. Other columns are not read.
    """
    return _classes(df, id_col, text_col, shingle, max_bits).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def one_of_each(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2
) -> DataFrame:
    """One row of ``df`` of each group of near copies, with all its columns: that with the smallest id.

    Rows that share id and text are one document. Between rows that share only the id, a hash of
    the text decides; null ids come last.
    """
    rows, (id_at, text_at) = renamed(df, id_col, text_col)
    classes = _classes(rows, id_at, text_at, shingle, max_bits)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("first")
    kept = stored(classes.groupBy("root").agg(first).select("first.id", "first.text_hash"), "first-of-each")
    same = F.col(id_at).eqNullSafe(F.col("id")) & (F.xxhash64(text_at) == F.col("text_hash"))
    chosen = rows.join(sent(kept), same, "left_semi")
    repeated = classes.groupBy("id", "text_hash").count().where("count > 1")
    if not repeated.isEmpty():
        chosen = chosen.withColumn("_hash", F.xxhash64(text_at)).dropDuplicates([id_at, "_hash"]).drop("_hash")
    return chosen.toDF(*df.columns)
