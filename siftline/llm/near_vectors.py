"""Near-duplicate vectors by int8 tile products with error bounds, then full precision where it may matter."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.components import components, merge
from siftline.session import stored

#: Vectors of a tile at most; a task holds two tiles and one block of their products. Few vectors are
#: still cut into a few tiles, of SMALL_TILE or more, so that several tasks share them.
TILE, SMALL_TILE, FEW_TILES = 8192, 1024, 6
#: Rows of a block of products, and pairs that are compared in full precision at once.
BLOCK, PAIRS = 512, 1 << 18


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8 codes, their scales, and the exact length of what the codes leave out."""
    units = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    units /= np.sqrt(np.einsum("ij,ij->i", units, units))[:, None]
    scales = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / scales[:, None]).astype(np.int8)
    rest = units - codes * scales[:, None]
    return codes, scales, np.sqrt(np.einsum("ij,ij->i", rest, rest)) + 1e-12


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; each row is divided by its largest part first, against overflow."""
    left = left / np.abs(left).max(axis=1, keepdims=True)
    right = right / np.abs(right).max(axis=1, keepdims=True)
    dot = np.einsum("ij,ij->i", left, right)
    return dot / np.sqrt(np.einsum("ij,ij->i", left, left) * np.einsum("ij,ij->i", right, right))


def linked_pairs(left: np.ndarray, right: np.ndarray, threshold: float):
    """Yield index arrays of the pairs with cosine >= threshold, block by block.

    For unit vectors u = s*p + d and v = t*q + e with int8 codes p, q, |u.v - s*t*p.q| is at most
    (1+|d|)*|e| + |d|. The products of codes are sums of integers below 2**24 for up to 1,040
    dimensions, so a float32 product gives them exactly; longer vectors use float64.
    """
    exact = np.float32 if left.shape[1] * 127 * 127 < 1 << 24 else np.float64
    (p, s, d), (q, t, e) = quantised(left), quantised(right)
    p, q, t_exact = p.astype(exact), np.ascontiguousarray(q.astype(exact).T), t.astype(exact)
    # The largest slack of a column, and a margin above the rounding of this one comparison.
    least = ((threshold - (1 + d) * e.max(initial=0) - d - 1e-4) / s).astype(exact)
    for first in range(0, len(p), BLOCK):
        product = p[first : first + BLOCK] @ q
        i, j = np.nonzero(product * t_exact >= least[first : first + BLOCK, None])
        near = s[first + i] * t[j] * product[i, j].astype(np.float64)
        i += first
        slack = (1 + d[i]) * e[j] + d[i]
        sure = near - slack >= threshold + 1e-9
        open_pairs = np.nonzero(~sure & (near + slack >= threshold - 1e-9))[0]
        for k in range(0, len(open_pairs), PAIRS):
            some = open_pairs[k : k + PAIRS]
            sure[some] = cosines(left[i[some]], right[j[some]]) >= threshold
        yield i[sure], j[sure]


def _unit(threshold: float) -> Callable:
    """Links between two tiles: counts by vector, and a star for each set of vectors that they join."""

    def unit(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        dim, first, second = (k.as_py() for k in key)
        tile, node, copies = (rows[name].to_numpy() for name in ("tile", "node", "copies"))
        flat = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = flat.astype(np.float64).reshape(len(node), dim)
        a, b = np.nonzero(tile == first)[0], np.nonzero(tile == second)[0]
        counts, labels = np.zeros(len(node)), np.arange(len(node))
        if len(a) and len(b):
            for i, j in linked_pairs(vectors[a], vectors[b], threshold):
                i, j = a[i], b[j]
                if first == second:
                    i, j = i[i < j], j[i < j]
                counts += np.bincount(i, weights=copies[j], minlength=len(node))
                counts += np.bincount(j, weights=copies[i], minlength=len(node))
                merge(labels, i, j)
        some, joined = np.nonzero(counts)[0], np.nonzero(labels != np.arange(len(node)))[0]
        return pa.table(
            {
                "a": pa.array(np.concatenate([node[some], node[joined]]), pa.int64()),
                "b": pa.array(
                    np.concatenate([np.full(len(some), -1), node[labels[joined]]]).astype(np.int64), pa.int64()
                ),
                "n": pa.array(np.concatenate([counts[some], np.zeros(len(joined))]).astype(np.int64), pa.int64()),
            }
        )

    return unit


def _usable(vector: str) -> Column:
    """Whether a vector has a direction: not null or empty, finite throughout, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(F.col(vector).isNotNull() & ~bad & some, F.lit(False))


def near_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row: its links with cosine >= threshold and their component.

    Equal vectors are compared once and counted as often as they stand there. The distinct ones
    are dealt to tiles by a hash, and each unordered pair of tiles is one unit of work, whose
    result is at most a count and a link for each of its vectors, however many pairs it finds.
    Every pair is compared: for T tiles a vector is sent to T units, so tiles are large. Vectors
    of different lengths don't link.

    Null, zero and non-finite vectors link with nothing and are their own component. Rows that
    repeat an id and a vector are copies like any other. A null id takes part; the component's id
    is the smallest id that isn't null. Other columns are not read.
    """
    zero = F.lit(0).cast(df.schema[vector_col].dataType.elementType)
    rows = df.select(
        F.col(id_col).alias("id"),
        # -0.0 and 0.0 are equal.
        F.when(_usable(vector_col), F.transform(vector_col, lambda x: F.when(x == 0, zero).otherwise(x))).alias(
            "vector"
        ),
    )
    distinct = stored(
        rows.where("vector IS NOT NULL")
        .groupBy("vector")
        .agg(F.min("id").alias("low_id"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    count = distinct.count()
    tiles = max(1, -(-count // TILE), min(FEW_TILES, count // SMALL_TILE))
    dealt = distinct.select(
        F.size("vector").alias("dim"),
        F.pmod(F.xxhash64("node"), F.lit(tiles)).cast("int").alias("tile"),
        "node",
        "copies",
        "vector",
    )
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    units = dealt.withColumn("other", other).select(
        "dim", F.least("tile", "other").alias("first"), F.greatest("tile", "other").alias("second"), "tile", "node",
        "copies", "vector",
    )
    found = stored(
        units.repartition(max(1, tiles * (tiles + 1) // 2), "dim", "first", "second")
        .groupBy("dim", "first", "second")
        .applyInArrow(_unit(threshold), "a long, b long, n long"),
        "vector-links",
    )
    counts = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found.where("n = 0").select("a", "b"))
    classes = (
        distinct.select("node", "low_id", "copies", "vector")
        .join(counts, "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    lowest = classes.groupBy("root").agg(F.min("low_id").alias("component_id"))
    classes = classes.join(lowest, "root").select(
        "vector", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return rows.join(classes, "vector", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vector").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("vector").isNull(), True)
        .otherwise(F.col("id").eqNullSafe(F.col("component_id")))
        .alias("kept"),
    )
