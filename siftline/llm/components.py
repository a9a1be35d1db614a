"""Connected components: inside one task with numpy, over the whole table with Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.session import drop_stored, stored


def merge(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Join the sets of ``left[i]`` and ``right[i]``; ``labels`` holds each place's smallest member so far."""
    while len(left):
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            return
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(labels, shorter := labels[labels]):
            labels[:] = shorter


def _low(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _low(both).withColumn("low", F.least("a", "low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them. In every row a > b."""
    low = _low(edges)
    return (
        edges.join(low, "a")
        .where("b <> low")
        .select(F.col("b").alias("a"), F.col("low").alias("b"))
        .unionByName(low.select("a", F.col("low").alias("b")))
        .distinct()
    )


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row.n, row.x


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (a long, b long), root being the smallest node of its component.

    Alternating stars: each round keeps at most as many rows as there are edges, and a node with
    very many neighbours is a partial minimum before it is shuffled. Every round is written to the
    shared folder, so a lost executor costs one round at most. Loops and repeated edges are
    ignored; nodes without a link don't appear.
    """
    links = edges.where("a <> b").select(
        F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")
    )
    links = stored(links.distinct(), "links")
    before = None
    while (now := _signature(links)) != before and now[0]:
        before, old = now, links
        links = stored(_small_star(_large_star(old)), "links")
        drop_stored(old)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
