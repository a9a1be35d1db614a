"""Longest-processing-time sharding: whole groups, largest first, to the least-loaded shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.llm.ranks import ranked
from siftline.session import stored

#: Groups that one task places.
GROUPS_AT_ONCE = 1 << 17
#: A group with at least this share of the rows is joined by broadcast: there are no more such groups than its inverse.
OFTEN = 1 / 4096
#: Rows that one task numbers.
ROWS_AT_ONCE = 200_000


def longest_first(sizes: Iterable[tuple[object, int]], shards: int) -> dict[object, int]:
    """Shard of each ``(key, size)``: by falling size, ties by key, to the least load, ties to the lower shard."""
    ordered = sorted(sizes, key=lambda item: (-item[1], str(item[0])))
    placed = _least_loaded([0] * shards, [size for _, size in ordered], [1] * len(ordered))
    return dict(zip((key for key, _ in ordered), placed, strict=True))


def _least_loaded(loads: list[int], sizes: list[int], counts: list[int]) -> list[int]:
    """The shard that each group goes to, for runs of ``counts`` groups of the same size."""
    heap = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(heap)
    placed = []
    for size, count in zip(sizes, counts, strict=True):
        for _ in range(count):
            load, shard = heap[0]
            heapq.heapreplace(heap, (load + size, shard))
            placed.append(shard)
    return placed


def loads_after(loads: np.ndarray, size: int, count: int) -> np.ndarray:
    """Loads once ``count`` groups of one size have gone to the least load each, without going through the groups.

    A shard with load l takes its groups at the loads l, l + size, l + 2 * size and so on, and the heap
    gives out these loads in rising order, ties to the lower shard. So the ``count`` smallest are
    taken: all below a level that is found by halving, and of those on it the lowest shards'.
    """
    if not size or not count:
        return loads
    taken = lambda level: np.maximum((level - loads) // size + 1, 0)
    low, high = int(loads.min()) - 1, int(loads.min()) + size * count  # fewer than count up to low, enough up to high
    while high - low > 1:
        middle = (low + high) // 2
        if int(taken(middle).sum()) < count:
            low = middle
        else:
            high = middle
    number = taken(low)
    last = np.nonzero(taken(high) > number)[0][: count - int(number.sum())]
    number[last] += 1
    return loads + number * size


def blocks(sizes: np.ndarray, counts: np.ndarray, shards: int) -> Iterator[tuple[int, list[int], list[int], list[int]]]:
    """Cut the runs of equal sizes into blocks of GROUPS_AT_ONCE groups: ``(first rank, loads before it, sizes, counts)``."""
    loads, first, rank, runs = np.zeros(shards, np.int64), 0, 0, []
    before = loads.tolist()
    for size, count in zip(sizes.tolist(), counts.tolist(), strict=True):
        while count:
            some = min(count, first + GROUPS_AT_ONCE - rank)
            loads = loads_after(loads, size, some)
            runs.append((size, some))
            rank, count = rank + some, count - some
            if rank == first + GROUPS_AT_ONCE:
                yield first, before, [s for s, _ in runs], [n for _, n in runs]
                first, before, runs = rank, loads.tolist(), []
    if runs:
        yield first, before, [s for s, _ in runs], [n for _, n in runs]


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.to_pylist():
            found = _least_loaded(block["loads"], block["sizes"], block["counts"])
            ranks = np.arange(block["first"], block["first"] + len(found))
            yield pa.RecordBatch.from_arrays([pa.array(ranks), pa.array(found, pa.int32())], ["_rank", "shard"])


def shards_of_groups(groups: DataFrame, shards: int) -> DataFrame:
    """``groups`` (group string, size long, others) with ``shard``, as one heap over all of them would place them.

    Groups are ranked by falling size, ties by group. The driver gets the number of groups of each
    size, no group: of sizes that sum to s bytes no more than sqrt(2 * s) differ. From these
    it finds the loads before each block of ranks; tasks run the heap, a block each, and groups
    and shards meet by rank.
    """
    spark = groups.sparkSession
    runs = groups.groupBy("size").agg(F.count("*").alias("n")).toArrow()
    sizes, counts = runs["size"].to_numpy(), runs["n"].to_numpy()
    falling = np.argsort(-sizes, kind="stable")
    found = list(blocks(sizes[falling], counts[falling], shards))
    schema = "first long, loads array<long>, sizes array<long>, counts array<long>"
    waiting = spark.createDataFrame(found, schema).repartition(max(1, len(found)))
    schedule = stored(waiting.mapInArrow(_placed, "_rank long, shard int"), "schedule")
    return ranked(groups, F.col("size").desc(), F.col("group")).join(schedule, "_rank").drop("_rank", "_part")


def numbered(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Add ``slot``: 0, 1, 2 ... within each shard, without gaps.

    Each shard is cut into parts by a hash of the ordering columns; parts are numbered apart and
    start where the counts of the parts before them end.
    """
    count = rows.count()
    parts = max(1, -(-count // ROWS_AT_ONCE))
    cut = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = cut.groupBy(shard, "_part").count()
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(shard, "_part").orderBy(*order)) - 1
    return (
        cut.withColumn("_place", place)
        .join(starts, [shard, "_part"])
        .withColumn("slot", (F.col("_start") + F.col("_place")).cast("long"))
        .drop("_part", "_place", "_start")
    )


def shard_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40) -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard)`` for every row.

    The law is ``bytes``: shards get nearly equal sizes, a row's size being the UTF-8 bytes of its
    text plus 16. Rows with equal texts stay in one shard; if such a group is larger than a shard's
    equal share, its shard is larger by as much. A null text counts and groups as an empty one.
    Every row gets a slot of its own, rows that repeat another included. A shard may stay empty if
    there are fewer groups than shards. Other columns are not read. ``grown_shard`` is null, as
    this law moves rows between all shards when their number changes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(
        df.select(
            F.col(id_col).alias("id"),
            F.sha2(text, 256).alias("group"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ),
        "sized",
    )
    groups = stored(rows.groupBy("group").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "groups")
    placed = stored(shards_of_groups(groups, shards).select("group", "n", "shard"), "placed-groups")
    often = F.col("n") >= rows.count() * OFTEN
    frequent = F.broadcast(placed.where(often).select("group", "shard"))
    others = rows.join(frequent, "group", "left_anti").join(placed.where(~often).select("group", "shard"), "group")
    placed_rows = stored(rows.join(frequent, "group").unionByName(others), "placed-rows")
    slots = numbered(placed_rows.select("id", "group", "size", "text_crc32", "shard"), "shard", ["id", "group"])
    return slots.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
