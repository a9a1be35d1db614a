"""Places in the order of a whole table, without a window over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.session import stored

#: Rows that one task sorts.
SORTED_ROWS = 500_000
#: ``monotonically_increasing_id`` has the partition above these bits and the row in it below.
_PLACE_BITS = 33


def ranked(df: DataFrame, *order: Column, per_part: int = SORTED_ROWS) -> DataFrame:
    """``df`` with ``_part``, the sorted part a row lies in, and ``_rank``, its place from 0 in ``order``.

    Parts are ranges of the ordering, so that no key and no group has to fit into one task. They
    are written with each row's place in its part; a part starts where the counts of those before
    it end. Rows that tie in every expression of ``order`` get different places.
    """
    parts = max(1, -(-df.count() // per_part))
    sorted_parts = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = stored(sorted_parts.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    rows = rows.withColumn("_part", F.shiftright("_at", _PLACE_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each sorted part
    starts = rows.groupBy("_part").agg(F.count("*").alias("n"))
    starts = starts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return rows.join(F.broadcast(starts), "_part").withColumn("_rank", F.col("_start") + place).drop("_at", "_start")
