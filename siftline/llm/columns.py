"""Columns under names that can't clash with an operator's own, and counted tables for joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, of some tens of bytes each, up to which one side of a join goes to every executor.
MOST_SENT = 500_000


def renamed(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with columns c0, c1 and so on, and what ``names`` are called there."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))), [f"c{df.columns.index(name)}" for name in names]


def sent(df: DataFrame, array: str | None = None, most: int = MOST_SENT) -> DataFrame:
    """A stored table, to be sent to every executor if it has no more than ``most`` rows; else both sides are shuffled.

    Where it has a column of arrays, ``array``, their elements count as rows.
    """
    held = F.lit(1) if array is None else F.lit(1) + F.greatest(F.size(array), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(held)).first()[0] or 0) <= most else df
