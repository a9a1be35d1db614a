"""Exact quantiles without collecting the values of a column.

A mergeable sketch gives an interval that should hold each wanted rank, one aggregate counts the
rows below and inside the interval, and only the rows inside are grouped and ranked. The counts
prove that the interval holds the rank; where they do not, the wider interval stays. So the
result is exact whatever the sketch's error, and no task holds a whole column.

Sketches are merged in two steps, first per group of input partitions, so that the number of
input partitions does not pile up in one task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from siftline.session import stored

SKETCH_SIZE = 8192
MERGE_GROUPS = 256
# Columns with fewer values are ranked whole; intervals with more rows are narrowed again.
RANKED_WHOLE = 10_000
RANKED_ROWS = 5_000_000


def rank_error() -> float:
    """Share of the rows that a rank from the sketch may be off by, twice its usual error."""
    return min(1.0, 2 * 2.296 / SKETCH_SIZE**0.9021)


def sketch_quantiles(
    df: DataFrame, wanted: Mapping[str, tuple[Column, Sequence[float]]]
) -> dict[str, tuple[int, list[float]]]:
    """(values, approximate quantiles) per name, from one pass."""
    parts = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("part")).agg(
        *[F.kll_sketch_agg_double(v, F.lit(SKETCH_SIZE)).alias(f"sketch:{n}") for n, (v, _) in wanted.items()],
        *[F.count(v).alias(f"size:{n}") for n, (v, _) in wanted.items()],
    )
    merged = parts.agg(
        *[F.kll_merge_agg_double(F.col(f"`sketch:{n}`")).alias(f"sketch:{n}") for n in wanted],
        *[F.sum(F.col(f"`size:{n}`")).alias(f"size:{n}") for n in wanted],
    )
    found = []
    for n, (_, probabilities) in wanted.items():
        points = F.expr(f"array({', '.join(f'{float(p)!r}D' for p in probabilities)})")
        values = F.kll_sketch_get_quantile_double(F.col(f"`sketch:{n}`"), points)
        found += [F.col(f"`size:{n}`"), F.when(F.col(f"`size:{n}`") > 0, values).alias(f"values:{n}")]
    row = merged.select(*found).first()
    return {n: (row[f"size:{n}"] or 0, row[f"values:{n}"] or []) for n in wanted}


@dataclass
class _Target:
    """One wanted quantile: zero-based ranks and the interval known to hold them."""

    name: str
    value: Column
    probability: float
    size: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    inside: int = 0
    margin: float = 0.0
    settled: bool = False

    @property
    def position(self) -> float:
        return self.probability * (self.size - 1)

    @property
    def ranks(self) -> tuple[int, int]:
        return math.floor(self.position), math.ceil(self.position)

    @property
    def single(self) -> bool:
        return self.low is not None and self.low == self.high

    def contains(self) -> Column:
        if self.low is None:
            return self.value.isNotNull()
        return self.value.between(self.low, self.high)

    def around(self) -> tuple[float, float]:
        """Where the wanted ranks lie among the rows inside, with the margin on both sides."""
        first, last = self.ranks
        start = (first - self.below) / self.inside - self.margin
        stop = (last + 1 - self.below) / self.inside + self.margin
        return max(0.0, start), min(1.0, stop)

    def narrow(self, low: float, high: float, below: int, inside: int) -> None:
        """Take the proposed interval if the counts show that it holds the wanted ranks."""
        first, last = self.ranks
        if below <= first and last < below + inside:
            self.settled = inside >= self.inside
            self.low, self.high, self.below, self.inside = low, high, below, inside
        else:
            self.settled = self.margin >= 1.0
            self.margin = max(8 * self.margin, 0.001)


def exact_quantiles(
    df: DataFrame,
    columns: Mapping[str, Column],
    probabilities: Sequence[float],
    along: Sequence[Column] = (),
) -> tuple[dict[str, list[float | None]], Row | None]:
    """Quantiles by linear interpolation, and the row of the aggregates ``along``.

    ``columns`` maps a result name to a double expression. NULLs are skipped; a column without
    values gives None. The extra aggregates ride on a pass that is made anyway.
    """
    margin = rank_error()
    edges = [e for p in probabilities for e in (max(0.0, p - margin), min(1.0, p + margin))]
    sketched = sketch_quantiles(df, {n: (v, edges) for n, v in columns.items()})

    targets: dict[tuple[str, int], _Target] = {}
    proposals: list[tuple[_Target, float, float]] = []
    for name, value in columns.items():
        size, limits = sketched[name]
        for i, p in enumerate(probabilities if size else ()):
            target = _Target(name, value, p, size, inside=size, margin=margin)
            targets[name, i] = target
            if size > RANKED_WHOLE:
                proposals.append((target, limits[2 * i], limits[2 * i + 1]))

    row = _check(df, proposals, along)
    if any(t.inside > RANKED_ROWS and not t.single for t in targets.values()):
        # From here on only the rows inside are read, a few thousandths of the table.
        df = _inside_rows(df, list(targets.values()))
    while wide := [t for t in targets.values() if t.inside > RANKED_ROWS and not (t.settled or t.single)]:
        _check(df, _narrower(df, wide), (), inside=True)
    found = _ranked(df, targets)
    quantiles = {n: [found.get((n, i)) for i in range(len(probabilities))] for n in columns}
    return quantiles, row


def _inside_rows(df: DataFrame, targets: list[_Target]) -> DataFrame:
    """Write the values that lie in an interval of their column, and let the targets read them there."""
    kept: dict[str, Column] = {}
    names = list(dict.fromkeys(t.name for t in targets))
    for i, name in enumerate(names):
        own = [t for t in targets if t.name == name and not t.single]
        if own:
            anywhere = reduce(lambda a, b: a | b, [t.contains() for t in own])
            kept[f"v{i}"] = F.when(anywhere, own[0].value)
    rows = df.select(*(value.alias(name) for name, value in kept.items()))
    found = stored(rows.where(F.coalesce(*map(F.col, kept)).isNotNull()), "inside")
    for t in targets:
        t.value = F.col(f"v{names.index(t.name)}") if f"v{names.index(t.name)}" in kept else F.lit(t.low)
    return found


def _narrower(df: DataFrame, wide: list[_Target]) -> list[tuple[_Target, float, float]]:
    """Sketch the rows inside each interval again."""
    inside = df.where(reduce(lambda a, b: a | b, [t.contains() for t in wide]))
    wanted = {str(i): (F.when(t.contains(), t.value), t.around()) for i, t in enumerate(wide)}
    found = sketch_quantiles(inside, wanted)
    return [(t, *found[str(i)][1]) for i, t in enumerate(wide)]


def _check(
    df: DataFrame, proposals: list[tuple[_Target, float, float]], along: Sequence[Column], inside: bool = False
) -> Row | None:
    """Count the rows below and inside each proposed interval.

    ``inside``: the table holds only rows of the intervals so far, whose own counts are known.
    """
    counts = list(along)
    for i, (target, low, high) in enumerate(proposals):
        below = target.value < low
        counts.append(F.count_if(below & target.contains() if inside else below).alias(f"below:{i}"))
        counts.append(F.count_if(target.value.between(low, high)).alias(f"inside:{i}"))
    if not counts:
        return None
    row = df.agg(*counts).first()
    for i, (target, low, high) in enumerate(proposals):
        known = target.below if inside else 0
        target.narrow(low, high, known + row[f"below:{i}"], row[f"inside:{i}"])
    return row


def _ranked(df: DataFrame, targets: Mapping[tuple[str, int], _Target]) -> dict[tuple[str, int], float]:
    """Pick the wanted ranks among the rows inside the intervals."""
    found = {key: float(t.low) for key, t in targets.items() if t.single}
    pending = [(key, t) for key, t in targets.items() if not t.single]
    if not pending:
        return found
    hits = [
        F.when(t.contains(), F.struct(F.lit(i).alias("target"), t.value.alias("value")))
        for i, (_, t) in enumerate(pending)
    ]
    anywhere = reduce(lambda a, b: a | b, [t.contains() for _, t in pending])
    values = (
        df.where(anywhere)
        .select(F.inline(F.array(*hits)))
        .where(F.col("target").isNotNull())
        .groupBy("target", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    # At most RANKED_ROWS rows per target, which the counts have shown.
    by_value = Window.partitionBy("target").orderBy("value")
    firsts = F.array(*[F.lit(t.ranks[0] - t.below) for _, t in pending])
    lasts = F.array(*[F.lit(t.ranks[1] - t.below) for _, t in pending])
    first, last = (F.element_at(ranks, F.col("target") + 1) for ranks in (firsts, lasts))
    picked = (
        values.withColumn("stop", F.sum("rows").over(by_value))
        .withColumn("start", F.col("stop") - F.col("rows"))
        .where((F.col("stop") > first) & (F.col("start") <= last))
        .groupBy("target")
        .agg(F.min("value").alias("low"), F.max("value").alias("high"))
    )
    for row in picked.collect():
        key, target = pending[row["target"]]
        fraction = target.position - target.ranks[0]
        found[key] = row["low"] + (row["high"] - row["low"]) * fraction
    return found


def balanced_edges(df: DataFrame, value: Column, at_least: int, rows_per_bucket: int = 1_000_000) -> list[float]:
    """Increasing edges that cut the rows into buckets of about equal size."""
    most = 4096
    size, points = sketch_quantiles(df, {"value": (value, [i / most for i in range(1, most)])})["value"]
    parts = min(most, max(2, at_least, size // rows_per_bucket))
    step = most / parts
    return sorted({points[round(i * step) - 1] for i in range(1, parts)}) if points else []
