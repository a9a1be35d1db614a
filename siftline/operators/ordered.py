"""Exact cuts of each class in the order of any key, without a window over a class.

A sample of the keys, chosen by their hash, proposes an interval for every wanted rank; one aggregate
counts the rows of the class below and inside; only rows inside are sampled again or, once they
are few, sorted. The counts prove each interval, so the cuts are exact whatever the sample.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.naming import col

#: Keys that a sample has on average, which the driver sorts.
SAMPLE = 20_000
#: Rows of an interval that are sorted.
RANKED_ROWS = 200_000


@dataclass
class _Cut:
    """A zero-based rank in a class, and the keys between which the row of that rank is known to lie."""

    label: int
    rank: int
    inside: int
    low: tuple | None = None
    high: tuple | None = None
    below: int = 0
    margin: float = 0.02
    settled: bool = False


class Cuts:
    """Cuts of the rows of ``df`` by class, in the order of the ``key`` columns, NULL first."""

    def __init__(self, df: DataFrame, label: str, key: Sequence[str], counts: Mapping[int, int]):
        self.types = [df.schema[name].dataType for name in key]
        self.names = [f"k{i}" for i in range(len(key))]
        self.key, self.counts = tuple(key), counts
        keys = [col(name).alias(own) for name, own in zip(key, self.names, strict=True)]
        self.rows = df.select(col(label).cast("int").alias("label"), *keys)

    def _place(self) -> Column:
        return F.struct(*self.names)

    def _literal(self, values: tuple) -> Column:
        cells = [F.lit(v).cast(t).alias(n) for v, t, n in zip(values, self.types, self.names, strict=True)]
        return F.struct(*cells)

    def _within(self, cut: _Cut) -> Column:
        inside = F.col("label") == cut.label
        if cut.low is not None:
            inside &= self._place() >= self._literal(cut.low)
        if cut.high is not None:
            inside &= self._place() <= self._literal(cut.high)
        return inside

    def at(self, ranks: Mapping[int, Sequence[int]]) -> dict[int, list[tuple | None]]:
        """Per class and rank, the key below which lie exactly ``rank`` rows; None where all rows do."""
        cuts = {
            (c, rank): _Cut(c, rank, self.counts[c])
            for c, wanted in ranks.items()
            for rank in wanted
            if rank < self.counts[c]
        }
        while wide := [c for c in cuts.values() if c.inside > RANKED_ROWS and not c.settled]:
            self._narrow(wide)
        found = self._sorted(list(cuts.values())) if cuts else {}
        return {c: [found.get((c, rank)) for rank in wanted] for c, wanted in ranks.items()}

    def _narrow(self, cuts: list[_Cut]) -> None:
        proposals = [_Cut(c.label, c.rank, c.inside, low, high) for c, (low, high) in zip(cuts, self._proposed(cuts))]
        counts = []
        for i, new in enumerate(proposals):
            below = F.lit(False) if new.low is None else self._place() < self._literal(new.low)
            counts.append(F.count_if((F.col("label") == new.label) & below).alias(f"below:{i}"))
            counts.append(F.count_if(self._within(new)).alias(f"in:{i}"))
        row = self.rows.agg(*counts).first()
        for i, (cut, new) in enumerate(zip(cuts, proposals, strict=True)):
            below, inside = row[f"below:{i}"], row[f"in:{i}"]
            if below <= cut.rank < below + inside:
                cut.settled = inside >= cut.inside
                cut.low, cut.high, cut.below, cut.inside = new.low, new.high, below, inside
            else:
                cut.settled, cut.margin = cut.margin >= 1, min(1.0, 4 * cut.margin)

    def _proposed(self, cuts: list[_Cut]) -> list[tuple[tuple | None, tuple | None]]:
        """For each cut the sampled keys some way below and above where its rank should lie."""
        total = sum(cut.inside for cut in cuts)
        every = max(1, total // SAMPLE)
        anywhere = reduce(lambda a, b: a | b, [self._within(cut) for cut in cuts])
        chosen = F.pmod(F.xxhash64(*self.names), F.lit(every)) == 0
        sample: dict[int, list[tuple]] = {}
        for r in self.rows.where(anywhere & chosen).distinct().collect():
            sample.setdefault(r["label"], []).append(tuple(r)[1:])
        out = []
        for cut in cuts:
            keys = sorted(sample.get(cut.label, []), key=_nulls_first)
            low = 0 if cut.low is None else _first_at(keys, cut.low)
            high = len(keys) if cut.high is None else _first_at(keys, cut.high)
            here = keys[low:high]
            share, spread = (cut.rank - cut.below) / cut.inside, cut.margin * len(here)
            a, b = int(share * len(here) - spread) - 1, int(share * len(here) + spread) + 1
            out.append((here[a] if a >= 0 else cut.low, here[b] if b < len(here) else cut.high))
        return out

    def _sorted(self, cuts: list[_Cut]) -> dict[tuple[int, int], tuple]:
        """The key at each rank, from the rows of the intervals."""
        hits = [F.when(self._within(cut), F.lit(i)) for i, cut in enumerate(cuts)]
        inside = self.rows.select(F.explode(F.array_compact(F.array(*hits))).alias("cut"), *self.names)
        counted = inside.groupBy("cut", *self.names).agg(F.count("*").alias("rows"))
        order = Window.partitionBy("cut").orderBy(*(F.col(n).asc_nulls_first() for n in self.names))
        offset = F.element_at(F.array(*(F.lit(cut.rank - cut.below) for cut in cuts)), F.col("cut") + 1)
        start = F.sum("rows").over(order) - F.col("rows")
        picked = counted.withColumn("start", start).where((F.col("start") <= offset) & (offset < F.col("start") + F.col("rows")))
        found = {}
        for r in picked.collect():
            cut = cuts[r["cut"]]
            if r["start"] < cut.rank - cut.below:
                raise ValueError(
                    f"{r['rows']} rows share one key where the table is cut; {', '.join(self.key)} must identify a row"
                )
            found[cut.label, cut.rank] = tuple(r[n] for n in self.names)
        return found

    def assigned(self, df: DataFrame, label: str, name: str, cuts: Mapping[int, Sequence[tuple | None]]) -> DataFrame:
        """``name``: how many of its class's cuts, which rise, a row's key has reached."""
        cells = [col(k).alias(n) for k, n in zip(self.key, self.names, strict=True)]
        choice = F.lit(None).cast("int")
        for c, limits in cuts.items():
            reached = F.lit(0)
            for i, limit in enumerate(limits, start=1):
                if limit is not None:
                    reached = F.when(F.struct(*cells) >= self._literal(limit), F.lit(i)).otherwise(reached)
            choice = F.when(col(label) == c, reached).otherwise(choice)
        return df.withColumn(name, choice)


def _nulls_first(values: tuple) -> tuple:
    return tuple((v is not None, v) if v is not None else (False,) for v in values)


def _first_at(keys: list[tuple], value: tuple) -> int:
    """How many of the sorted keys come before ``value``."""
    wanted, low, high = _nulls_first(value), 0, len(keys)
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if _nulls_first(keys[middle]) < wanted else (low, middle)
    return low
