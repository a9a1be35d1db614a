"""Exact, reproducible, stratified splits and folds as a projection.

Rows are ordered by a hash of their key. A split is the hash value at a rank inside a class, so
once those few values are known a row finds its split from its own key and label: no window
over a class, no join, no shuffle of the table.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.hashing import key_hash
from siftline.functions.naming import col
from siftline.operators.ordered import Cuts

DIGITS = 3
RANKED_ROWS = 200_000


@dataclass
class _Cut:
    """The row of a class at a zero-based rank, and the hash prefix known to hold it."""

    label: int
    rank: int
    prefix: str = ""
    before: int = 0
    rows: int = 0
    hot: bool = False

    @property
    def group(self) -> str:
        return f"{self.label}{self.prefix}"


def class_quotas(counts: Mapping[int, int], rows: int) -> dict[int, int]:
    """Share ``rows`` among the classes by largest remainder; equal remainders: first class first."""
    total = max(1, sum(counts.values()))
    exact = {c: counts[c] * rows / total for c in sorted(counts)}
    quotas = {c: math.floor(share) for c, share in exact.items()}
    by_remainder = sorted(exact, key=lambda c: (quotas[c] - exact[c], c))
    for c in by_remainder[: rows - sum(quotas.values())]:
        quotas[c] += 1
    return quotas


def split_sizes(
    counts: Mapping[int, int], test_size: float, val_size: float
) -> dict[int, tuple[int, int]]:
    """(test rows, validation rows) per class; ``val_size`` is a share of what test leaves."""
    total = sum(counts.values())
    rest = class_quotas(counts, total - math.ceil(test_size * total))
    rest_total = sum(rest.values())
    train = class_quotas(rest, rest_total - math.ceil(val_size * rest_total))
    return {c: (counts[c] - rest[c], rest[c] - train[c]) for c in counts}


def fold_sizes(counts: Mapping[int, int], folds: int) -> dict[int, list[int]]:
    """Rows per fold and class when the class-sorted rows are dealt out in turn."""
    sizes, start = {}, 0
    for c in sorted(counts):
        stop = start + counts[c]
        sizes[c] = [-((i - stop) // folds) + ((i - start) // folds) for i in range(folds)]
        start = stop
    return sizes


class KeyOrder:
    """Rows in hash order, counted per class and hash prefix. A label other than 0 and 1 is an error."""

    def __init__(self, df: DataFrame, label: str, key: Sequence[str], seed: int):
        self.rows = df.select(col(label).cast("string").alias("label"), key_hash(seed, key).alias("hash"))
        self.label, self.key, self.seed = label, tuple(key), seed
        self._prefixes = self._count(self.rows, DIGITS)
        self.counts: dict[int, int] = {}
        for group, rows_inside in self._prefixes.items():
            if group is None or group[0] not in "01" or len(group) > 1 + DIGITS:
                raise ValueError(f"{rows_inside} rows or more have another label than 0 and 1 in {label}")
            value = int(group[0])
            self.counts[value] = self.counts.get(value, 0) + rows_inside

    @staticmethod
    def _group(digits: int) -> Column:
        return F.concat(F.col("label").cast("string"), F.substring("hash", 1, digits))

    def _count(self, rows: DataFrame, digits: int) -> dict[str, int]:
        """Rows per class and prefix: at most 2 * 16**DIGITS groups below any one prefix."""
        counted = rows.groupBy(self._group(digits).alias("group")).agg(F.count(F.lit(1)).alias("rows"))
        return {r["group"]: r["rows"] for r in counted.collect()}

    def _inside(self, cuts: list[_Cut], digits: int) -> DataFrame:
        return self.rows.where(self._group(digits).isin(sorted({cut.group for cut in cuts})))

    def cut_values(self, ranks: Mapping[int, Sequence[int]]) -> dict[int, list[str | None]]:
        """Per class and rank, the hash below which lie exactly ``rank`` rows; None: all rows."""
        cuts = {
            (c, rank): _Cut(c, rank)
            for c, wanted in ranks.items()
            for rank in wanted
            if 0 < rank < self.counts[c]
        }
        values: dict[tuple[int, int], str] = {}
        if cuts:
            digits, counted = DIGITS, self._prefixes
            self._enter(list(cuts.values()), counted)
            while any(cut.rows > RANKED_ROWS and not cut.hot for cut in cuts.values()) and digits < 30:
                inside = self._inside(list(cuts.values()), digits)
                digits += DIGITS
                self._enter(list(cuts.values()), self._count(inside, digits))
            values = self._hash_at(list(cuts.values()), digits)
        return {
            c: ["" if rank <= 0 else values.get((c, rank)) for rank in wanted]
            for c, wanted in ranks.items()
        }

    @staticmethod
    def _enter(cuts: list[_Cut], counted: Mapping[str, int]) -> None:
        """Move every cut into the counted prefix that holds its rank."""
        ordered = sorted(counted.items())
        for cut in cuts:
            for group, rows in ordered:
                if not group.startswith(cut.group):
                    continue
                if cut.before + rows > cut.rank:
                    # A longer prefix that keeps most rows holds one key: ranking counts it once.
                    cut.hot = 0 < cut.rows < 2 * rows
                    cut.prefix, cut.rows = group[1:], rows
                    break
                cut.before += rows

    def _hash_at(self, cuts: list[_Cut], digits: int) -> dict[tuple[int, int], str]:
        """Rank the rows of the few prefixes that a cut falls into."""
        order = Window.partitionBy("group").orderBy("hash")
        ranked = (
            self._inside(cuts, digits)
            .groupBy(self._group(digits).alias("group"), "hash")
            .agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("start", F.sum("rows").over(order) - F.col("rows"))
        )

        def holds(cut: _Cut) -> Column:
            offset = cut.rank - cut.before
            here = (F.col("start") <= offset) & (offset < F.col("start") + F.col("rows"))
            return (F.col("group") == cut.group) & here

        picked = ranked.where(reduce(lambda a, b: a | b, [holds(cut) for cut in cuts])).collect()
        values = {}
        for cut in cuts:
            offset = cut.rank - cut.before
            for row in picked:
                if row["group"] != cut.group or not row["start"] <= offset < row["start"] + row["rows"]:
                    continue
                if row["start"] < offset:
                    raise ValueError(
                        f"{row['rows']} rows share one key where the table is cut; "
                        f"{', '.join(self.key)} must identify a row"
                    )
                values[cut.label, cut.rank] = row["hash"]
        return values

    def assign(
        self,
        df: DataFrame,
        name: str,
        values: Sequence[str | int],
        cuts: Mapping[int, Sequence[str | None]],
    ) -> DataFrame:
        """``values[i]`` for the rows between cut ``i-1`` and cut ``i`` of their class."""
        hashed = F.col("key_hash")
        # Rows of another label, which an empty table has none of, get no value.
        choice = F.when(F.lit(False), F.lit(values[0]))
        for c, limits in cuts.items():
            inside = F
            for value, limit in zip(values, limits):
                below = F.lit(True) if limit is None else hashed < F.lit(limit)
                inside = inside.when(below, F.lit(value))
            choice = choice.when(F.col(self.label) == c, inside.otherwise(F.lit(values[-1])))
        # A column of its own, so that the hash is computed once per row.
        with_hash = df.withColumn("key_hash", key_hash(self.seed, self.key))
        return with_hash.withColumn(name, choice).drop("key_hash")


def stratified_split(
    df: DataFrame,
    label: str,
    key: Sequence[str],
    test_size: float = 0.2,
    val_size: float = 0.125,
    seed: int = 42,
    name: str = "split",
) -> DataFrame:
    """'test', 'val' or 'train' from key and label alone."""
    order = KeyOrder(df, label, key, seed)
    sizes = split_sizes(order.counts, test_size, val_size)
    cuts = order.cut_values({c: [test, test + val] for c, (test, val) in sizes.items()})
    return order.assign(df, name, ["test", "val", "train"], cuts)


def stratified_folds(
    df: DataFrame,
    label: str,
    key: Sequence[str],
    folds: int,
    seed: int = 42,
    name: str = "fold",
    shuffle: bool = True,
) -> DataFrame:
    """Fold 0 to folds-1; sizes differ by at most one row, overall and per class.

    Without ``shuffle`` the rows of a class are dealt in the order of the key, so that a fold holds
    consecutive ones; else in the order of the key's hash.
    """
    if not shuffle:
        counts = {r["label"]: r["rows"] for r in _class_rows(df, label).collect()}
        if odd := [c for c in counts if c not in (0, 1)]:
            raise ValueError(f"{sum(counts[c] for c in odd)} rows have another label than 0 and 1 in {label}")
        ends = {c: list(accumulate(sizes[:-1])) for c, sizes in fold_sizes(counts, folds).items()}
        cuts = Cuts(df, label, key, counts)
        return cuts.assigned(df, label, name, cuts.at(ends))
    order = KeyOrder(df, label, key, seed)
    ends = {
        c: list(accumulate(sizes[:-1])) for c, sizes in fold_sizes(order.counts, folds).items()
    }
    return order.assign(df, name, list(range(folds)), order.cut_values(ends))


def _class_rows(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
