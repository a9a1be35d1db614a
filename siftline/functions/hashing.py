"""Reproducible draws from a row key: the same on every engine, layout and retry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.naming import col

# P(N <= k) of a Poisson(1) count, k = 0..9.
POISSON_ONE_CDF = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
    0.999998874797402, 0.9999998885745217,
)


def key_hash(seed: int | Column, key: Sequence[str]) -> Column:
    """32 hexadecimal digits from ``seed:key``, or ``seed:length:key1:length:key2...`` for several parts.

    The lengths, in characters, keep ("a:", "b") and ("a", ":b") apart. A NULL part counts as empty.
    """
    parts = [F.coalesce(col(name).cast("string"), F.lit("")) for name in key]
    if len(parts) > 1:
        parts = [piece for part in parts for piece in (F.length(part).cast("string"), part)]
    text = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", text, *parts))


def key_fraction(seed: int | Column, key: Sequence[str]) -> Column:
    """A number in [0, 1) from the first 32 bits of the hash."""
    digits = F.substring(key_hash(seed, key), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def poisson_count(fraction: Column) -> Column:
    """Bootstrap count of a row: Poisson(1) by its distribution function."""
    count = F.lit(0)
    for limit in POISSON_ONE_CDF:
        count = count + (fraction >= limit).cast("int")
    return count
