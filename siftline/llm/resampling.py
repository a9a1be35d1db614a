"""Resampling towards a target distribution: hashed n-gram features, bucket gains, Gumbel-top-k draw."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.crc import crc32_of_spans
from siftline.llm.ranks import ranked
from siftline.llm.slices import text_slices
from siftline.session import stored

#: Characters whose features are worked on at once: each byte stands in up to six spans.
CHARS_AT_ONCE = 200_000
_LOWER = bytes(k + 32 if 65 <= k <= 90 else k for k in range(256))
#: Bytes of words: digits, a to z, and all bytes of characters outside ASCII.
_WORD = np.array([48 <= k <= 57 or 97 <= k <= 122 or k >= 128 for k in range(256)])


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased texts, each with one blank behind it: the bytes, starts, ends, the words' texts."""
    parts = [text.encode().translate(_LOWER) for text in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    text_ends = np.cumsum([len(part) + 1 for part in parts])
    word = _WORD[data]
    behind = np.zeros(len(data), bool)
    behind[1:] = word[:-1] & ~word[1:]
    first = word.copy()
    first[1:] &= ~word[:-1]
    owner = np.searchsorted(text_ends, np.nonzero(first)[0], side="right")
    kept = word | behind
    plain = np.where(word, data, np.uint8(32))[kept]
    ends = np.nonzero(plain == 32)[0]
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    return plain, starts, ends, owner


def features(texts: list[str], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all runs of 1 to ``longest`` consecutive words of each text: the bucket, the text; and each text's words."""
    plain, starts, ends, owner = _words(texts)
    found, owners = [], []
    for n in range(1, longest + 1):
        if len(starts) < n:
            break
        last = n - 1
        inside = np.nonzero(owner[last:] == owner[: len(owner) - last])[0]
        if len(inside):
            found.append(crc32_of_spans(plain, starts[inside], ends[inside + last] - starts[inside]) % np.uint32(buckets))
            owners.append(owner[inside])
    none = np.zeros(0, np.int64)
    counts = np.bincount(owner, minlength=len(texts))
    return np.concatenate([none, *found]), np.concatenate([none, *owners]), counts


def _counts(longest: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, texts in text_slices(batches, "text", CHARS_AT_ONCE):
            total += np.bincount(features(texts, longest, buckets)[0], minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return run


def bucket_counts(df: DataFrame, text_col: str, longest: int = 3, buckets: int = 10_000) -> dict[int, int]:
    """How many features of all texts each bucket holds; at most ``buckets`` numbers come to the driver."""
    found = df.select(F.col(text_col).alias("text")).mapInArrow(_counts(longest, buckets), "bucket long, n long")
    return {r.bucket: r.n for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def bucket_gains(source: dict[int, int], target: dict[int, int], buckets: int = 10_000) -> np.ndarray:
    """floor(1000 * ln of the target's smoothed share of a bucket over the source's), in doubles."""
    s = np.array([source.get(k, 0) for k in range(buckets)], np.float64)
    t = np.array([target.get(k, 0) for k in range(buckets)], np.float64)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weigh(gains: np.ndarray, longest: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text", CHARS_AT_ONCE):
            bucket, owner, words = features(texts, longest, len(gains))
            weight = np.bincount(owner, gains[bucket], len(texts)).astype(np.int64)  # whole numbers, exact in doubles
            sizes = np.bincount(owner, minlength=len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(words), pa.array(sizes), pa.array(weight)],
                ["id", "n_words", "n_features", "weight"],
            )

    return run


def weighed(
    df: DataFrame, id_col: str, text_col: str, gains: np.ndarray, longest: int = 3
) -> DataFrame:
    """``(id, n_words, n_features, weight)`` for every row: the sum of the gains of all its features."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_weigh(gains, longest), f"id {kind}, n_words long, n_features long, weight long")


def gumbel(id_: Column, seed: int) -> Column:
    """floor(1000 * a Gumbel variate) that the seed and the id decide."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resampled(
    df: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    percent: int = 5,
    least_words: int = 20,
    seed: int = 42,
    longest: int = 3,
    buckets: int = 10_000,
) -> DataFrame:
    """``(id, n_features, weight, score, rank)`` for every row; the drawn ones have a rank, 1 for the highest score.

    Words are runs of ASCII digits, letters (A-Z lower-cased) and characters outside ASCII; features
    are all runs of 1 to ``longest`` consecutive words of a text, repeats included, put in buckets
    by the CRC-32 of their bytes. A bucket's gain compares the share that it has of the target's
    features with its share of ``df``'s, both smoothed by one; a row's weight is the sum over its
    features, its score the weight and a Gumbel variate of seed and id, so that the highest scores
    are a draw without replacement by weight. Of the N rows with at least ``least_words`` words,
    floor(percent * N / 100) are drawn.

    Null and empty texts have no features, the weight 0, and aren't drawn; a null id draws as the empty
    text. Ties go to the smaller id (null last); rows that repeat an id are rows of their own. With
    no target text every gain compares with an even share. Empty tables give no rows. Other columns
    are not read. Texts of any length are read whole, twice: for the counts and for the weights.
    """
    source = bucket_counts(df, text_col, longest, buckets)
    wanted = bucket_counts(target, target_text, longest, buckets)
    rows = weighed(df, id_col, text_col, bucket_gains(source, wanted, buckets), longest)
    rows = stored(rows.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "weighed")
    enough = rows.where(F.col("n_words") >= least_words)
    placed = ranked(enough, F.col("score").desc(), F.col("id").asc_nulls_last())
    drawn = percent * enough.count() // 100
    rank = F.when(F.col("_rank") < drawn, F.col("_rank") + 1).cast("long").alias("rank")
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    rest = rows.where(F.col("n_words") < least_words)
    return placed.select(*columns, rank).unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))


def drawn_rows(df: DataFrame, target: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The rows of ``df`` whose id is drawn by ``resampled``; ids must be unique, rows with a null id aren't drawn."""
    ids = resampled(df, target, id_col, **settings).where("rank IS NOT NULL").select(F.col(id_col).alias("_drawn"))
    return df.join(ids, F.col(id_col) == F.col("_drawn"), "left_semi")
