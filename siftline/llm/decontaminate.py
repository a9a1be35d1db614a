"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

Only DataFrame functions run here. A short item inside a long document has next to no Jaccard
similarity with it, so the search is by containment: items are partitioned by their number of
shingles, and of each item the smallest shingle hashes are kept, so many that a document with
the wanted share of the item's shingles must hold one of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.columns import renamed, sent
from siftline.session import stored


def _words(text: str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _windows(array: str, size: int, combine, shorter: Sequence[int] = ()) -> Column:
    """``combine`` of each window of ``size`` elements; of all of them if there are fewer; none of none.

    Windows of each of the sizes ``shorter`` follow. ``array`` is read once for each element of a
    window, so it has to be a column that is there, see ``_computed``.
    """

    def full(size: int) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(array) - size),
            lambda i: combine([F.get(F.col(array), i + k) for k in range(size)]),
        )

    none = F.array().cast(f"array<{'string' if combine is _joined else 'bigint'}>")
    windows = F.when(F.size(array) >= size, full(size)).otherwise(none)
    if size > 1:
        whole = F.array(combine([F.get(F.col(array), F.lit(k)) for k in range(size - 1)]))
        windows = F.when(F.size(array).between(1, size - 1), whole).otherwise(windows)
    return F.concat(windows, *(F.when(F.size(array) >= k, full(k)).otherwise(none) for k in shorter)) if shorter else windows


def _computed(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a column by a generator of one row: a plain projection would be merged into its users and run for each."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def _joined(words: list[Column]) -> Column:
    return F.concat_ws(" ", *words)


def _hashed(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def shingle_hashes(df: DataFrame, text: str, size: int, shorter: Sequence[int] = ()) -> DataFrame:
    """Add ``hashes``: the distinct hashes of a text's word shingles, of the sizes ``shorter`` as well."""
    return (
        _computed(df, "_words", F.transform(_words(text), lambda w: F.xxhash64(w)))
        .withColumn("hashes", F.array_distinct(_windows("_words", size, _hashed, shorter)))
        .drop("_words")
    )


def shingles(df: DataFrame, text: str, size: int, shorter: Sequence[int] = ()) -> DataFrame:
    """Add ``shingles``: the distinct shingles of a text, of the sizes ``shorter`` as well, words joined by spaces."""
    return (
        _computed(df, "_words", _words(text))
        .withColumn("shingles", F.array_distinct(_windows("_words", size, _joined, shorter)))
        .drop("_words")
    )


def sketches(items: DataFrame, size: int, threshold: float) -> DataFrame:
    """``(item, hash)``: the smallest hashes of each item's shingles.

    Items are partitioned by size: up to 8 shingles, 16, 32 and so on. A text that holds at least
    ``threshold`` of n shingles lacks at most (1 - threshold) * n of them, so it holds one of any
    (1 - threshold) * n + 1. That number for the partition's largest size is kept.
    """
    sized = shingle_hashes(items, "text", size).withColumn("n", F.size("hashes")).where("n > 0")
    upper = F.pow(F.lit(2), F.greatest(F.ceil(F.log2("n") - 1e-9), F.lit(3)))
    keep = F.floor(upper * (1 - threshold) + 1e-6).cast("int") + 1
    return sized.select("item", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), keep)).alias("hash"))


def contained_items(
    documents: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 5,
    threshold: float = 0.8,
) -> DataFrame:
    """``(id, item_id, n_shingles, n_shared, containment)`` of every document that holds ``threshold`` of an item.

    Containment is the share of the item's distinct shingles of ``size`` words that are in the
    document. An item of fewer words is one shingle of all of them, found in documents of just
    these words; items without words are in none. Documents are hashed once against the sketches;
    only candidates are read again, and counted on the shingles themselves.

    Null and empty texts hold nothing. Rows that repeat an id and a text are one document, or one
    item; rows that share an id only are apart, and each gives rows of its own. Null ids stay.
    Other columns are not read.
    """
    questions = stored(
        items.select(
            F.col(item_col).alias("item_id"),
            F.col(item_text_col).alias("text"),
            F.xxhash64(F.col(item_col), F.col(item_text_col)).alias("item"),
        ).dropDuplicates(["item_id", "text"]),
        "items",
    )
    texts = documents.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")
    )
    lengths = questions.select(F.size(_words("text")).alias("n")).where(F.col("n").between(1, size - 1)).distinct()
    shorter = sorted(row.n for row in lengths.collect())
    small = stored(sketches(questions, size, threshold), "sketches")
    probes = shingle_hashes(texts, "text", size, shorter).select("id", "text_hash", F.explode("hashes").alias("hash"))
    candidates = stored(
        probes.join(sent(small), "hash").select("id", "text_hash", "item").distinct(), "candidates"
    )

    parts = shingles(questions, "text", size).select(
        "item_id", "item", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")
    )
    parts = stored(parts, "item-shingles")
    wanted = candidates.groupBy("id", "text_hash").agg(F.collect_set("item").alias("wanted"))
    wanted = stored(wanted.withColumnsRenamed({"id": "_id", "text_hash": "_hash"}), "wanted")
    chosen = (
        texts.join(
            sent(wanted, "wanted"),
            F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")),
        )
        .drop("_id", "_hash")
        .dropDuplicates(["id", "text_hash"])
    )
    held = shingles(chosen, "text", size, shorter).select("id", "text_hash", "wanted", F.explode("shingles").alias("shingle"))
    shared = (
        held.join(sent(parts), "shingle")
        .where(F.array_contains("wanted", F.col("item")))
        .groupBy("id", "text_hash", "item_id", "item", "n")
        .agg(F.count("*").alias("n_shared"))
    )
    return shared.where(F.col("n_shared") / F.col("n") >= threshold).select(
        F.col("id").alias(id_col),
        "item_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.col("n_shared").cast("long").alias("n_shared"),
        (F.col("n_shared") / F.col("n")).alias("containment"),
    )


def decontaminated(
    documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The rows of ``documents``, all columns, that hold none of the ``items``. Rows that share an id go together."""
    rows, (id_at, text_at) = renamed(documents, id_col, text_col)
    found = contained_items(rows, items, id_at, text_at, **options).select(F.col(id_at).alias("found")).distinct()
    return rows.join(sent(stored(found, "found")), F.col(id_at).eqNullSafe(F.col("found")), "left_anti").toDF(*documents.columns)
