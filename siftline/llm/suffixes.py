"""Repeated passages by a sparse suffix array: minimiser positions, sorted neighbours, extension to both sides."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.columns import renamed, sent
from siftline.llm.slices import list_array, text_slices
from siftline.llm.wordseq import Sequence, minimisers, word_hashes
from siftline.session import stored

#: Words of a suffix's opening, by which suffixes are selected, sorted and compared.
OPENING = 8
#: White space between words, as in ``bytes.split``.
_BLANK = " \t\n\x0b\f\r"
#: Suffixes that a task sorts.
SORTED_ROWS = 1_000_000


def _openings(words: list[bytes], passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and of the openings, and for each passage the suffix that stands for it.

    A passage of ``passage`` words is represented by its opening with the smallest hash, the
    leftmost of equals: the same one, at the same place, wherever the passage occurs.
    """
    hashes = word_hashes(words)
    if len(words) < passage:
        return hashes, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    opening = min(OPENING, passage)
    values = Sequence(hashes).runs(np.arange(len(words) - opening + 1), opening)
    return hashes, values, minimisers(values, passage - opening + 1)


def _retain(passage: int) -> Callable:
    """Of each text that is long enough: its words, where they begin and end, the distinct openings it retains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text"):
            rows, kept = [], []
            for k, text in enumerate(texts):
                words = text.encode().split()
                if len(words) >= passage:
                    _, values, chosen = _openings(words, passage)
                    kept.append(np.unique(values[np.unique(chosen)]).view(np.int64))
                    rows.append((k, len(text) - len(text.lstrip(_BLANK)), len(text.rstrip(_BLANK)), len(words)))
            row = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(row), batch.column("text_hash").take(row)]
                + [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)]
                + [list_array(np.concatenate([*kept, np.zeros(0, np.int64)]), [len(x) for x in kept], pa.int64())],
                ["id", "text_hash", "start", "end", "n_words", "openings"],
            )

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted suffixes those that open like a neighbour of another text, and those at the ends of the part.

    Rows that repeat opening and text, as copies of a text do, count once.
    """
    held: pa.RecordBatch | None = None  # the last row: kept back until its next neighbour is seen
    alike = True  # whether the row held back opens like the one before it, or is the first
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        opening, text = batch.column("opening").to_numpy(), batch.column("text_hash").to_numpy()
        new = np.concatenate([[True], (opening[1:] != opening[:-1]) | (text[1:] != text[:-1])])
        batch, opening = batch.filter(pa.array(new)), opening[new]
        same = opening[1:] == opening[:-1]
        keep = np.concatenate([[alike], same])
        keep[:-1] |= same
        alike, held = bool(keep[-1]), batch.slice(batch.num_rows - 1)
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1])).select(["text_hash", "opening"])
    if held is not None:
        yield held.select(["text_hash", "opening"])


def _word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word as places in the text; words as in ``bytes.split``."""
    data = np.frombuffer(text, np.uint8)
    blank = np.concatenate([[True], (data == 32) | ((data >= 9) & (data <= 13)), [True]])
    edges = np.diff(blank.astype(np.int8))
    places = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
    return places[np.nonzero(edges == -1)[0]], places[np.nonzero(edges == 1)[0]]


def _extend(passage: int) -> Callable:
    """Every passage that a surviving suffix stands for: two hashes of its words, its first word, its characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text"):
            sizes, parts = [], []
            for text, openings in zip(texts, batch.column("openings"), strict=True):
                data = text.encode()
                hashes, values, chosen = _openings(data.split(), passage)
                alive = np.isin(values.view(np.int64), openings.values.to_numpy())
                at = np.nonzero(alive[chosen])[0]
                starts, ends = _word_bounds(data)
                keys = [Sequence(hashes, which).runs(at, passage).view(np.int64) for which in (0, 1)]
                parts.append([*keys, at, starts[at], ends[at + passage - 1]])
                sizes.append(len(at))
            rows = pa.array(np.repeat(np.arange(len(texts)), sizes), pa.int64())
            flat = [np.concatenate(column) for column in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(rows), batch.column("text_hash").take(rows)]
                + [pa.array(column) for column in flat[:2]]
                + [pa.array(column.astype(np.int32)) for column in flat[2:]],
                ["id", "text_hash", "key", "check", "at", "start", "end"],
            )

    return run


_PASSAGE = "id long, text_hash long, key long, check long, at int, start int, end int"
#: Of the rows of ``_first_texts``: repeated, at the edge of a sorted part, the first text of an edge.
_REPEATED, _EDGE, _FIRST = 0, 1, 2


def _first_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted passages those that another text holds before, with that text's id.

    Equal passages stand together, the first text first. A part's first group may have begun in
    an earlier part: its rows come undecided, with the first text that the group has here; so does
    the first text of the last group.
    """
    held: tuple | None = None  # key, check, id, text hash of the first row of the group that is open
    opening, firsts = True, []  # whether that is the part's first group

    def rows(kind, ids, hashes, batch, keep, first):
        take = pa.array(np.nonzero(keep)[0])
        columns = [pa.array(np.full(len(take), kind, np.int32)), ids.take(take), hashes.take(take)]
        columns += [batch.column(name).take(take) for name in ("key", "check", "at", "start", "end")]
        names = ["kind", "id", "text_hash", "key", "check", "at", "start", "end", "first_id"]
        return pa.RecordBatch.from_arrays([*columns, first.take(take)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        key, check, text = (batch.column(name).to_numpy() for name in ("key", "check", "text_hash"))
        begins = np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])])
        if held is not None and held[:2] == (key[0], check[0]):
            begins[0] = False
        first = np.maximum.accumulate(np.where(begins, np.arange(len(key)), -1))
        carried = first < 0
        ids = batch.column("id")
        first_id = ids.take(pa.array(np.maximum(first, 0)))
        first_text = text[np.maximum(first, 0)]
        if carried.any():
            first_text = np.where(carried, held[3], first_text)
            first_id = pa.compute.if_else(pa.array(carried), pa.scalar(held[2], pa.int64()), first_id)
        edge = carried & opening if held is not None else first == 0
        repeated = (text != first_text) & ~edge
        yield rows(_REPEATED, ids, batch.column("text_hash"), batch, repeated, first_id)
        if edge.any():
            yield rows(_EDGE, ids, batch.column("text_hash"), batch, edge, first_id)
        if held is None:
            firsts.append((int(key[0]), int(check[0]), ids[0].as_py(), int(text[0])))
        opening = bool(edge[-1])
        if not carried[-1]:
            at = int(first[-1])
            held = (int(key[at]), int(check[at]), ids[at].as_py(), int(text[at]))
    if held is not None:
        firsts.append(held)
        table = pa.table(
            {"kind": [_FIRST] * len(firsts), "id": [x[2] for x in firsts], "text_hash": [x[3] for x in firsts],
             "key": [x[0] for x in firsts], "check": [x[1] for x in firsts], "at": [0] * len(firsts),
             "start": [0] * len(firsts), "end": [0] * len(firsts), "first_id": [x[2] for x in firsts]},
            pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("text_hash", pa.int64()), ("key", pa.int64()),
                       ("check", pa.int64()), ("at", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                       ("first_id", pa.int64())]),
        )
        yield from table.to_batches()


def _repeated(passages: DataFrame) -> DataFrame:
    """``(id, text_hash, at, start, end, first_id)`` of the passages that another text holds before."""
    parts = max(1, -(-passages.count() // SORTED_ROWS))
    order = ["key", "check", F.col("id").isNull(), "id", "text_hash"]
    sorted_parts = passages.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = stored(sorted_parts.mapInArrow(_first_texts, f"kind int, {_PASSAGE}, first_id long"), "repeated")
    # Two rows for each sorted part at most: a group that goes on in a next part has its first text there.
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("first")
    firsts = found.where(F.col("kind") == _FIRST).groupBy("key", "check").agg(first)
    rows = found.where(F.col("kind") != _FIRST).join(F.broadcast(firsts), ["key", "check"], "left")
    repeated = (F.col("kind") == _REPEATED) | (F.col("text_hash") != F.col("first.text_hash"))
    first_id = F.when(F.col("kind") == _REPEATED, F.col("first_id")).otherwise(F.col("first.id"))
    return rows.where(repeated).withColumn("first_id", first_id).select("id", "text_hash", "at", "start", "end", "first_id")


def _stretches(passage: int) -> Callable:
    """Join the repeated passages of a text where they touch or overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "text_hash", "start", "end", "n_words", "first_doc_id"]
        for batch in batches:
            rows = []
            for k, found in enumerate(batch.column("passages")):
                columns = found.values.flatten()
                at, start, end = (column.to_numpy() for column in columns[:3])
                order = np.argsort(at)
                cuts = np.nonzero(np.diff(at[order]) > passage)[0] + 1
                for group in np.split(order, cuts):
                    a, b = group[0], group[-1]
                    first = pa.compute.min(columns[3].take(pa.array(group))).as_py()
                    rows.append((k, int(start[a]), int(end[b]), int(at[b] - at[a]) + passage, first))
            owner = pa.array([row[0] for row in rows], pa.int64())
            kept = [batch.column("id").take(owner), batch.column("text_hash").take(owner)]
            kept += [pa.array([row[k] for row in rows], pa.int64()) for k in range(1, 5)]
            yield pa.RecordBatch.from_arrays(kept, names)

    return run


#: Texts with surviving suffixes, and their suffixes, up to which both are sent to every executor.
BROADCAST_TEXTS, BROADCAST_SUFFIXES = 200_000, 2_000_000


def _of_texts(texts: DataFrame, other: DataFrame, small: bool) -> DataFrame:
    """Join on id and text; ``small``: whether ``other`` has been counted and may be sent to every executor."""
    other = other.withColumnsRenamed({"id": "_id", "text_hash": "_hash"})
    here = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return texts.join(F.broadcast(other) if small else other, here).drop("_id", "_hash")


def _stretches_by_text(df: DataFrame, id_col: str, text_col: str, passage: int) -> DataFrame:
    """``(id, text_hash, start, end, n_words, first_doc_id)``, see ``repeated_passages``."""
    texts = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")
    )
    light = stored(
        texts.mapInArrow(
            _retain(passage),
            "id long, text_hash long, start long, end long, n_words long, openings array<long>",
        ),
        "texts",
    )
    retained = light.select("text_hash", F.explode("openings").alias("opening"))
    count = light.agg(F.sum(F.size("openings"))).first()[0] or 0
    parts = max(1, -(-count // SORTED_ROWS))
    # A hot opening is dealt by its texts, and one of copies of a text by the salt.
    alike = (
        retained.withColumn("salt", F.monotonically_increasing_id())
        .repartitionByRange(parts, "opening", "text_hash", "salt")
        .sortWithinPartitions("opening", "text_hash")
        .mapInArrow(_compare, "text_hash long, opening long")
    )
    openings = alike.groupBy("text_hash").agg(F.collect_set("opening").alias("openings"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id")).alias("first")
    firsts = light.groupBy("text_hash").agg(first).select("text_hash", F.col("first.id").alias("id"))
    by_text = stored(openings.join(firsts, "text_hash"), "survivors")  # one row of each text goes on
    size = by_text.agg(F.count("*").alias("texts"), F.sum(F.size("openings")).alias("suffixes")).first()
    small = size.texts <= BROADCAST_TEXTS and (size.suffixes or 0) <= BROADCAST_SUFFIXES
    light = light.drop("openings")
    passages = stored(
        _of_texts(texts, by_text, small)
        .select("id", "text_hash", "text", "openings")
        .mapInArrow(_extend(passage), _PASSAGE),
        "passages",
    )
    by_document = _repeated(passages).groupBy("id", "text_hash")
    found = by_document.agg(F.collect_set(F.struct("at", "start", "end", "first_id")).alias("passages"))
    spans = "id long, text_hash long, start long, end long, n_words long, first_doc_id long"
    copies = light.join(firsts.withColumnRenamed("id", "first_doc_id"), "text_hash")
    copies = copies.where(~F.col("id").eqNullSafe(F.col("first_doc_id"))).distinct()
    return found.mapInArrow(_stretches(passage), spans).unionByName(copies)


def repeated_passages(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = 50
) -> DataFrame:
    """``(id, start, end, n_words, first_doc_id)``: the stretches of each text that repeat an earlier document.

    A passage of ``passage`` words repeats if the same words in a row occur in a document with a
    smaller id; overlapping and adjoining passages are one stretch, from character ``start`` to
    before ``end``. ``first_doc_id`` is the smallest id that holds a passage of it; of a text that
    is all a copy, the smallest id of that text. Words are runs
    of characters other than ASCII white space and must be equal; what stands between them doesn't
    matter. Passages that repeat inside one document only are not reported.

    Each text retains the suffixes at minimiser positions: every passage holds one, the same in
    all its copies. Suffixes are sorted by their opening over the whole table, and those unlike
    both neighbours are dropped (of those at the edges of a sorted part nothing is known, and they
    stay). A survivor is extended to the left and the right: every passage that it stands for is
    sorted among all such passages and compared with its neighbour. So stretches come out whole,
    however long. Texts that are equal are extended once.

    Null and empty texts, and those with fewer words, have no stretches. Rows that repeat an id
    and a text are one document; rows that share an id only are compared like any others, ordered
    by a hash of the text. A null id comes last. Other columns are not read.
    """
    found = _stretches_by_text(df, id_col, text_col, passage)
    return found.select(F.col("id").alias(id_col), "start", "end", "n_words", "first_doc_id")


def without_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", passage: int = 50
) -> DataFrame:
    """``df`` without the stretches of ``repeated_passages``; of each passage the first document keeps its copy.

    All columns and rows stay, other texts untouched; ``chars_col``, where there is such a column,
    becomes the length of a changed text.
    """
    rows, (id_at, text_at) = renamed(df, id_col, text_col)
    spans = _stretches_by_text(rows, id_at, text_at, passage)
    spans = spans.groupBy("id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    here = F.col(id_at).cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(text_at) == F.col("text_hash"))
    joined = rows.join(sent(stored(spans, "spans"), "spans"), here, "left")
    cut = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("kept"), F.lit(0).alias("upto")),
        lambda held, span: F.struct(
            F.concat(held["kept"], _between(text_at, held["upto"], span["start"])).alias("kept"),
            span["end"].cast("int").alias("upto"),
        ),
        lambda held: F.concat(held["kept"], _between(text_at, held["upto"], F.length(text_at))),
    )
    changed = F.col("spans").isNotNull()
    columns = {text_at: F.when(changed, cut).otherwise(F.col(text_at))}
    out = joined.withColumns(columns)
    if chars_col in df.columns:
        chars_at = f"c{df.columns.index(chars_col)}"
        length = F.length(text_at).cast(df.schema[chars_col].dataType)
        out = out.withColumn(chars_at, F.when(changed, length).otherwise(F.col(chars_at)))
    return out.select(*rows.columns).toDF(*df.columns)


def _between(text: str, start: Column, end: Column) -> Column:
    return F.substring(F.col(text), start + 1, (end - start).cast("int"))
