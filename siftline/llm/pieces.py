"""SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.slices import Table, gathered, held, list_array, text_slices

#: The whitespace marker of the library.
MARK = "▁"
#: Distinct words that the table of one Python worker holds.
TABLE_WORDS = 200_000
#: What a model must leave as it is for marked words to be found before its normalisation.
PROBE = "aA éé ﬁＡ　 \tb  c ​ \r\nzßİ "

_CHUNK = re.compile(" +[^ ]*")


@cache
def load(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def words_stand_alone(path: str) -> bool:
    """Whether marked words can be segmented apart.

    No piece may have a marker behind another character, and normalisation may only put markers
    for spaces and one before the text. Then no merge reaches over the start of a marked word.
    """
    model = load(path)
    pieces = (model.id_to_piece(i) for i in range(model.vocab_size()))
    if any(MARK in piece.lstrip(MARK) for piece in pieces):
        return False
    marked = MARK + PROBE.replace(" ", MARK)
    return model.normalize(PROBE) == marked


def marked_words(text: str) -> list[str]:
    """The words of a text, each without its first marker: runs of spaces with what follows them."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [chunk[1:] for chunk in _CHUNK.findall(" " + text)]


def _word_table(path: str) -> Table:
    """Ids of distinct marked words, each segmented once by the library."""
    model = load(path)
    skip = len(model.encode("x"))

    def encode(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # Behind another word, so that the library's marker before a text isn't the word's own.
        found = model.encode([f"x {word}" for word in words.to_pylist()], num_threads=1)
        ids = np.array([i for ids in found for i in ids[skip:]], np.int32)
        return ids, np.array([len(ids) - skip for ids in found], np.int64)

    return Table(encode, np.dtype(np.int32), TABLE_WORDS)


def encode_all(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, as the library gives them without begin and end ids, and the number of each text's."""
    if not words_stand_alone(path):
        found = load(path).encode(texts, num_threads=1)
        return np.array([i for ids in found for i in ids], np.int32), np.array([len(ids) for ids in found], np.int64)
    table = held(f"words of {path}", lambda: _word_table(path))
    rows = [marked_words(text) for text in texts]
    counts = [len(row) for row in rows]
    words = pa.array([word for row in rows for word in row], pa.large_string()).dictionary_encode()
    del rows
    which = table.places(words.dictionary)[words.indices.to_numpy()]
    ids, each = gathered(table.ids, table.sizes, which)
    upto = np.concatenate([[0], np.cumsum(each)])
    return ids, np.diff(upto[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])])


def _decoded(ids: Iterable[np.ndarray], path: str) -> pa.Array:
    model = load(path)
    return pa.array([model.decode(x.tolist()) if len(x) else "" for x in ids], pa.string())


def _encoder(path: str, text_col: str, decode: bool) -> Callable:
    """Adds the ids, and if asked for the text that these ids decode to."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, text_col):
            ids, sizes = encode_all(texts, path)
            added = [list_array(ids, sizes, pa.int32())]
            if decode:
                added.append(_decoded(np.split(ids, np.cumsum(sizes)[:-1]), path))
            names = ["ids", "decoded"][: len(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

    return encode


def _decoder(path: str, ids_col: str) -> Callable:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in batch.column(ids_col)]
            texts = _decoded(ids, path)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])

    return decode


IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
DECODED = T.StructField("decoded", T.StringType())


def _with(df: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*df.schema.fields, *fields])


def encode_texts(df: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids array<int>``: exactly what the library's ``encode`` gives for each whole text.

    Inside a task a text is cut before each run of spaces, each distinct piece of text is
    segmented once, and the ids are joined again by position. For a model whose pieces reach over
    spaces, or that rewrites texts, whole texts go to the library. Null and empty texts give no
    ids. Any other columns stay; a column named ``ids`` is replaced. ``model`` is a file that
    every executor can open.
    """
    df = df.drop("ids")
    return df.mapInArrow(_encoder(model, text_col, False), _with(df, IDS))


def decode_ids(df: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded string``: the library's ``decode`` of each row's ids; null or no ids give an empty text."""
    df = df.drop("decoded")
    return df.mapInArrow(_decoder(model, ids_col), _with(df, DECODED))


def round_trip(df: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``encode_texts``, and ``decode_ids`` of its ids in the same pass."""
    df = df.drop("ids", "decoded")
    return df.mapInArrow(_encoder(model, text_col, True), _with(df, IDS, DECODED))


def digests(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` of the round trip of every row."""
    rows = round_trip(df.select(id_col, text_col), model, text_col)
    return rows.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
