"""Small helpers for code that runs over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyarrow import compute
from pyspark.sql import SparkSession

from siftline.session import ship_package

#: Characters of text that are worked on at once inside a task.
CHARS = 1_500_000
#: Spark's defaults of settings for batches of rows, and what takes their place; texts can be long: rows and
#: bytes that are sent to a Python worker at once, rows of a file that are decoded at once.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1500"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "2m"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"),
}


def ready(spark: SparkSession) -> None:
    """Prepare a session for code in Python workers: they get this package, and whole texts in small batches.

    What the session says otherwise about batches holds.
    """
    ship_package(spark)
    for name, (default, small) in BATCHES.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, small)


def text_slices(
    batches: Iterator[pa.RecordBatch], text: str, chars: int = CHARS
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut batches into slices of about ``chars`` characters, one row at least; null texts come as empty ones.

    At the end of a task the worker, which waits for other tasks, gives free memory back.
    """
    for batch in batches:
        first, held, size = 0, [], 0
        for k, value in enumerate(batch.column(text)):
            held.append(value.as_py() or "")
            size += len(held[-1])
            if size >= chars:
                yield batch.slice(first, k + 1 - first), held
                first, held, size = k + 1, [], 0
        if held:
            yield batch.slice(first), held
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def list_array(values, sizes, kind: pa.DataType) -> pa.ListArray:
    """Lists from one flat numpy array and the size of each list."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def gathered(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``which`` of ``flat``, whose pieces have ``sizes``, one behind the other, and their sizes."""
    starts, wanted = np.cumsum(sizes) - sizes, sizes[which]
    at = np.arange(wanted.sum()) + np.repeat(starts[which] - (np.cumsum(wanted) - wanted), wanted)
    return flat[at], wanted


class Table:
    """Ids of distinct words, as Arrow and numpy arrays: some tens of bytes for each word.

    ``encode`` gives the ids of words in a row and the number of each word's. A table that is full
    is emptied before more words come, which changes no result.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], kind: np.dtype, most: int):
        self.encode, self.kind, self.most = encode, kind, most
        self._empty()

    def _empty(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids, self.sizes = np.zeros(0, self.kind), np.zeros(0, np.int64)

    def places(self, words: pa.Array) -> np.ndarray:
        """Where the distinct ``words`` are in ``ids`` and ``sizes``; new ones are encoded first."""
        if len(self.words) > self.most:
            self._empty()
        at = compute.index_in(words, value_set=self.words)
        unknown = at.is_null()
        places, new = at.fill_null(0).to_numpy().astype(np.int64), words.filter(unknown)
        if len(new):
            places[unknown.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
            ids, sizes = self.encode(new)
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
            self.words = pa.concat_arrays([self.words, new])
        return places


_HELD: dict[str, object] = {}


def held(kind: str, make: Callable[[], object]) -> object:
    """The one table that a Python worker keeps between tasks: one of another kind goes first."""
    if kind not in _HELD:
        _HELD.clear()
        _HELD[kind] = make()
    return _HELD[kind]
