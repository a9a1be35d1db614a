"""Quality classifier: random-indexing word vectors, pooled by document, and a calibrated two-layer network."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.columns import renamed
from siftline.llm.slices import held, list_array, text_slices

#: Rows of the table of word vectors (words share rows by a hash, so the table doesn't grow), their
#: dimensions, the entries of a word's index vector, and the neighbours on either side that count.
ROWS, DIMS, ENTRIES, REACH = 1 << 14, 32, 2, 2
#: Labelled documents that the network is fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Units of the hidden layer, passes over the sample, share of the sample that sets the temperature.
HIDDEN, PASSES, CALIBRATION = 32, 60, 0.2
#: Distinct words that a worker remembers the rows of.
KNOWN_WORDS = 1 << 16
#: Tokens that are summed up at once; of these, dimensions and pairs of neighbours that are looked up at once.
TOKENS, TOGETHER, PAIRS = 1 << 18, 8, 1 << 14

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Rows(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = row = zlib.crc32(word.encode()) % ROWS
        return row


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all words and marks of the texts in a row, and the number of each text's."""
    get = held("rows of words", _Rows).__getitem__
    rows = [np.fromiter(map(get, _TOKEN.findall(text)), np.int64) for text in texts]  # one text's words at a time
    return np.concatenate([*rows, np.zeros(0, np.int64)]), np.array([len(x) for x in rows], np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each row the places and the signs of its sparse random index vector."""
    random = np.random.default_rng(20240501)
    places = np.stack([random.permutation(DIMS)[:ENTRIES] for _ in range(ROWS)])
    return places, random.choice([-1.0, 1.0], (ROWS, ENTRIES))


def _context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the index vectors of each word's neighbours over all texts of a task."""
    places, signs = index_vectors()
    total, seen = np.zeros(ROWS * DIMS, np.int64), np.zeros(ROWS, np.int64)
    for _, texts in text_slices(batches, "text"):
        rows, sizes = _tokens(texts)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        seen += np.bincount(rows, minlength=ROWS)
        for step in range(1, REACH + 1):
            together = owner[step:] == owner[:-step]
            left, right = rows[:-step][together], rows[step:][together]
            for word, near in ((left, right), (right, left)):
                for k in range(ENTRIES):
                    added = np.bincount(word * DIMS + places[near, k], signs[near, k], ROWS * DIMS)
                    total += added.astype(np.int64)
    some = np.nonzero(seen)[0]
    vectors = total.reshape(ROWS, DIMS)[some]
    columns = [pa.array(some, pa.int64()), pa.array(seen[some])] + [pa.array(vectors[:, k]) for k in range(DIMS)]
    yield pa.RecordBatch.from_arrays(columns, ["row", "n", *(f"d{k}" for k in range(DIMS))])


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Unit vectors of all ROWS rows, from the neighbours of every word of every text; zero where no word is.

    Each task adds up its own table first; what is shuffled and what the driver gets is bounded by
    ROWS, not by the texts.
    """
    names = [f"d{k}" for k in range(DIMS)]
    parts = texts.mapInArrow(_context, "row long, n long, " + ", ".join(f"{name} long" for name in names))
    sums = parts.groupBy("row").agg(*(F.sum(name).alias(name) for name in names))
    vectors = np.zeros((ROWS, DIMS))
    for row in sums.collect():
        vectors[row[0]] = row[1:]
    length = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Features of each text, from its word vectors: mean and spread, the length of the mean, the mean
    likeness of neighbours (1 where one word is repeated), and the number of words.

    A few dimensions of the words' vectors, or the vectors of a few words, are held at a time.
    """
    rows, sizes = _tokens(texts)
    sums, squares = np.zeros((len(texts), DIMS)), np.zeros((len(texts), DIMS))
    near, owner = np.zeros(len(texts)), np.repeat(np.arange(len(sizes)), sizes)
    for first in range(0, len(rows), TOKENS):
        at, of = rows[first : first + TOKENS], owner[first : first + TOKENS]
        begins = np.nonzero(np.concatenate([[True], of[1:] != of[:-1]]))[0]
        for k in range(0, DIMS, TOGETHER):
            some = vectors[:, k : k + TOGETHER].take(at, axis=0)
            sums[of[begins], k : k + TOGETHER] += np.add.reduceat(some, begins, axis=0)
            some *= some
            squares[of[begins], k : k + TOGETHER] += np.add.reduceat(some, begins, axis=0)
        after = rows[first + 1 : first + TOKENS + 1]
        together = of[: len(after)] == owner[first + 1 : first + TOKENS + 1]
        like = np.zeros(len(after), vectors.dtype)
        for k in range(0, len(after), PAIRS):
            both = slice(k, k + PAIRS)
            like[both] = np.einsum("ij,ij->i", vectors[at[: len(after)][both]], vectors[after[both]])
        near += np.bincount(of[: len(after)][together], like[together], len(texts))
    count = np.maximum(sizes, 1)[:, None]
    mean = sums / count
    spread = np.sqrt(np.maximum(squares / count - mean * mean, 0))
    length = np.sqrt((mean**2).sum(axis=1, keepdims=True))
    return np.hstack([mean, spread, length, near[:, None] / count, np.log1p(sizes)[:, None]])


@dataclass
class Model:
    """Word vectors, and a network on standardised features whose logit is divided by the temperature."""

    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float
    constant: float | None = None

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum((features - self.centre) / self.scale @ w1 + b1, 0) @ w2 + b2

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        logits = self.logits(pooled(texts, self.vectors)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


def _loss(logits: np.ndarray, labels: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - labels * logits))


def fit_network(features: np.ndarray, labels: np.ndarray, vectors: np.ndarray, seed: int = 7) -> Model:
    """Adam on the log-loss of a part of the rows; the temperature is the one that suits the rest best."""
    random = np.random.default_rng(seed)
    order = random.permutation(len(labels))
    held = max(1, int(len(labels) * CALIBRATION))
    rest, train = order[:held], order[held:]
    centre, scale = features[train].mean(axis=0), features[train].std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1)
    model = Model(
        vectors, centre, scale,
        [random.normal(0, np.sqrt(2 / features.shape[1]), (features.shape[1], HIDDEN)), np.zeros(HIDDEN),
         random.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)], 1.0,
    )
    x, y = (features[train] - centre) / scale, labels[train]
    first, second, step = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights], 0
    for _ in range(PASSES):
        shuffled = random.permutation(len(y))
        for begin in range(0, len(y), 256):
            rows = shuffled[begin : begin + 256]
            w1, b1, w2, b2 = model.weights
            hidden = np.maximum(x[rows] @ w1 + b1, 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -500, 500))) - y[rows]) / len(rows)
            back = np.outer(error, w2) * (hidden > 0)
            slopes = [x[rows].T @ back + 1e-4 * w1, back.sum(axis=0), hidden.T @ error + 1e-4 * w2, error.sum()[None]]
            step += 1
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                rate = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                model.weights[k] = model.weights[k] - 3e-3 * rate
    logits = model.logits(features[rest])
    model.temperature = float(min(np.geomspace(0.25, 8, 101), key=lambda t: _loss(logits / t, labels[rest])))
    return model


def _featured(vectors) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text"):
            features = pooled(texts, vectors.value)
            column = list_array(features.ravel(), [features.shape[1]] * len(texts), pa.float64())
            kept = [batch.column("label"), batch.column("place"), column]
            yield pa.RecordBatch.from_arrays(kept, ["label", "place", "features"])

    return run


def fit(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = SAMPLE,
) -> Model:
    """Word vectors from all ``documents``; the network from at most ``sample`` labelled ones.

    ``labels`` has one label 0 or 1 for some ids; other labels and null ids are ignored. An id that is
    labelled both ways counts for both; rows that repeat an id, a text and a label count once. Of
    ids that many rows share, those texts count whose hashes are smallest. Where both labels don't occur, the model gives every text
    the share of label 1, with one more of each: 1/2 without any label.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    vectors = word_vectors(texts.select("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("label IN (0, 1) AND id IS NOT NULL")
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample)  # at most ``sample`` rows are broadcast
    sent = spark.sparkContext.broadcast(vectors)
    # ids that many rows share: a row counts once, and the driver gets no more than ``sample`` of them
    joined = texts.join(F.broadcast(chosen), "id").select("label", "text", F.xxhash64("id", "text").alias("place"))
    rows = (
        joined.mapInArrow(_featured(sent), "label int, place long, features array<double>")
        .dropDuplicates(["place", "label"])
        .orderBy("place", "label")
        .limit(sample)
        .collect()
    )
    rows.sort(key=lambda row: (row.features, row.label))  # the same model, however the rows arrive
    answers = np.array([row.label for row in rows], float)
    if len(set(answers)) < 2 or len(rows) < 10:
        width = 2 * DIMS + 3
        share = (answers.sum() + 1) / (len(answers) + 2)
        return Model(vectors, np.zeros(width), np.ones(width), [], 1.0, float(share))
    return fit_network(np.array([row.features for row in rows]), answers, vectors)


def _scorer(model, text: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, text):
            score = pa.array(model.value.scores(texts), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, "score"])

    return run


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``score``: the calibrated probability of label 1 of each whole text.

    Null and empty texts are scored as texts without words. All other columns stay; one named
    ``score`` is replaced.
    """
    df = df.drop("score")
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])
    return df.mapInArrow(_scorer(df.sparkSession.sparkContext.broadcast(model), text_col), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether an id is kept from training: the CRC-32 of its digits is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document; labels of held-out ids are never read."""
    model = fit(documents, labels.where(~held_out()))
    return score(documents.select("doc_id", "text"), model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``documents``, all columns, with a score of at least ``threshold``."""
    model = fit(documents, labels.where(~held_out()))
    rows, (text_at,) = renamed(documents, "text")
    return score(rows, model, text_at).where(F.col("score") >= threshold).drop("score").toDF(*documents.columns)
