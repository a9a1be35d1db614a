"""Substring dedup by seed and extend: winnowed anchors, leaders of their groups, matches extended both ways."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.columns import MOST_SENT, renamed
from siftline.llm.slices import list_array, text_slices
from siftline.llm.wordseq import Sequence, minimisers, mixed, word_hashes
from siftline.session import drop_stored, stored

#: Words of an anchor.
ANCHOR = 8
#: Seeds that one task extends, each of some hundred bytes.
ROWS_AT_ONCE = 60_000
#: Seeds of a text that are sent on together.
SEEDS_SENT = 20_000
#: A group is dealt to several tasks if it has more rows than this, or more than HOT_ROWS_FEW and HOT_SHARE of all.
HOT_ROWS, HOT_ROWS_FEW, HOT_SHARE = 200_000, 100, 1 / 2000
#: Documents with seeds, and their anchors, up to which both are sent to every executor.
SENT_TEXTS, SENT_ANCHORS = 200_000, 2_000_000
_NO_ID = (1 << 63) - 1
_LEFT, _RIGHT = np.uint64(0x632BE59BD9B4E019), np.uint64(0xD1B54A32D192ED03)


def _anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the anchor at each word, and for each window the word where its anchor begins.

    A window's anchor is its run of ANCHOR words with the smallest hash, the leftmost of equals: the
    same one, at the same place, wherever the window occurs.
    """
    size = min(ANCHOR, window)
    values = Sequence(hashes).runs(np.arange(len(hashes) - size + 1), size)
    return values, minimisers(values, window - size + 1)


def _scan(window: int) -> Callable:
    """Of each text: its words' number, the digest of its words, and its distinct anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text"):
            counts, digests, kept = [], [], []
            for text in texts:
                words = text.encode().split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found = np.zeros(0, np.int64)
                if len(words) >= window:
                    values, at = _anchors(word_hashes(words), window)
                    found = np.unique(values[np.unique(at)]).view(np.int64)
                kept.append(found)
            flat = np.concatenate([*kept, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("digest"), pa.array(counts, pa.int64()), pa.array(digests)]
                + [list_array(flat, [len(x) for x in kept], pa.int64())],
                ["doc", "digest", "n_words", "kept_sha256", "anchors"],
            )

    return run


def _seeds(window: int) -> Callable:
    """The seeds of each text at the anchors that other texts share.

    A seed is an anchor at word ``at`` with the windows it stands for, those with ``lo`` to ``hi``
    words before it, and the words around it: hashes of the ``hi`` words before, nearest first, and
    of the words from it on, as far as those windows go. Seeds of one text that agree in all this
    are one row with several places.
    """

    def rows(text: bytes, anchors: np.ndarray) -> list[tuple]:
        hashes = word_hashes(text.split())
        values, at = _anchors(hashes, window)
        cuts = np.nonzero(np.diff(at))[0] + 1
        firsts, lasts = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(at)]]) - 1
        place = at[firsts]
        alive = np.isin(values[place].view(np.int64), anchors)
        found: dict[tuple, list] = {}
        for p, first, last in zip(place[alive].tolist(), firsts[alive].tolist(), lasts[alive].tolist()):
            left, right = hashes[first:p][::-1].tobytes(), hashes[p : last + window].tobytes()
            found.setdefault((int(values[p].view(np.int64)), p - last, p - first, left, right), []).append(p)
        return [(*seed, places) for seed, places in found.items()]

    def made(batch: pa.RecordBatch, owners: list[int], seeds: list[tuple]) -> pa.RecordBatch:
        owner = pa.array(owners, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc").take(owner), batch.column("digest").take(owner)]
            + [pa.array([row[k] for row in seeds], field.type) for k, field in enumerate(_SEED)],
            ["doc", "digest", *(field.name for field in _SEED)],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text", 200_000):
            for k, (text, anchors) in enumerate(zip(texts, batch.column("anchors"))):
                some = rows(text.encode(), anchors.values.to_numpy())
                for first in range(0, len(some), SEEDS_SENT):
                    part = some[first : first + SEEDS_SENT]
                    yield made(batch, [k] * len(part), part)

    return run


_SEED = pa.schema(
    [("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("before", pa.binary()), ("behind", pa.binary()),
     ("places", pa.list_(pa.int32()))]
)
_SEED_SQL = "key long, lo int, hi int, before binary, behind binary, places array<int>"


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes in a binary column as rows of ``width``, and how many each row has."""
    sizes = compute.binary_length(column).to_numpy() // 8
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    out = np.zeros((len(column), width), np.uint64)
    out[np.arange(width) < sizes[:, None]] = np.frombuffer(flat.tobytes(), np.uint64)
    return out, sizes


def _shared(words: np.ndarray, sizes: np.ndarray, leader: np.ndarray) -> np.ndarray:
    """How many words, from the first on, each row shares with its leader's row."""
    differ = words != words[leader]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1])
    return np.minimum(first, np.minimum(sizes, sizes[leader]))


def _next(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return words[np.arange(len(at)), np.minimum(at, words.shape[1] - 1)] if words.shape[1] else np.zeros(len(at), np.uint64)


def _extend(window: int) -> Callable:
    """Compare each seed of sorted groups with the first one of its group, its leader, to the left and to the right.

    The windows inside the match are decided: they repeat the leader's document, unless it is the
    seed's own. The others go on: those that reach beyond the match on the left with the seeds that
    leave the leader there for the same word, and those that reach beyond it on the right only with
    the ones that leave it there. ``open`` rows are these; the others are found matches.
    """

    def compared(batch: pa.RecordBatch, leader: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
        lo, hi = (batch.column(name).to_numpy().astype(np.int64) for name in ("lo", "hi"))
        doc, key = batch.column("doc").to_numpy(), batch.column("key").to_numpy().view(np.uint64)
        before, n_before = _matrix(batch.column("before"), window)
        behind, n_behind = _matrix(batch.column("behind"), window)
        left, right = _shared(before, n_before, leader), _shared(behind, n_behind, leader)
        low, high = np.maximum(lo, window - right), np.minimum(hi, left)  # the windows inside the match
        real = np.arange(len(doc)) >= first
        found = (low <= high) & (doc != doc[leader]) & real
        yield _out(batch, found, False, low, high, key)
        beyond = np.maximum(lo, left + 1)
        word = _next(before, left)
        again = (beyond <= hi) & real
        yield _out(batch, again, True, beyond, hi, mixed(key ^ mixed(word + _LEFT + left.astype(np.uint64))))
        short = np.minimum(np.minimum(hi, left), window - right - 1)
        word = _next(behind, right)
        again = (lo <= short) & real
        yield _out(batch, again, True, lo, short, mixed(key ^ mixed(word + _RIGHT + right.astype(np.uint64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the leader of the group that is open
        for batch in batches:
            if not batch.num_rows:
                continue
            first = 0
            if held is not None:
                batch, first = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0], 1
            key, salt = batch.column("key").to_numpy(), batch.column("salt").to_numpy()
            begins = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
            leader = np.maximum.accumulate(np.where(begins, np.arange(len(key)), 0))
            held = batch.slice(int(leader[-1]), 1)
            yield from compared(batch, leader, first)

    return run


def _out(batch, rows, is_open, lo, hi, key) -> pa.RecordBatch:
    at = pa.array(np.nonzero(rows)[0])
    count = len(at)
    columns = {name: batch.column(name).take(at) for name in ("doc", "digest", "places")}
    empty = pa.array([b""] * count, pa.binary())
    return pa.RecordBatch.from_arrays(
        [columns["doc"], columns["digest"], pa.array(key[rows].view(np.int64)), pa.array(lo[rows].astype(np.int32)),
         pa.array(hi[rows].astype(np.int32)), batch.column("before").take(at) if is_open else empty,
         batch.column("behind").take(at) if is_open else empty, columns["places"], pa.array([is_open] * count, pa.bool_())],
        ["doc", "digest", "key", "lo", "hi", "before", "behind", "places", "open"],
    )


def _salted(rows: DataFrame, keys: DataFrame, total: int) -> DataFrame:
    """``rows`` with ``salt``: groups of very many rows are dealt to several tasks, each of which gets their leader.

    At most max(1 / HOT_SHARE, rows / HOT_ROWS) groups are that large, so their leaders can be sent.
    """
    limit = min(HOT_ROWS, max(HOT_ROWS_FEW, int(total * HOT_SHARE)))
    hot = keys.where(F.col("n") > limit)
    if not hot.count():
        return rows.withColumn("salt", F.lit(0))
    names = rows.columns
    salts = F.ceil(F.col("n") / limit).cast("int")
    hot = F.broadcast(hot.select("key", salts.alias("salts")))
    first = F.min_by(F.struct(*(n for n in names if n != "key")), F.struct("doc", "digest", "places", "lo"))
    leaders = rows.join(hot, "key").groupBy("key", "salts").agg(first.alias("first"))
    leaders = leaders.select(
        *(F.col(n) if n == "key" else F.col(f"first.{n}").alias(n) for n in names),
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
    )
    salt = F.pmod(F.xxhash64("doc", "digest", "places", "lo"), F.col("salts")).cast("int")
    dealt = rows.join(hot, "key", "left").withColumn("salt", F.coalesce(salt, F.lit(0))).drop("salts")
    return dealt.select(*names, "salt").unionByName(leaders.select(*names, "salt"))


def _matches(seeds: DataFrame, window: int) -> list[DataFrame]:
    """``(doc, digest, places, lo, hi)``: windows with lo to hi words before a place that an earlier document has.

    Rounds of ``_extend``: in each, a seed meets one leader, and its open windows go on in groups
    that share at least one word more. So there are at most two rounds a word, and few in practice.
    """
    matches, rows = [], seeds
    while True:
        # The open rows of groups within one document are decided: nothing earlier has their windows.
        keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b"))
        keys = stored(keys.where("a <> b").select("key", "n"), "groups")
        groups = keys.agg(F.count("*").alias("keys"), F.sum("n").alias("rows")).first()
        if not groups["keys"]:
            return matches
        if groups["keys"] <= MOST_SENT:
            rows = rows.join(F.broadcast(keys.select("key")), "key", "left_semi")
        parts = max(8, -(-groups["rows"] // ROWS_AT_ONCE))
        dealt = _salted(rows, keys, groups["rows"]).repartition(parts, "key", "salt")
        dealt = dealt.sortWithinPartitions("key", "salt", "doc", "digest", "places", "lo")
        done = stored(
            dealt.mapInArrow(_extend(window), f"doc long, digest binary, {_SEED_SQL}, open boolean"), "extended"
        )
        matches.append(done.where("NOT open").select("doc", "digest", "places", "lo", "hi"))
        rows = done.where("open").drop("open")
        drop_stored(keys)


def _stretches(window: int) -> Callable:
    """Union of the windows in each row's ``matches``, as ``(start, end)`` in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, starts, ends = [], [], []
            for row in batch.column("matches"):
                first, last = (column.to_numpy().astype(np.int64) for column in row.values.flatten())
                order = np.argsort(first, kind="stable")
                first, reach = first[order], np.maximum.accumulate(last[order] + window)
                new = np.concatenate([[True], first[1:] > reach[:-1]])
                starts.append(first[new])
                ends.append(reach[np.concatenate([np.nonzero(new)[0][1:] - 1, [len(reach) - 1]])])
                sizes.append(int(new.sum()))
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("digest"),
                 list_array(np.concatenate(starts + none), sizes, pa.int64()),
                 list_array(np.concatenate(ends + none), sizes, pa.int64())],
                ["doc", "digest", "starts", "ends"],
            )

    return run


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer column")
    return df.select(_doc(id_col).alias("doc"), _digest(text_col).alias("digest"), F.col(text_col).alias("text"))


def _doc(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))


def _digest(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def _of_text(texts: DataFrame, other: DataFrame, small: bool) -> DataFrame:
    other = other.withColumnsRenamed({"doc": "_doc", "digest": "_digest"})
    here = (F.col("doc") == F.col("_doc")) & (F.col("digest") == F.col("_digest"))
    return texts.join(F.broadcast(other) if small else other, here).drop("_doc", "_digest")


def _scanned(texts: DataFrame, window: int) -> DataFrame:
    kind = "doc long, digest binary, n_words long, kept_sha256 string, anchors array<long>"
    return stored(texts.mapInArrow(_scan(window), kind), "scanned")


def _looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined with a stored ``table`` (key, n, ...) of one row a key, n being its rows.

    A table that isn't small is shuffled, but for its hot keys, of which there are few: a key that
    a third of the rows have isn't one task's.
    """
    size = table.agg(F.count("*").alias("keys"), F.sum("n").alias("rows")).first()
    if size["keys"] <= MOST_SENT:
        return rows.join(F.broadcast(table.drop("n")), key, "left")
    limit = max(10_000, size["rows"] // 1000)
    hot = F.broadcast(table.where(F.col("n") > limit).drop("n"))
    others = rows.join(hot, key, "left_anti").join(table.where(F.col("n") <= limit).drop("n"), key, "left")
    return rows.join(hot, key).unionByName(others)


def _found(texts: DataFrame, scanned: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The stretches (doc, digest, starts, ends) of first texts; and (digest, n, first) of texts with copies."""
    long = scanned.where(F.col("n_words") >= window)
    # One row of each text goes on: that of the smallest document.
    firsts = stored(
        long.groupBy("digest").agg(
            F.min("doc").alias("doc"), F.count("*").alias("n"), F.first("anchors").alias("anchors")
        ),
        "firsts",
    )
    copied = firsts.where("n > 1").select("digest", "n", F.col("doc").alias("first"))
    each = firsts.select("doc", "digest", F.explode("anchors").alias("key"))
    keys = each.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b"))
    keys = stored(keys.where("a <> b").select("key", "n", F.lit(True).alias("alive")), "anchors")
    alive = _looked_up(each, keys, "key").where("alive").groupBy("doc", "digest")
    alive = stored(alive.agg(F.collect_list("key").alias("anchors")), "seeded")
    size = alive.agg(F.count("*").alias("texts"), F.sum(F.size("anchors")).alias("anchors")).first()
    small = size["texts"] <= SENT_TEXTS and (size["anchors"] or 0) <= SENT_ANCHORS
    seeded = _of_text(texts, alive, small).select("doc", "digest", "text", "anchors")
    kind = f"doc long, digest binary, {_SEED_SQL}"
    # Rows that repeat an id and a text give equal seeds, which are found again for each of them.
    seeds = stored(seeded.mapInArrow(_seeds(window), kind), "seeds")
    matches = _matches(seeds, window)
    kind = "doc long, digest binary, starts array<long>, ends array<long>"
    if not matches:
        return texts.sparkSession.createDataFrame([], kind), copied
    every = matches[0]
    for other in matches[1:]:
        every = every.unionByName(other)
    place = every.select("doc", "digest", F.explode("places").alias("place"), "lo", "hi")
    match = F.struct((F.col("place") - F.col("hi")).alias("first"), (F.col("place") - F.col("lo")).alias("last"))
    spans = place.groupBy("doc", "digest").agg(F.collect_set(match).alias("matches"))
    return stored(spans.mapInArrow(_stretches(window), kind), "stretches"), copied


def _kept(with_text: bool) -> Callable:
    """The words of each text outside its stretches: how many are gone, the digest of the others or themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text"):
            removed, kept = [], []
            for text, starts, ends in zip(texts, batch.column("starts"), batch.column("ends")):
                words = text.encode().split()
                at, left, gone = 0, [], 0
                for start, end in zip(starts.as_py(), ends.as_py()):
                    left += words[at:start]
                    at, gone = end, gone + end - start
                left = b" ".join(left + words[at:])
                removed.append(gone)
                kept.append(left.decode() if with_text else hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("digest"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc", "digest", "n_removed", "kept"],
            )

    return run


def _cut(texts: DataFrame, stretches: DataFrame, with_text: bool) -> DataFrame:
    """``(doc, digest, n_removed, kept)`` of the texts that have stretches."""
    size = stretches.agg(F.count("*").alias("texts"), F.sum(F.size("starts")).alias("spans")).first()
    small = size["texts"] <= SENT_TEXTS and (size["spans"] or 0) <= SENT_ANCHORS
    cut = _of_text(texts, stretches, small).select("doc", "digest", "text", "starts", "ends")
    cut = cut.mapInArrow(_kept(with_text), "doc long, digest binary, n_removed long, kept string")
    return stored(cut, "cut").dropDuplicates(["doc", "digest"])


def repeated_stretches(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50
) -> DataFrame:
    """``(id, start, end)``: the maximal stretches of words, ``end`` excluded, of which each window is in an earlier document.

    See ``kept_digests`` for what repeats; a stretch is a union of windows that overlap or touch.
    """
    texts = _texts(df, id_col, text_col)
    scanned = _scanned(texts, window)
    stretches, copied = _found(texts, scanned, window)
    span = F.explode(F.arrays_zip("starts", "ends")).alias("span")
    found = scanned.select("doc", "digest").join(stretches, ["doc", "digest"])
    found = found.select("doc", span).select("doc", F.col("span.starts").alias("start"), F.col("span.ends").alias("end"))
    whole = _looked_up(scanned.drop("anchors", "kept_sha256"), copied, "digest").where("doc > first")
    whole = whole.select("doc", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))
    return found.unionByName(whole).select(_id(df, id_col), "start", "end").distinct()


def _id(df: DataFrame, id_col: str) -> Column:
    return F.when(F.col("doc") != _NO_ID, F.col("doc")).cast(df.schema[id_col].dataType).alias(id_col)


def kept_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256)`` for every row, all words of repeated windows being removed.

    Words are runs of characters other than ASCII white space, unchanged. A window is ``window``
    consecutive words of one document; it repeats if a document with a smaller id has the same
    words in a row. ``kept_sha256`` is the digest of the words outside such windows, one blank between.

    Every text is cut into its anchors, runs of eight words that winnowing selects, one for each
    window and the same in all its copies. Documents meet on anchors that several of them have,
    as seeds with the words around them. Seeds of an anchor are compared with the first of them, to
    the left and to the right; those that go beyond the match meet again in groups by the word at
    which they leave it. No pairs are listed, and each window is decided against the first document
    that has it. Found matches are joined to maximal stretches.

    Null and empty texts have no words, and texts with fewer words than a window lose none. Equal
    texts are searched once; all but those of the smallest id lose every word if they are long
    enough. A null id counts as larger than any other; rows that share an id are one document and take
    nothing from each other, though each row is decided by its own text. The id column must be an
    integer. Empty tables give no rows. Other columns are not read.
    """
    texts = _texts(df, id_col, text_col)
    scanned = _scanned(texts, window)
    stretches, copied = _found(texts, scanned, window)
    rows = _looked_up(scanned.drop("anchors"), copied, "digest")
    cut = _cut(texts, stretches, with_text=False)
    rows = rows.join(cut, ["doc", "digest"], "left")
    copy = F.coalesce(F.col("doc") > F.col("first"), F.lit(False))
    return rows.select(
        _id(df, id_col),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "kept_sha256")).alias("kept_sha256"),
    )


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """``df`` with the words of repeated windows removed; a changed text has one blank between its words.

    All rows and columns stay, and other texts are untouched. See ``kept_digests``.
    """
    rows, (id_at, text_at) = renamed(df, id_col, text_col)
    texts = _texts(rows, id_at, text_at)
    scanned = _scanned(texts, window)
    stretches, copied = _found(texts, scanned, window)
    keyed = rows.withColumn("doc", _doc(id_at)).withColumn("digest", _digest(text_at))
    found = _looked_up(keyed, copied, "digest").join(_cut(texts, stretches, with_text=True), ["doc", "digest"], "left")
    text = F.when(F.col("doc") > F.col("first"), F.lit("")).otherwise(F.coalesce("kept", text_at))
    return found.withColumn(text_at, text).select(*rows.columns).toDF(*df.columns)
