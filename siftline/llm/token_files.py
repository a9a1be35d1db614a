"""Token ids in files: frequency ranks in byte-aligned variable length, with separate control bytes.

A file is a sequence of blocks. A block is, all numbers little-endian:

    4 bytes  b"SLT1"
    uint32   documents d
    uint64   ids n
    uint64   data bytes b
    d bytes  1 where the document has an id, else 0
    d int64  document ids (0 where there is none)
    d uint32 ids of each document
    ceil(n/4) control bytes: two bits for each id, low bits first, its data bytes less one
    b data bytes: each id's frequency rank in its one to four low bytes

``ranks-*`` in the same folder holds, after b"SLT1", the token id of each rank as uint32, most frequent first.
The table ``manifest`` names the files, in the order of the documents.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer, pre_tokenizers

from siftline.llm.files import new_file, opened
from siftline.llm.slices import Table, gathered, held, list_array, text_slices
from siftline.session import drop_stored, stored

HEAD = struct.Struct("<4sIQQ")
MAGIC = b"SLT1"
#: Ids that a block is closed at, and that a file is planned for.
BLOCK_IDS, FILE_IDS = 1 << 20, 16_000_000
#: Distinct words that the table of one Python worker holds; characters that are tokenised at once.
TABLE_WORDS, CHARS = 1_500_000, 6_000_000

# Data bytes of the four ids of each control byte, and the bits that so many bytes can hold.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def packed(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = extra
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def unpacked(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` values behind ``packed``: lengths by table lookup, then one gather."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    padded = data + b"\0\0\0"
    at_each_byte = np.ndarray(len(data), "<u4", padded, strides=(1,))
    return at_each_byte[starts] & MASKS[lengths]


# --- tokenising ---------------------------------------------------------------------------------

# A word that ends in a letter or digit, before ASCII marks that end the chunk: the tokenizer cuts there too.
_MARKED = "(?s)^(?P<word>.*[A-Za-z0-9à-öø-ÿ])(?P<marks>[.,;:!?|*$%&#]+)$"
# A word that is one piece before the merges, whatever its text: small letters that nothing changes.
_ONE_PIECE = "^[a-zà-öø-ÿ]+$"


def _lowered(text: str) -> str:
    """The text with A-Z lower-cased, but where that could change ids: special tokens, parts that NFC would join."""
    low = text.encode().lower().decode()
    if "<|" in text:
        return text
    if text.isascii() or (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)):
        return low
    return text


class ChunkTable:
    """Ids of distinct words and marks between white space, each tokenised once by the library."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.wide = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.words_alone = words_stand_alone(self.tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.table = Table(self._encode, self.wide, TABLE_WORDS)
        # For words that are one piece: the same merges, without the normalising that leaves them as they are.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.tokenizer.encode(word, add_special_tokens=False).ids for word in words]
        return np.array([i for ids in found for i in ids], self.wide), np.array([len(ids) for ids in found], np.int64)

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words that are one piece each as one text: an id that ends a word is the last one of its piece."""
        [found] = self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(found.ids, self.wide)
        stops = np.nonzero(self.ends[ids])[0] + 1
        return (ids, np.diff(stops, prepend=0)) if len(stops) == len(words) else self._alone(words)

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        one_piece = compute.match_substring_regex(words, _ONE_PIECE).to_numpy(zero_copy_only=False)
        order = np.argsort(~one_piece, kind="stable")
        listed, plain = words.take(pa.array(order)).to_pylist(), int(one_piece.sum())
        parts = [self._together(listed[k : min(k + 300, plain)]) for k in range(0, plain, 300)]
        parts.append(self._alone(listed[plain:]))
        ids, sizes = (np.concatenate(column) for column in zip(*parts, strict=True))
        return gathered(ids, sizes, np.argsort(order))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, exactly the library's without special tokens, and the number of each text's.

        The texts are cut at ASCII white space, distinct chunks into a word and the marks behind it;
        distinct words are looked up, and their ids put back in the words' places.
        """
        if not self.words_alone:
            return self._alone(texts)
        lists = compute.ascii_split_whitespace(pa.array([_lowered(text) for text in texts], pa.large_string()))
        chunks = lists.flatten().dictionary_encode()
        cut = compute.extract_regex(chunks.dictionary, _MARKED)
        words = compute.coalesce(compute.struct_field(cut, "word"), chunks.dictionary).dictionary_encode()
        marks = compute.fill_null(compute.struct_field(cut, "marks"), "").dictionary_encode()
        distinct = pa.concat_arrays([words.dictionary, marks.dictionary]).dictionary_encode()
        place = self.table.places(distinct.dictionary)[distinct.indices.to_numpy()]
        two = np.stack([place[words.indices.to_numpy()], place[len(words.dictionary) + marks.indices.to_numpy()]], axis=1)
        which = two[chunks.indices.to_numpy()].ravel()
        ids, each = gathered(self.table.ids, self.table.sizes, which)
        upto = np.concatenate([[0], np.cumsum(each)])
        return ids, np.diff(upto[2 * lists.offsets.to_numpy()])


def words_stand_alone(tokenizer: Tokenizer) -> bool:
    """Whether texts may be cut at ASCII white space, and before ASCII marks at the end of a word.

    So it is for a tokenizer that lower-cases NFC text character by character, drops white space,
    and takes runs of letters, single digits and runs of other characters apart. Whole texts go to
    any other.
    """
    spec = json.loads(tokenizer.to_str())
    normalizer, splitter = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    kinds = [part["type"] for part in normalizer.get("normalizers", [])]
    splits = [part for part in splitter.get("pretokenizers", []) if part["type"] == "Split"]
    if kinds != ["NFC", "Replace", "Lowercase"] or len(splits) != 1 or not splits[0]["invert"]:
        return False
    pattern = splits[0]["pattern"].get("Regex", "")
    if splits[0]["behavior"] != "Removed" or not pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"):
        return False
    # What comes before that in the pattern begins with an apostrophe, at which no text is cut.
    return all(part[:1] == "'" for part in pattern.split("|")[:-3])


def _tokenise(path: str, end_id: int | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text", CHARS):
            table = held(f"chunks of {path}", lambda: ChunkTable(path))
            ids, sizes = table.encode_all(texts)
            if end_id is not None:
                ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
            width = table.wide.itemsize
            offsets = np.concatenate([[0], np.cumsum(sizes * width)]).astype(np.int32)
            column = pa.Array.from_buffers(
                pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))]
            )
            wide = pa.array(np.full(len(texts), width, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), wide, column], ["id", "wide", "ids"])

    return run


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch in a row, and the number of each document's."""
    column, wide = batch.column("ids"), batch.column("wide")[0].as_py()
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return flat.view(f"<u{wide}"), np.diff(offsets) // wide


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        counts = np.bincount(_numbers(batch)[0])
        size = max(len(total), len(counts))
        total = np.pad(total, (0, size - len(total))) + np.pad(counts, (0, size - len(counts)))
    some = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["token", "n"])


def _block(ids: np.ndarray, sizes: np.ndarray, docs: pa.Array) -> bytes:
    control, data = packed(ids)
    known = np.array([x is not None for x in docs.to_pylist()], np.uint8)
    numbers = np.array(docs.fill_null(0).to_pylist(), "<i8")
    head = HEAD.pack(MAGIC, len(sizes), len(ids), len(data))
    return head + known.tobytes() + numbers.tobytes() + sizes.astype("<u4").tobytes() + control + data


def _write(folder: str, rank_of: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, docs, ids = TaskContext.get().partitionId(), 0, 0
        with new_file(folder, f"part-{part:06d}") as (name, stream):
            for batch in batches:
                first = 0
                while first < batch.num_rows:  # blocks of about BLOCK_IDS ids, whole documents
                    rest = batch.slice(first)
                    numbers, sizes = _numbers(rest)
                    last = max(1, int(np.searchsorted(np.cumsum(sizes), BLOCK_IDS, "right")))
                    stop = int(sizes[:last].sum())
                    stream.write(_block(rank_of[numbers[:stop]], sizes[:last], rest.column("id").slice(0, last)))
                    docs, ids, first = docs + last, ids + stop, first + last
        row = {"part": [part], "file": [name], "docs": [docs], "ids": [ids]}
        yield pa.RecordBatch.from_pydict(
            row, pa.schema([("part", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
        )

    return run


def write_token_files(
    df: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int | None = None,
) -> None:
    """Tokenise every whole text and write the ids to files in ascending order of ``id_col``, null ids first.

    ``end_id``, if given, follows each document's ids. Texts are tokenised once, the ids kept in
    the shared folder; ranks come from the counts over all documents; rows are dealt to files by
    ranges of the id. Ties are in the order of their ids' bytes. Null and empty texts have no ids
    of their own. Other columns are not read. ``folder`` is new; ``tokenizer`` a file that every
    executor can open.
    """
    spark = df.sparkSession
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    tokens = stored(
        texts.mapInArrow(_tokenise(tokenizer, end_id), "id long, wide int, ids binary").withColumn(
            "tie", F.xxhash64("ids")
        ),
        "tokens",
    )
    counted = tokens.select("wide", "ids").mapInArrow(_count, "token long, n long")
    counts = counted.groupBy("token").agg(F.sum("n").alias("n")).collect()  # at most a row for each token there is
    ranked = np.array([r.token for r in sorted(counts, key=lambda r: (-r.n, r.token))], np.uint32)
    rank_of = np.zeros(int(ranked.max(initial=0)) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked))
    _write_ranks(folder, ranked)
    files = max(1, -(-sum(r.n for r in counts) // FILE_IDS))
    ordered = tokens.repartitionByRange(files, "id", "tie").sortWithinPartitions("id", "tie")
    ordered.select("id", "wide", "ids").mapInArrow(
        _write(folder, rank_of), "part long, file string, docs long, ids long"
    ).write.parquet(f"{folder}/manifest")
    drop_stored(tokens)


def _write_ranks(folder: str, ranked: np.ndarray) -> None:
    with new_file(folder, "ranks") as (_, stream):
        stream.write(MAGIC + ranked.astype("<u4").tobytes())


def _read(folder: str, ranked: np.ndarray, finish: Callable = lambda batch: batch) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for block in _blocks(f"{folder}/{row['file']}", row["start"], ranked):
                    yield finish(block)

    return run


def _blocks(uri: str, start: int, ranked: np.ndarray) -> Iterator[pa.RecordBatch]:
    with opened(uri) as stream:
        while head := stream.read(HEAD.size):
            magic, docs, count, size = HEAD.unpack(head)
            if magic != MAGIC:
                raise ValueError(f"{uri} is not a token file")
            known = np.frombuffer(stream.read(docs), np.uint8)
            numbers = np.frombuffer(stream.read(8 * docs), "<i8")
            sizes = np.frombuffer(stream.read(4 * docs), "<u4").astype(np.int64)
            control, data = stream.read(-(-count // 4)), stream.read(size)
            ids = ranked[unpacked(control, data, count)].astype("<i4")
            starts = start + np.cumsum(sizes) - sizes
            start += count
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, mask=known == 0), pa.array(starts), list_array(ids, sizes, pa.int32())],
                ["doc_id", "start", "ids"],
            )


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, start)``, dealt to a task each; starts come from the manifest alone."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    files = manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))).where("docs > 0")
    return files.select("file", "start").repartition(max(1, manifest.count()))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, ids array<int>)`` of every document: its ids, and the number of ids before it.

    Files are read apart, block by block.
    """
    run = _read(folder, _ranks(spark, folder))
    return _files(spark, folder).mapInArrow(run, "doc_id long, start long, ids array<int>")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of ``read_token_files``, ids as little-endian uint32, in one pass."""
    run = _read(folder, _ranks(spark, folder), _digest)
    return _files(spark, folder).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _ranks(spark: SparkSession, folder: str) -> np.ndarray:
    found = spark.read.format("binaryFile").load(f"{folder}/ranks-*").select("content").collect()
    return np.frombuffer(bytes(found[0].content), "<u4", offset=len(MAGIC))


def _digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids = [value.values.to_numpy().astype("<u4").tobytes() for value in batch.column("ids")]
    columns = [
        batch.column("doc_id"),
        batch.column("start"),
        pa.array([len(x) // 4 for x in ids], pa.int64()),
        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])
