"""What op6, op7 and op9 return, against the libraries and a slow schedule."""

import hashlib
import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from siftline.llm import pieces, shards, token_files
from siftline.llm.queries import QUERIES


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op7_returns_the_librarys_digests(spark, sf_dir, documents):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = set()
    for r in documents.collect():
        ids = model.encode(r.text or "", num_threads=1)
        expected.add((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))))
    out = QUERIES["op7_pieces"](spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {tuple(r) for r in out.collect()} == expected


def test_digests_of_odd_rows(spark, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    expected = Counter()
    for r in odd.collect():
        ids = model.encode(r.text or "", num_threads=1)
        expected[r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))] += 1
    assert Counter(map(tuple, pieces.digests(odd, path).collect())) == expected


def slow_token_rows(rows):
    """``(doc_id, start, n_tokens, ids_crc32)`` of rows with an id, by falling ids of documents with equal ids apart."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, start = [], 0
    for key, text in sorted(rows):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_op9_returns_what_the_library_encodes(spark, sf_dir, documents):
    out = QUERIES["op9_token_files"](spark, sf_dir)
    assert sorted(map(tuple, out.collect())) == slow_token_rows([(r.doc_id, r.text) for r in documents.collect()])


def test_token_files_of_rows_with_clashing_columns_and_a_long_text(spark, odd, tmp_path):
    """Ids once each: the odd rows' long and blank texts, nulls and clashing names; the order of equal ids is free."""
    rows = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    frame = spark.createDataFrame(
        [(k, t, 1, 2, 3) for k, t in rows.items()], "doc_id long, text string, start int, ids int, part int"
    )
    path = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_token_files(frame, path, f"file://{tmp_path}/t", end_id=1)
    found = sorted(map(tuple, token_files.read_digests(spark, f"file://{tmp_path}/t").collect()))
    assert found == slow_token_rows(list(rows.items()))


def slow_schedule(texts, count):
    """Shard of each distinct text: groups by falling size, ties by digest, to the least load, ties to the lower shard."""
    sizes = Counter()
    for text in texts:
        sizes[text or ""] += len((text or "").encode()) + 16
    heap, placed = [(0, shard) for shard in range(count)], {}
    for text, size in sorted(sizes.items(), key=lambda item: (-item[1], sha(item[0]))):
        load, shard = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, shard))
        placed[text] = shard
    return placed


def test_op6_equals_a_slow_schedule(spark, sf_dir, documents):
    rows = {r.doc_id: r.text for r in documents.collect()}
    placed, slots = slow_schedule(rows.values(), 40), defaultdict(list)
    for r in QUERIES["op6_shards"](spark, sf_dir).collect():
        raw = (rows[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        assert r.shard == placed[rows[r.doc_id] or ""]
        slots[r.shard].append(r.slot)
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())


def test_one_text_that_a_third_of_the_rows_have_is_one_group(spark, prose):
    rows = [(k, prose(k, 30)) for k in range(60)] + [(k, prose(0, 30)) for k in range(60, 90)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.shard for r in shards.shard_texts(frame, shards=5).collect()}
    placed = slow_schedule([t for _, t in rows], 5)
    assert found == {k: placed[t] for k, t in rows}
