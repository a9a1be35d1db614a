"""Repeated passages, licences, quality, tokenizers, shards and archives against brute force, round trips and labels."""

import gzip
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftline.llm import licences, pieces, quality, shards, slices, suffixes, token_files, warc
from siftline.session import new_path

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
STRANGE = [
    "", " ", "  ", "a", " a", "a ", "a  b   c    ", "▁a▁▁b", "\n\n", "\t x\r\ny", "x\x00y\x1cz", "é é ẖ H̱ ́q",
    "ΑΣ ΌΣΟΣ. İstanbul ǅ ﬁ", "don't DON'T we'll. 'S", "a,b;c.. d!? e.́ f…! g!😀", "12.5 ½ ٣٤ Ⅷ, x_1.", "<|endoftext|> <|ENDOFTEXT|>",
    "<s> </s> <0x41> <unk>", "日本語、テスト。 中文", " 　 \u0085\x0b\x0c end", "A.B.C. U.S.A.,", "word|word | $5.00# %&*", "‍​ x﻿",
]


def shuffled_text(seed):
    chosen = random.Random(seed)
    parts = [*STRANGE, "The", "the,", "THE!", " ", "  ", "\n", ".", "'", "é", "́", "lon" * 40]
    return "".join(chosen.choice(parts) + chosen.choice(["", " ", " ", ". "]) for _ in range(60))


def texts_frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# --- repeated passages ---------------------------------------------------------------------------


def slow_stretches(rows, size):
    """``rows``: (id, text) with distinct ids that are not null."""
    first, texts = {}, {}
    for k, text in sorted(rows):
        words = (text or "").encode().split()
        for i in range(len(words) - size + 1):
            first.setdefault(tuple(words[i : i + size]), k)
        texts.setdefault(text, k)
    out = set()
    for k, text in rows:
        words = (text or "").encode().split()
        spans = []
        for i in range(len(words) - size + 1):
            owner = first[tuple(words[i : i + size])]
            if owner != k:
                if spans and i <= spans[-1][1]:
                    spans[-1] = [spans[-1][0], i + size, min(spans[-1][2], owner)]
                else:
                    spans.append([i, i + size, owner])
        out |= {(k, b - a, owner if texts[text] == k else texts[text]) for a, b, owner in spans}
    return out


@pytest.mark.parametrize("sorted_rows", [1_000_000, 60])
@pytest.mark.parametrize("size", [5, 12])
def test_stretches_equal_brute_force(spark, monkeypatch, size, sorted_rows):
    monkeypatch.setattr(suffixes, "SORTED_ROWS", sorted_rows)
    chosen = random.Random(size)
    shared = [[f"w{chosen.randrange(9)}" for _ in range(chosen.randrange(3, 40))] for _ in range(8)]
    rows = []
    for k in range(40):
        words = []
        for _ in range(chosen.randrange(1, 5)):
            words += chosen.choice(shared) if chosen.random() < 0.6 else [f"u{chosen.randrange(10**6)}" for _ in range(20)]
        rows.append((k, chosen.choice([" ", "\n", " \t"]).join(words)))
    rows += [(k + 100, rows[k][1]) for k in range(0, 40, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffixes.repeated_passages(df, passage=size).collect()
    text = dict(rows)
    assert {(r.doc_id, len(text[r.doc_id][r.start : r.end].split()), r.first_doc_id) for r in found} == slow_stretches(rows, size)
    assert all(r.n_words == len(text[r.doc_id][r.start : r.end].split()) for r in found) and len(found) > 10
    cut = suffixes.without_repeats(df, passage=size)
    # What stays has no passage that another text has, but for one that the cut itself has joined.
    assert cut.columns == df.columns and cut.count() == df.count()


def test_repeats_of_odd_rows(spark, odd, nothing, prose):
    found = sorted(map(str, (tuple(r) for r in suffixes.repeated_passages(odd).collect())))
    long, both = prose(1, 30_000), len(prose(5, 30)) + 1
    want = [
        (2, 0, len(prose(2, 120)), 120, 1), (None, 0, len(prose(2, 120)), 120, 1), (12, 0, len(long), 30_000, 6),
        (11, both, both + len(prose(4, 70)), 70, 10),
    ]
    assert found == sorted(map(str, want))
    with_length = odd.withColumn("n_chars", F.length("text"))
    out = suffixes.without_repeats(with_length)
    assert out.columns == with_length.columns and out.count() == odd.count()
    by_id = {r.doc_id: r for r in out.where("doc_id IN (1, 6, 8, 10, 11, 12)").collect()}
    assert by_id[12].text == " end" and by_id[12].n_chars == 4 and by_id[11].text == prose(5, 30) + " "
    assert by_id[6].text == long and by_id[1].text == prose(2, 120)
    assert suffixes.repeated_passages(nothing).count() == suffixes.without_repeats(nothing).count() == 0


# --- licences ------------------------------------------------------------------------------------


def test_licence_rules_in_order_with_gaps_and_cover(spark, nothing):
    s = licences.SENTENCES
    mit = f"{s['mit-grant']}\n\n{s['mit-notice']}"
    apache = "\n".join(s[k] for k in licences.RULES["apache-2.0-header"][1])
    texts = {
        1: f"Foo.\n{mit}\nBar.", 2: f"{s['mit-notice']}\n{s['mit-grant']}", 3: apache.upper(), 4: "released  under the MIT license",
        5: f"{s['mit-grant']}\nx\ny\nz\n{s['mit-notice']}", 6: f"{s['mit-grant']}\nx\n{s['mit-notice']}", 7: None, 8: "",
        9: f"{s['mit-line']} {s['gpl-3-line']} text {s['mit-line']}", 10: "Licensed under the Apache License",
        11: "\n".join(s[k] for k in ("bsd-grant", "bsd-source", "bsd-binary")), 12: f"{s['apache-notice']}\n{s['apache-comply']}\nother",
    }
    rows = [(k, t, 1) for k, t in texts.items()]
    df = spark.createDataFrame([*rows, rows[0], (None, s["mit-line"], 1)], "doc_id long, text string, at int")
    got = {(r.doc_id, r.rule) for r in licences.found_licences(df).collect()}
    assert got == {
        (1, "mit-text"), (3, "apache-2.0-header"), (4, "mit-line"), (6, "mit-text"), (9, "mit-line"), (9, "gpl-3.0-line"),
        (11, "bsd-2-clause"), (12, "apache-2.0-notice"), (None, "mit-line"),
    }
    assert licences.found_licences(df).where("doc_id = 9").count() == 2
    assert licences.found_licences(nothing).count() == 0


WRAPPED = {
    "mit-text": """MIT License
Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""",
    "isc": """Copyright (c) 2020, Somebody
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
""",
}


def test_licences_of_wrapped_and_commented_texts(spark):
    apache = "\n#\n# http://www.apache.org/licenses/LICENSE-2.0\n#\n# ".join(
        "\n# ".join(licences.SENTENCES[k] for k in part)
        for part in (("apache-notice", "apache-comply", "apache-copy"), ("apache-as-is", "apache-see"))
    )
    texts, expected = [(f"# {apache}\n",)], ["apache-2.0-header"]
    for rule, text in WRAPPED.items():
        for mark in ("", "# ", " * ", "// ", "-- ", ";; ", "dnl "):
            lines = "".join(f"{mark}{line}".rstrip() + "\n" for line in text.splitlines())
            texts += [(f"/*\n{lines} */\ncode()\n",), (lines.replace("\n", "\r\n"),)]
            expected += [rule] * 2
    grant = licences.SENTENCES["isc-grant"]
    texts += [(grant.replace("for any purpose", "\n\nfor any purpose"),), (grant.replace("fee", "fee.\n"),), ("x " + grant,)]
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(texts)], "doc_id long, text string")
    found = licences.found_licences(df).collect()
    assert sorted((r.doc_id, r.rule) for r in found) == list(enumerate(expected))
    places = {r.doc_id: (r.first_sentence, r.last_sentence) for r in found}
    assert places[2] == (2, 9)


def test_every_licence_rule_matches_its_own_sentences(spark):
    expected = dict(enumerate(licences.RULES))
    whole = {k: [licences.SENTENCES[s] for s in licences.RULES[rule][1]] for k, rule in expected.items()}
    rows = [(k + 100 * kind, joint.join(parts)) for k, parts in whole.items() for kind, joint in enumerate(("\n", "\n\n"))]
    for k, parts in whole.items():  # a sentence without a mark at its end needs a paragraph's end
        one = "".join(part + (" " if part[-1] in ".;:" else "\n#\n") for part in parts)
        rows += [(k + 200, one), (k + 300, re.sub(r"(.{40,60}) ", r"\1\n# ", one))]
    rows += [(1000, "This program is free software:\nnot so"), (1001, "2.0\n" + licences.SENTENCES["mit-line"] + " 2.0")]
    found = licences.found_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.rule) for r in found) == sorted(
        [(k + 100 * kind, rule) for k, rule in expected.items() for kind in range(4)] + [(1001, "mit-line")]
    )


# --- quality -------------------------------------------------------------------------------------


def test_held_out_accuracy_and_odd_rows(spark, odd, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    good, poor = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    above = np.mean([[g > p for p in poor] for g in good])
    assert right > 0.9 and above > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    model = quality.fit(docs, labels)
    scored = quality.score(odd, model)
    assert scored.count() == odd.count() and scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.score(nothing, model).count() == 0
    assert quality.accepted(odd, labels).columns == odd.columns


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted(quality.quality_scores(docs, x).collect()) for x in (labels, other))
    assert one == two
    alone = quality.quality_scores(docs, labels.where("quality = 1"))
    assert alone.select("score").distinct().count() == 1
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_rows_that_share_a_labelled_id_stay_within_the_sample(spark, prose, monkeypatch):
    rows = [(k, prose(k, 30)) for k in range(30)] + [(7, prose(0, 30))] * 20 + [(7, prose(100 + k, 9)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] * 2, "doc_id long, quality int")
    fitted = []
    monkeypatch.setattr(quality, "fit_network", lambda features, labels, vectors: fitted.append((features, labels)))
    for sample in (1000, 25):
        quality.fit(docs, labels, sample=sample)
    assert [len(found) for _, found in fitted] == [71, 25]


def test_temperature_suits_the_rows_it_was_set_on():
    chosen = np.random.default_rng(0)
    features = chosen.normal(size=(600, 5))
    answers = (chosen.random(600) < 1 / (1 + np.exp(-2 * features[:, 0]))).astype(float)
    model = quality.fit_network(features, answers, np.zeros((1, 1)))
    held = np.random.default_rng(7).permutation(600)[:120]
    logits = model.logits(features[held])
    assert quality._loss(logits / model.temperature, answers[held]) <= quality._loss(logits, answers[held])


def test_pooling_holds_few_vectors_and_words_at_a_time(prose):
    import tracemalloc

    texts, vectors = [prose(k, 1500) for k in range(170)], np.ones((quality.ROWS, quality.DIMS), np.float32)
    tracemalloc.start()
    features = quality.pooled(texts, vectors)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6  # the vectors of all words alone take 33 MB
    assert np.allclose(features[:, : quality.DIMS], 1) and np.allclose(features[:, -1], np.log1p(1500))


def test_pooling_in_pieces_gives_what_one_piece_gives(prose, monkeypatch):
    texts = ["", prose(1, 900), "one", prose(2, 700), " ", prose(3, 5)]
    vectors = np.random.default_rng(3).normal(size=(quality.ROWS, quality.DIMS)).astype(np.float32)
    found = []
    for together, pairs in ((quality.DIMS, 1 << 20), (8, 7), (5, 1)):
        monkeypatch.setattr(quality, "TOGETHER", together)
        monkeypatch.setattr(quality, "PAIRS", pairs)
        found.append(quality.pooled(texts, vectors))
    assert np.allclose(found[0], found[1]) and np.allclose(found[0], found[2])


def test_workers_get_long_texts_in_batches_of_few_bytes(spark):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"bytes": pa.array([batch.nbytes], pa.int64()), "n": pa.array([batch.num_rows], pa.int64())})

    for asked, most in ((None, 2.5e6), ("1m", 1.5e6)):  # what a session asks for holds
        session = spark.newSession()
        if asked:
            session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", asked)
        slices.ready(session)
        texts = session.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 50_000).alias("text"))
        rows = texts.mapInArrow(sizes, "bytes long, n long").collect()
        assert sum(r.n for r in rows) == 300 and max(r.bytes for r in rows) < most


# --- pieces and token files ----------------------------------------------------------------------


def test_pieces_equal_the_library(spark, odd, nothing):
    texts = [*STRANGE, *map(shuffled_text, range(60)), None]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert pieces.words_stand_alone(PIECES)
    for row in pieces.round_trip(texts_frame(spark, texts), PIECES).collect():
        ids = model.encode(texts[row.doc_id] or "")
        assert list(row.ids) == ids and row.decoded == model.decode(ids)
    apart = pieces.decode_ids(pieces.encode_texts(texts_frame(spark, texts), PIECES), PIECES)
    assert apart.exceptAll(pieces.round_trip(texts_frame(spark, texts), PIECES)).count() == 0
    out = pieces.round_trip(odd, PIECES)
    assert out.columns == [*odd.columns, "ids", "decoded"] and out.count() == odd.count()
    assert pieces.digests(nothing, PIECES).count() == 0


def test_full_word_table_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_WORDS", 3)
    monkeypatch.setattr(slices, "_HELD", {})
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in ("a b c d e", "c d x y", "a a a", "", *map(shuffled_text, range(9))):
        ids, sizes = pieces.encode_all([text, "b", text], PIECES)
        alone = model.encode(text)
        assert ids.tolist() == [*alone, *model.encode("b"), *alone] and sizes[0] == sizes[2] == len(alone)


def test_packed_values_come_back():
    chosen = np.random.default_rng(1)
    for count in (0, 1, 3, 4, 1001):
        values = (chosen.integers(0, 1 << 32, count) >> chosen.integers(0, 32, count)).astype(np.uint32)
        control, data = token_files.packed(values)
        assert token_files.unpacked(control, data, count).tolist() == values.tolist()
        assert len(control) == -(-count // 4)


def test_chunks_equal_the_library():
    tokenizer, table = Tokenizer.from_file(WORDS), token_files.ChunkTable(WORDS)
    assert table.words_alone
    texts = [*STRANGE, *map(shuffled_text, range(300))]
    ids, sizes = table.encode_all(texts)
    for text, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert own.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_full_chunk_tables_change_nothing(monkeypatch):
    monkeypatch.setattr(token_files, "TABLE_WORDS", 3)
    tokenizer, table = Tokenizer.from_file(WORDS), token_files.ChunkTable(WORDS)
    for text in map(shuffled_text, range(20)):
        assert table.encode_all([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, monkeypatch, nothing):
    texts = [*STRANGE, None, *map(shuffled_text, range(40))]
    tokenizer = Tokenizer.from_file(WORDS)
    rows = [(7 * k % 1000, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (None, "no id"), rows[3]], "doc_id long, text string")
    want = sorted([*rows, rows[3], (None, "no id")], key=lambda r: -1 if r[0] is None else r[0])
    monkeypatch.setattr(token_files, "FILE_IDS", 1500)
    folder = new_path(spark, "tokens")
    token_files.write_token_files(df, WORDS, folder, end_id=1)
    assert spark.read.parquet(f"{folder}/manifest").count() > 3
    found = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [k for k, _ in want]
    start = 0
    for row, (_, text) in zip(found, want, strict=True):
        assert row.start == start and list(row.ids) == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        start += len(row.ids)
    folder = new_path(spark, "tokens")
    token_files.write_token_files(nothing, WORDS, folder)
    assert token_files.read_token_files(spark, folder).count() == 0


# --- shards --------------------------------------------------------------------------------------


def test_longest_first_takes_the_least_loaded_shard():
    assert shards.longest_first([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}


@given(
    st.lists(st.integers(0, 300), min_size=1, max_size=7),
    st.lists(st.tuples(st.integers(0, 90), st.integers(1, 60)), max_size=6),
)
def test_loads_after_a_run_of_equal_sizes_are_those_of_the_heap(loads, runs):
    placed, slow, fast = shards._least_loaded(loads, *zip(*runs)) if runs else [], list(loads), np.array(loads)
    for shard, size in zip(placed, [size for size, count in runs for _ in range(count)], strict=True):
        slow[shard] += size
    for size, count in runs:
        fast = shards.loads_after(fast, size, count)
    assert fast.tolist() == slow


def test_blocks_of_groups_go_where_one_heap_puts_them(spark, monkeypatch):
    monkeypatch.setattr(shards, "GROUPS_AT_ONCE", 7)
    sizes = [(f"g{k:03}", 10 if k % 3 else 11 + k % 5) for k in range(200)] + [("huge", 5000)]  # most of one size
    frame = spark.createDataFrame(sizes, "group string, size long")
    found = {r.group: r.shard for r in shards.shards_of_groups(frame, 6).collect()}
    assert found == shards.longest_first(sizes, 6)


@pytest.mark.parametrize("at_once", [1 << 17, 50])
def test_shards_are_whole_and_even(spark, monkeypatch, at_once):
    monkeypatch.setattr(shards, "GROUPS_AT_ONCE", at_once)
    monkeypatch.setattr(shards, "ROWS_AT_ONCE", 300)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = shards.shard_texts(docs, shards=5).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    of_text, load = {}, [0] * 5
    for r in rows:
        assert r["size"] == len(r.text.encode()) + 16 and r.text_crc32 == zlib.crc32(r.text.encode())
        assert of_text.setdefault(r.text, r.shard) == r.shard
        load[r.shard] += r["size"]
    for k in range(5):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert max(load) - min(load) < 0.01 * sum(load) / 5


def test_shards_of_odd_rows(spark, odd, nothing):
    rows = shards.shard_texts(odd).collect()
    assert len(rows) == odd.count() and sum(r["size"] == 16 for r in rows) == 3
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert shards.shard_texts(nothing).count() == 0


# --- archives ------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_archives_round_trip_with_records_inside_payloads(spark, block):
    inner = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    nasty = [
        None, b"", b"plain", inner, b"\r\n\r\n" + inner * 3, b"\r\n\r\nWARC/1.0\r\n\r\n", b"x" * 5000, bytes(range(256)) * 3,
        b"\r\n\r\n" + inner[:-4] + inner, b"\r\n\r\nWARC/1.1\r\nContent-Length: 99999999\r\n\r\n", b"\r\n\r\n", gzip.compress(b"z" * 999),
        b"\r\n\r\nWARC/1.1\r\nContent-Length: 300\r\n\r\n" + b"y" * 900,
    ]
    rows = [(k, f"http://x/{k}\r\nEvil: 1", p, "w") for k, p in enumerate(nasty * 3)] + [(None, None, b"no id", "w")]
    df = spark.createDataFrame(rows, "page_id long, url string, body binary, payload string").repartition(3)
    folder = new_path(spark, "archives")
    warc.write_archives(df, folder, "page_id", "url", "body")
    found = warc.read_archives(spark, folder, block).collect()
    got = sorted((r.record_id, bytes(r.payload)) for r in found)
    assert got == sorted((f"<urn:record:{'' if k is None else k}>", p or b"") for k, _, p, _ in rows)
    assert len({(r.archive, r.offset) for r in found}) == len(rows) and {r.warc_type for r in found} == {"response"}
    assert warc.candidates(spark, folder, block).count() > len(rows)


def test_damaged_archive_is_an_error(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nrubbish")
    with pytest.raises(ValueError, match="don't reach the end"):
        warc.read_archives(spark, str(tmp_path))


def test_page_records_with_nulls_copies_and_no_rows(spark):
    big = "é" * 60
    rows = [(3, "u", big), (1, "u", big), (None, None, big), (2, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (1, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(str, ((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_records(df, new_path(spark, "w")).collect())))
    want = [
        (3, 120, "revisit", 1), (1, 120, "response", None), (1, 120, "response", None), (None, 120, "revisit", 1), (2, 0, "response", None),
        (4, 0, "response", None), (5, 5, "response", None), (6, 5, "response", None),
    ]
    assert got == sorted(map(str, want))
    assert warc.page_records(df.limit(0), new_path(spark, "w")).count() == 0
