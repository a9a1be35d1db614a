"""Merkle manifest, importance resampling and substring dedup against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import merkle, resampling, seeds
from siftline.llm.crc import BLOCK, crc32_of_spans
from siftline.llm.ranks import ranked

EMPTY = hashlib.sha256(b"").hexdigest()


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- ranks ---


def test_ranks_are_gapless_over_several_parts(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 1000, 1, 7).select((F.col("id") % 10).alias("a"), "id")
    rows = ranked(df, F.col("a").desc(), F.col("id"), per_part=90).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r._rank)] == sorted(range(1000), key=lambda k: (-(k % 10), k))
    assert sorted(r._rank for r in rows) == list(range(1000)) and len({r._part for r in rows}) > 3


# --- Merkle manifest ---


def slow_levels(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def slow_proof(levels, at, arity):
    out = []
    for level in levels[:-1]:
        run = at // arity * arity
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + arity])))
        at //= arity
    return out


def slow_manifest(rows, arity=2):
    """Rows (doc_id, source, lang, n_chars, text), sorted; a list of the manifest's rows."""

    def leaf(row, more=0):
        values = [*row[:3], None if row[3] is None else row[3] + more, row[4]]
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    first = lambda value: (value is not None, value if value is not None else 0)
    langs = sorted({r[2] for r in rows}, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = [sorted((r for r in rows if r[2] == lang), key=lambda r: (first(r[0]), leaf(r))) for lang in langs]
    levels = [slow_levels([leaf(r) for r in tree], arity) for tree in trees]
    top = slow_levels([level[-1][0] for level in levels], arity)
    out = []
    for t, tree in enumerate(trees):
        for k, row in enumerate(tree):
            proof = slow_proof(levels[t], k, arity) + slow_proof(top, t, arity)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = leaf(row, int(hit))
            for before, after in proof:
                node = sha(before, node, after)
            digest = sha(*(b + a for b, a in proof))
            out.append((row[0], leaf(row), levels[t][-1][0], top[-1][0], digest, node, node == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, tree string, node int, idx int"


def some_rows(count, seed=1):
    chosen = random.Random(seed)
    rows = []
    for k in range(count):
        lang = chosen.choice(["en"] * 6 + ["de", None, "é", ""])
        text = chosen.choice([None, "", "x" * 10_000, f"text {k} ü", "same"])
        rows.append((k, chosen.choice([None, "s", "-", "1:s"]), lang, chosen.choice([None, k, 5]), text))
    rows += [(None, "s", "en", 1, "a"), (None, "s", None, 1, "a"), (3, "t", "en", 1, "a"), (9, "s", "zz", 2, "alone")]
    return rows + rows[:2]  # repeated rows


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_equals_slow_trees(spark, arity):
    rows = some_rows(45)
    df = spark.createDataFrame([(*r, 1, "t", 2, 3) for r in rows], SCHEMA)
    out = merkle.manifest(df, arity=arity)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got, expected = Counter(map(tuple, out.collect())), Counter(slow_manifest(rows, arity))
    assert got == expected
    assert any(not row[-1] for row in got) and any(row[-1] for row in got)


def test_manifest_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(1, None, None, None, None, 1, "t", 2, 3)], SCHEMA)
    row = merkle.manifest(one).first()
    assert row.leaf == row.subroot == row.root == sha("1:1----") and row.proof_sha256 == EMPTY and row.verified
    assert merkle.manifest(one.limit(0)).collect() == []


def test_manifest_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(*r, 1, "t", 2, 3) for r in some_rows(14)], SCHEMA)
    assert Counter(merkle.manifest(df.repartition(7)).collect()) == Counter(merkle.manifest(df.coalesce(1)).collect())


def test_tampering_is_found_by_the_count_alone(spark):
    rows = [(k, "s", "en", 10, "t", 1, "t", 2, 3) for k in range(40)]
    found = {r.doc_id: r.verified for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {k: zlib.crc32(str(k).encode()) % 7 != 0 for k in range(40)}


# --- importance resampling ---


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600), st.lists(st.tuples(st.integers(0, 600), st.integers(0, 600)), min_size=1, max_size=20))
def test_crc_of_spans(data, spans):
    data = data or b"x"
    spans = [(a % len(data), n % (len(data) - a % len(data) + 1)) for a, n in spans]
    starts, sizes = (np.array(column, np.int64) for column in zip(*spans, strict=True))
    got = crc32_of_spans(np.frombuffer(data, np.uint8), starts, sizes)
    assert got.tolist() == [zlib.crc32(data[a : a + n]) for a, n in spans]


def test_crc_of_long_spans():
    data = np.random.default_rng(5).integers(0, 256, 300_000).astype(np.uint8)
    starts = np.array([0, 1, 7, 100, 200_000, 299_999])
    sizes = np.array([300_000, BLOCK, BLOCK + 1, 3 * BLOCK, 99_999, 1])
    expected = [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, sizes, strict=True)]
    assert crc32_of_spans(data, starts, sizes).tolist() == expected


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def slow_resampled(docs, items, percent=5, least=20):
    """``(id, n_features, weight, score, rank)`` of docs [(id, text)]."""
    bucket = lambda feature: zlib.crc32(feature.encode()) % 10000
    feats = [slow_features(text) for _, text in docs]
    s = Counter(bucket(f) for _, found in feats for f in found)
    t = Counter(bucket(f) for text in items for f in slow_features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (S + 10000) / ((s[k] + 1) * (T + 10000)))) for k in range(10000)]
    rows = []
    for (key, _), (n, found) in zip(docs, feats, strict=True):
        weight = sum(gain[bucket(f)] for f in found)
        h = int(sha(f"42:{'' if key is None else key}")[:8], 16)
        rows.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    order = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = order[: percent * len(order) // 100]
    return Counter((*r[:4], next((i + 1 for i, d in enumerate(drawn) if d is r), None)) for r in rows)


def test_draw_equals_slow_draw(spark, odd, prose):
    docs = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + k, prose(k, 15 + k)) for k in range(60)]
    docs += [(200, "y" * 5000 + " Ünï-Çödé ZZ 12x"), (201, "wörter " * 40), (202, "A\x00b~c{d" * 30)]
    frame = spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id long, text string, score int, rank int")
    items = [prose(3, 30), None, "", prose(20, 25)]
    target = spark.createDataFrame([(t,) for t in items], "text string")
    for percent in (5, 40):
        out = resampling.resampled(frame, target, percent=percent)
        assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert Counter(map(tuple, out.collect())) == slow_resampled(docs, items, percent)


def test_ties_go_to_the_smaller_id_and_empty_tables_give_nothing(spark, odd, nothing, prose):
    target = spark.createDataFrame([(prose(3, 30),)], "text string")
    assert resampling.resampled(nothing, target).collect() == []
    rows = resampling.resampled(odd, nothing).collect()
    assert len(rows) == odd.count()
    same = spark.createDataFrame([(k % 3, prose(1, 30)) for k in range(60)], "doc_id long, text string")
    drawn = [r for r in resampling.resampled(same, target, percent=50).collect() if r["rank"]]
    assert sorted(r["rank"] for r in drawn) == list(range(1, 31))
    assert len({r.doc_id for r in drawn}) == 2  # rows of one id tie, and follow each other


def test_drawn_rows_favour_the_target(spark, prose):
    like = [(k, "quux corge grault " * 8 + prose(k, 10)) for k in range(10)]
    rest = [(k, prose(k, 40)) for k in range(10, 200)]
    docs = spark.createDataFrame(like + rest, "doc_id long, text string")
    target = spark.createDataFrame([("quux corge grault " * 400,)], "text string")
    kept = resampling.drawn_rows(docs, target, percent=5)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(10))


# --- substring dedup ---


def slow_kept(docs, window=50):
    """``(id, n_words, n_removed, kept words)`` of docs [(id, text)]; a null id comes last."""
    order = lambda key: (key is None, key or 0)
    first: dict = {}
    words = [(key, (text or "").encode().split()) for key, text in docs]
    for key, w in words:
        for i in range(len(w) - window + 1):
            run = tuple(w[i : i + window])
            first[run] = min(first.get(run, order(key)), order(key))
    out = []
    for key, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < order(key):
                gone[i : i + window] = [True] * window
        left = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((key, len(w), sum(gone), left))
    return out


def digests(rows):
    return Counter((key, n, gone, hashlib.sha256(left).hexdigest()) for key, n, gone, left in rows)


def planted(prose, count, seed=3, window=50):
    """Texts that share passages, prefixes and suffixes of passages, near copies, copies and loops."""
    chosen = random.Random(seed)
    passages = [prose(900 + k, chosen.randrange(window, 3 * window)).split() for k in range(6)]
    texts = []
    for k in range(count):
        words = prose(k, chosen.randrange(0, 2 * window)).split()
        for _ in range(chosen.randrange(4)):
            passage = chosen.choice(passages)
            a = chosen.randrange(len(passage))
            words += passage[a : a + chosen.randrange(len(passage))]
            words += prose(chosen.randrange(5), chosen.randrange(4)).split()
        if chosen.random() < 0.2 and words:
            words[chosen.randrange(len(words))] = "changed"
        if chosen.random() < 0.1:
            words += ["loop"] * chosen.randrange(2 * window)
        texts.append((k, chosen.choice([" ", "\n", "  "]).join(words)))
    return texts + [(count + k, texts[k][1]) for k in range(5)]


@pytest.mark.parametrize("window", [50, 12, 5])
def test_kept_words_equal_slow_ones(spark, odd, prose, window):
    docs = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + k, t) for k, t in planted(prose, 120, window=window)]
    frame = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, doc int, digest string")
    out = seeds.kept_digests(frame.repartition(5), window=window)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    expected = digests(slow_kept(docs, window))
    assert Counter(map(tuple, out.collect())) == expected and sum(1 for row in expected if row[2]) > 20


def test_hot_groups_and_unsent_tables(spark, prose, monkeypatch):
    """One passage in every document, in different surroundings; groups are dealt and tables are shuffled."""
    monkeypatch.setattr(seeds, "HOT_ROWS_FEW", 20)
    for name in ("MOST_SENT", "SENT_TEXTS", "SENT_ANCHORS"):
        monkeypatch.setattr(seeds, name, 0)
    passage = prose(77, 70)
    docs = [(k, f"{prose(k, k % 7)} {passage} {prose(k % 9, 60)}") for k in range(150)]
    docs += [(150 + k, docs[0][1]) for k in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert Counter(map(tuple, seeds.kept_digests(frame).collect())) == digests(slow_kept(docs))


def test_stretches_and_texts_agree(spark, odd, prose):
    docs = planted(prose, 60, seed=8)
    frame = spark.createDataFrame([(k, t, 2, None) for k, t in docs], "doc_id long, text string, start int, kept string")
    expected = {key: (n, gone, left.decode()) for key, n, gone, left in slow_kept(docs)}
    lengths: Counter = Counter()
    for r in seeds.repeated_stretches(frame).collect():
        assert r.end - r.start >= 50
        lengths[r.doc_id] += r.end - r.start
    assert lengths == {key: gone for key, (_, gone, _) in expected.items() if gone}
    after = seeds.without_repeats(frame)
    assert after.columns == frame.columns
    texts = dict(docs)
    for r in after.collect():
        assert r.text == (expected[r.doc_id][2] if expected[r.doc_id][1] else texts[r.doc_id])
    left = seeds.without_repeats(odd)
    assert left.columns == odd.columns and left.count() == odd.count()


def test_substrings_of_nothing_and_of_ids_that_are_texts(spark, nothing):
    assert seeds.kept_digests(nothing).collect() == [] and seeds.repeated_stretches(nothing).collect() == []
    assert seeds.without_repeats(nothing).collect() == []
    with pytest.raises(TypeError, match="integer"):
        seeds.kept_digests(nothing, id_col="id")
