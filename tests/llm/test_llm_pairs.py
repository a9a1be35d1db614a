"""Near vectors, SimHash, components and contained items against brute force."""

import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftline.llm import decontaminate, near_vectors, simhash
from siftline.llm.columns import sent
from siftline.llm.components import components, merge


def classes(pairs, nodes):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            least = min(low[a], low[b])
            if low[a] != least or low[b] != least:
                low[a] = low[b] = least
                changed = True
    return low


def test_components_of_chain_star_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(5, 5), (7, 6), (7, 6), (300, 99)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = classes(edges, {n for e in edges for n in e})
    assert {r.node: r.root for r in rows} == {n: low for n, low in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert len(rows) == len({r.node for r in rows})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_merge_joins_sets():
    labels = np.arange(8)
    merge(labels, np.array([3, 5, 1, 3]), np.array([5, 6, 0, 3]))
    assert labels.tolist() == [0, 0, 2, 3, 4, 3, 3, 7]


def vectors(seed, count, dims=16):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(count // 6, dims))
    return [
        (centres[k % len(centres)] + random.normal(size=dims) * random.choice([0.01, 0.15, 0.3])).astype(np.float32)
        for k in range(count)
    ]


@pytest.mark.parametrize("tile", [8192, 37])
def test_near_vectors_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(near_vectors, "TILE", tile)
    made = [v.tolist() for v in vectors(3, 240)]
    made += [made[0], made[0], [2 * x for x in made[1]], [-x for x in made[2]]]
    odd = [None, [0.0] * 16, [math.nan] + [1.0] * 15, [math.inf] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0, 0.0], [-0.0, 2.0], [3.0, 0.0]]
    rows = [(k, v, 1, "x") for k, v in enumerate(made + odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int, copies string")
    usable = {}
    for k, v, *_ in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable[k] = np.array(np.float32(v), float)
    links = [
        (a, b) for a in usable for b in usable
        if a < b and len(usable[a]) == len(usable[b])
        and usable[a] @ usable[b] / math.sqrt(usable[a] @ usable[a] * (usable[b] @ usable[b])) >= 0.95
    ]
    low = classes(links, range(len(rows)))
    n = {k: sum(k in link for link in links) for k in low}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df).collect()}
    assert got == {k: (n[k], low[k], low[k] == k) for k in low}
    assert max(n.values()) > 3


def test_near_vectors_with_repeated_and_null_ids_and_no_rows(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (None, None), (None, [0.0, 1.0])]
    got = sorted(map(str, (tuple(r) for r in near_vectors.near_vectors(spark.createDataFrame(rows, schema)).collect())))
    assert got == sorted(
        map(str, [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True), (None, 0, None, True)])
    )
    assert near_vectors.near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_error_bound_holds():
    made = np.array(vectors(9, 60, 64), float)
    codes, scales, rest = near_vectors.quantised(made)
    units = made / np.linalg.norm(made, axis=1, keepdims=True)
    near = np.outer(scales, scales) * (codes.astype(int) @ codes.astype(int).T)
    assert (abs(units @ units.T - near) <= (1 + rest[:, None]) * rest[None, :] + rest[:, None] + 1e-12).all()


def slow_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = {r.doc_id: slow_fingerprint(r.text) for r in docs.collect()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    low = classes(links, prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_texts(docs).collect()}
    assert got == {k: (f"{prints[k]:016x}", low[k]) for k in prints}
    kept = simhash.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(low.values())) and kept.columns == docs.columns


def test_simhash_of_odd_rows(spark, odd, nothing):
    got = sorted(map(str, (tuple(r) for r in simhash.near_texts(odd).select("doc_id", "component_id").collect())))
    want = [(1, 1), (2, 1), (2, 1), (None, 1), (3, 3), (4, 3), (5, 3), (None, 3), (6, 6), (12, 6), (7, 7), (7, 7)]
    want += [(8, 8), (9, 9), (10, 10), (11, 11)]
    assert got == sorted(map(str, want))
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 7, 7, 8, 9, 10, 11]
    assert simhash.near_texts(nothing).count() == simhash.one_of_each(nothing).count() == 0


def test_one_of_each_leaves_one_of_repeated_rows(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (9, "a b c d"), (None, "q r s"), (None, "q r s")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == ["(5, 'a b c d')", "(None, 'q r s')"]


@pytest.mark.parametrize("leaves", [1, 4, 256])
@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_trie_join_equals_all_pairs(monkeypatch, leaves, budget):
    monkeypatch.setattr(simhash, "LEAF_PAIRS", leaves)
    monkeypatch.setattr(simhash, "AT_ONCE", 50)
    random = np.random.default_rng(budget)
    values = random.integers(0, 1 << 63, 40, dtype=np.uint64)
    flipped = [v ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for v in values[:9] for a, b in random.integers(0, 64, (20, 2))]
    values = np.unique(np.concatenate([values, np.array(flipped, np.uint64)]))
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if int(values[i] ^ values[j]).bit_count() <= budget}
    got = [p for a, b in simhash.trie_pairs(values, values, 0, 0, budget) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_prefix_units_find_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SUBTRIE", 8)
    random = np.random.default_rng(5)
    base = random.integers(0, 1 << 62, 60)
    values = sorted({int(v) for v in base} | {int(v) ^ 1 << int(random.integers(64)) ^ 1 << int(random.integers(64)) for v in base})
    values = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    links = [(a, b) for a in values for b in values if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    found = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"), 2)
    got = [(r.a, r.b) for r in found.collect()]
    low = classes(links, values)
    mine = classes(got, values)
    assert {frozenset(v for v in values if mine[v] == m) for m in mine.values()} == {
        frozenset(v for v in values if low[v] == m) for m in low.values()
    }
    assert len(links) > 40


def slow_containment(text, item, size=5):
    import regex

    def words(t):
        return regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())

    def parts(t):
        found = words(t)
        return {tuple(found[k : k + size]) for k in range(max(1, len(found) - size + 1))} if found else set()

    size = min(size, max(1, len(words(item))))  # a shorter item is one shingle
    wanted = parts(item)
    return len(wanted & parts(text)) / len(wanted) if wanted else 0


def test_contained_items_of_partial_and_odd_texts(spark, odd, prose, nothing):
    items = {k: prose(100 + k, size) for k, size in enumerate([12, 15, 20, 33, 57, 5, 4, 200])}
    items |= {50: None, 51: "", 52: "one"}
    texts = {}
    for k, item in items.items():
        words = (item or "").split()
        for cut in (0, 1, 2, 3, 5, 8):
            texts[len(texts)] = prose(500 + k, 300) + " " + " ".join(words[cut:]) + ". " + prose(900 + k, 2000)
        texts[len(texts)] = " ".join(words[: len(words) // 2]) + " x " + prose(k, 50) + " " + " ".join(words[len(words) // 2 :])
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    docs = docs.unionByName(docs.limit(3)).unionByName(odd.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 1000))
    bench = spark.createDataFrame([(k, t, 1) for k, t in items.items()], "item_id long, text string, item int")
    bench = bench.unionByName(bench.limit(2))
    want = set()
    for row in docs.collect():
        for k, item in items.items():
            if (share := slow_containment(row.text, item)) >= 0.8:
                want.add((row.doc_id, k, share))
    found = [(r.doc_id, r.item_id, r.containment) for r in decontaminate.contained_items(docs, bench).collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 20
    clean = decontaminate.decontaminated(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 2  # those with the word "one", and its id
    assert decontaminate.contained_items(nothing, bench).count() == 0
    assert decontaminate.contained_items(docs, bench.limit(0)).count() == 0


def test_items_of_fewer_words_than_a_shingle_are_found_inside_texts(spark):
    rows = [
        (1, "one two alpha Beta, gamma delta nine ten"), (2, "alpha beta gamma"), (3, "alpha beta x gamma delta"),
        (4, "so delta"), (5, "gamma"), (6, None), (7, "alpha beta gamma delta"), (8, "nine ten one two three four"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(1, "alpha beta gamma delta"), (2, "Delta"), (3, "nine ten"), (4, ""), (5, "one two three four five")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, bench).collect())
    assert found == [(1, 1), (1, 2), (1, 3), (3, 2), (4, 2), (7, 1), (7, 2), (8, 3)]
    assert sorted(r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()) == [2, 5, 6]


def test_elements_of_arrays_count_as_rows_of_what_is_sent(spark):
    arrays = spark.range(4).select("id", F.array_repeat(F.lit(1), 5).alias("a"))
    plans = [sent(arrays, "a", most)._jdf.queryExecution().logical().toString() for most in (23, 24)]
    assert ["Hint" in text for text in plans] == [False, True]


def test_decontamination_runs_no_python(spark, sf_dir, plan):
    from siftline.llm.queries import QUERIES

    text = plan(QUERIES["op5_contained_items"](spark, sf_dir))
    assert not [word for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop") if word in text]
