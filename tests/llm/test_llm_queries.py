"""The registered queries, and the pipeline stage by stage against brute force on a small table."""

import pytest
import xxhash  # noqa: F401
from test_llm_pairs import classes, slow_containment, slow_fingerprint
from test_llm_texts import slow_stretches

import corpus_pipeline
from comparison import connection, differences
from siftline.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_the_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), ORACLES[name], connection(sf_dir)) == []


def test_all_queries_are_there():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{k}" for k in range(1, 14)]


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    predicted = {r.doc_id: r.predicted for r in QUERIES["op4_quality"](spark, sf_dir).collect()}
    kept = {r.doc_id: r.text for r in docs.collect() if predicted[r.doc_id]}
    prints = {k: slow_fingerprint(t) for k, t in kept.items()}
    low = classes([(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2], prints)
    kept = {k: t for k, t in kept.items() if low[k] == k}
    found = {k for k, _, _ in slow_stretches(list(kept.items()), 50)}

    state = docs
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names[0].startswith("quality") and len(names) == 5
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        state = stage(spark, state, sf_dir).cache()
        if number < 4:
            assert state.columns == docs.columns
        if number == 1:
            assert {r.doc_id: r.text for r in state.collect()} == kept
        if number == 2:
            after = {r.doc_id: r.text for r in state.collect()}
            assert after.keys() == kept.keys() and {k for k in kept if after[k] != kept[k]} == found
            assert not slow_stretches(list(after.items()), 50)
            left = {k for k, t in after.items() if not any(slow_containment(t, i) >= 0.8 for i in items.values())}
        if number == 3:
            assert {r.doc_id for r in state.collect()} == left
    assert state.where("NOT decodes_to_text").count() == 0 and {r.doc_id for r in state.collect()} == left
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(left)
