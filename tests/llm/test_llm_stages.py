"""Every pipeline stage over odd rows, an empty table and clashing columns."""

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string, spans string, c0 int"


@pytest.fixture(scope="module")
def rows(prose):
    item = prose(700, 40)
    texts = [
        (1, prose(1, 200)), (1, prose(1, 200)), (2, prose(1, 200)), (3, None), (None, prose(2, 80)), (4, ""), (5, " \n\t"),
        (6, prose(3, 30_000)), (7, f"{prose(4, 20)} {item} {prose(5, 20)}"), (8, "one"), (None, None),
        (9, f"{prose(6, 30)} {prose(1, 200)}"),
    ]
    return [(k, t, "en", "s", None if t is None else len(t), "x", "y", "z", 3) for k, t in texts], item


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """Labels and a benchmark for the rows; two labelled documents of each class, one label without a document."""
    path = tmp_path_factory.mktemp("tables")
    labels = [(1, 1, 0), (2, 1, 0), (4, 0, 0), (8, 0, 0), (77, 1, 0), (6, None, 0), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, rows[1]), (2, None), (3, ""), (4, "two words")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows[0], SCHEMA).persist()


@pytest.mark.parametrize("number", range(5))
def test_stage_over_odd_rows(spark, docs, folder, number):
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, docs, folder)
    found = out.collect()
    if number < 4:
        assert out.columns == docs.columns, name
        assert {(r.score, r.ids, r.spans, r.c0) for r in found} <= {("x", "y", "z", 3)}
    before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id for r in found}
    assert after <= set(before)
    if number == 1:  # equal texts and equal fingerprints leave one row each
        assert [r.doc_id for r in found].count(1) == 1 and 2 not in after
    if number == 2:  # nothing but repeated passages goes
        texts = {r.doc_id: r.text for r in found}
        assert texts[1] == before[1] and texts[6] == before[6] and texts[4] == "" and texts[3] is None
        assert texts[9].split() == before[9].split()[:30] and len(found) == docs.count()
    if number == 3:
        assert 7 not in after and {1, 3, 4, 6, 8} <= after
    if number == 4:
        assert len(found) == docs.count() and all(r.decodes_to_text for r in found if r.doc_id in (1, 6, 8))


@pytest.mark.parametrize("number", range(5))
def test_stage_over_no_rows(spark, docs, folder, number):
    out = corpus_pipeline.STAGES[number][1](spark, docs.limit(0), folder)
    assert out.collect() == []
    if number < 4:
        assert out.columns == docs.columns
