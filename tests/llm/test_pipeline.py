"""The five stages on awkward documents, and the run against its stages taken one by one."""

import collections

import pytest

import corpus_pipeline as P
from corpusrank.llm import op4_toxicity, op7_minhash, op10_line_dedup


@pytest.fixture(scope="module")
def folder(spark, edge, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    edge.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(1, 13)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_every_stage_on_awkward_rows(spark, edge, empty, folder):
    """Null ids and texts, repeated rows, clashing columns and no rows at all."""
    for name, stage in P.STAGES[:-1]:
        for docs in (edge, empty):
            out = stage(spark, docs, folder)
            assert out.columns == edge.columns, name
            assert out.count() <= 3 * docs.count(), name
    packed = P.packing(spark, edge, folder)
    assert packed.count() >= edge.count() and P.packing(spark, empty, folder).count() == 0


def test_decisions_take_effect(spark, edge, folder):
    ids = lambda df: collections.Counter(r["doc_id"] for r in df.collect())
    model = op4_toxicity.fit(edge, spark.read.parquet(f"{folder}/labels.parquet"))
    assert ids(P.toxicity(spark, edge, folder)) == ids(op4_toxicity.reject(edge, model))
    lines = P.line_dedup(spark, edge, folder)
    assert sorted(map(repr, lines.collect())) == sorted(map(repr, op10_line_dedup.apply(edge).collect()))
    kept = {r["doc_id"] for r in op7_minhash.near_dedup(edge).where("kept").collect()}
    near = ids(P.near_dedup(spark, edge, folder))
    assert {i for i in near if i is not None} == {i for i in kept if i is not None}
    assert near[None] == ids(edge)[None]                                   # rows without an id stay


def test_run_is_the_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = P.saved(stage(spark, docs, folder), "stage")
    want = P.STAGES[-1][1](spark, docs, folder)
    got = P.run(spark, folder)
    assert got.columns == want.columns
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got.collect()) == sorted((str(r["doc_id"]), r["ids_crc32"]) for r in want.collect())
