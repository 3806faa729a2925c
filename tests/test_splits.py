"""Stratified folds and inner hold-outs (FIXTURES T7, N19)."""

from pyspark.sql import functions as F

from corpusrank.operators import splits as S
from corpusrank.plans.common import TD
from corpusrank.plans.q_corpus import labelled


def test_t7_fold_class_counts(spark):
    c = labelled(spark, "/root/testdata/sf0.01").select("doc_id", "y")
    f = S.stratified_folds(c, TD, k=5)
    got = {(r["y"], r["fold"]): r["count"] for r in f.groupBy("y", "fold").count().collect()}
    assert [got[(0, i)] for i in range(1, 6)] == [12, 12, 12, 11, 11]
    assert [got[(1, i)] for i in range(1, 6)] == [68, 68, 68, 69, 68]


def test_inner_split_partitions_and_quota(spark):
    c = labelled(spark, "/root/testdata/sf0.01").select("doc_id", "y")
    sp = S.split_table(S.stratified_folds(c, TD), TD)
    n = c.count()
    for fold in (1, 2):
        rows = sp.filter(F.col("fold") == fold)
        assert rows.count() == n
        assert rows.select("doc_id").distinct().count() == n
        part = rows.filter(F.col("split") != "test").count()
        val = rows.filter(F.col("split") == "val").count()
        assert val == -(-part // 10)                        # ceil(0.1 * n)


def test_no_leak_between_test_and_train(spark):
    c = labelled(spark, "/root/testdata/sf0.01").select("doc_id", "y")
    sp = S.split_table(S.stratified_folds(c, TD), TD)
    t = sp.filter(F.col("split") == "test").select("fold", "doc_id")
    tr = sp.filter(F.col("split") != "test").select("fold", "doc_id")
    assert t.join(tr, ["fold", "doc_id"]).count() == 0
