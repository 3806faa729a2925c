"""Scans and sinks: split selection (A2), time column (A6), sinks/inventory
(A7-A10), summary order (S5), the ML transformer (U1)."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from corpusrank.config import Options
from corpusrank.functions.text import TextNormalizer
from corpusrank.operators.selection import sort_summary
from corpusrank.sources import corpus as C
from corpusrank.sources import results as RS


def test_split_selection(spark):
    docs = spark.createDataFrame([(1, "a", 0, "test"), (2, "b", 1, "train"), (3, "c", 0, "train")],
                                 "doc_id long, text string, label int, split string")
    got = sorted(r["doc_id"] for r in C.corpus_from(docs, None, Options()).collect())
    assert got == [2, 3]
    no_train = docs.filter(F.col("split") == "test").union(
        spark.createDataFrame([(4, "d", 1, "valid")], docs.schema))
    got = sorted(r["doc_id"] for r in C.corpus_from(no_train, None, Options()).collect())
    assert got == [1]                                      # smallest split name: 'test' < 'valid'


def test_time_column_resolution(spark):
    o = Options(topk_use_real_time=True)
    df = spark.createDataFrame([(1, "x", 0, 5.0, dt.datetime(2024, 1, 1))],
                               "doc_id long, text string, label int, created double, date timestamp")
    r = C.corpus_from(df, None, o).first()
    assert r["doc_time"] == 1704067200.0                   # 'date' precedes 'created'
    assert "doc_time" not in C.corpus_from(df, None, Options()).columns
    s = spark.createDataFrame([(1, "x", 0, "yesterday")], "doc_id long, text string, label int, time string")
    assert "doc_time" not in C.corpus_from(s, None, o).columns   # textual -> synthetic index


def test_sinks_and_inventory(spark):
    out = tempfile.mkdtemp(prefix="sinks-", dir="/tmp")
    flat = spark.createDataFrame([(1, 0.5)], "a long, b double")
    nested = spark.createDataFrame([(1, [1, 2])], "user_id long, history_idx array<long>")
    assert RS.write_table(flat, out, "results_folds").endswith(".csv")
    assert RS.write_table(nested, out, "recommendations_history_idx").endswith(".json")
    assert RS.read_back(spark, f"{out}/results_folds.csv").first()["b"] == 0.5
    inv = {r["name"]: r for r in RS.inventory(spark, out).collect()}
    assert inv["results_folds"]["present"] and inv["results_folds"]["bytes"] > 0
    assert not inv["winner"]["present"]
    assert len(inv) == len(RS.EXPECTED_OUTPUTS)
    assert RS.shape(flat).first()["cols"] == 2


def test_sort_summary(spark):
    s = spark.createDataFrame([("a", "m", 0.5, 0.9), ("b", "m", 0.7, 0.1), ("c", "m", 0.7, 0.2)],
                              "rep string, model string, val_pr_auc_mean double, val_roc_auc_mean double")
    assert [r["rep"] for r in sort_summary(s).collect()] == ["c", "b", "a"]


def test_text_normalizer_transformer(spark):
    df = spark.createDataFrame([("See www.x.org 42 ok",)], "text string")
    assert TextNormalizer().transform(df).first()["clean"] == "see ok"
