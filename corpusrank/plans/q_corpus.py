"""Registered corpus and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusrank.operators import splits as S
from corpusrank.operators.retrieval import sampled_history
from corpusrank.plans.common import TD, emb_vectors
from corpusrank.plans.registry import query
from corpusrank.plans.sql import corpus_ctes, folds_cte, md5_key, splits_cte
from corpusrank.sources import corpus as C


CAP = 40_000      # the option of A3, off by default


def labelled(spark, sf):
    """(doc_id, text, label, y) - documents with a `quality` label."""
    return C.binary_target(C.load_corpus(spark, sf, TD), TD)


@query("corpus_scan", sql=f"WITH {corpus_ctes()} SELECT doc_id, text, label FROM corpus")
def corpus_scan(spark, sf):
    """A1/A2/A4/A5: documents joined to labels, safe text, int label."""
    return C.load_corpus(spark, sf, TD)


@query("corpus_cap", sql=f"""WITH {corpus_ctes()}
SELECT doc_id, CAST(row_number() OVER (ORDER BY {md5_key('doc_id', str(TD.seed))}, doc_id) - 1 AS BIGINT) AS pos
FROM corpus ORDER BY {md5_key('doc_id', str(TD.seed))}, doc_id LIMIT {CAP}""")
def corpus_cap(spark, sf):
    """A3 + E7: seeded order, capped at an explicit ``max_docs``, with the
    0-based position."""
    capped = C.cap_corpus(C.load_corpus(spark, sf, TD), TD.replace(max_docs=CAP))
    return C.corpus_order(capped.select("doc_id"), TD)


@query("binary_target", sql=f"WITH {corpus_ctes()} SELECT doc_id, label, y FROM corpus")
def binary_target(spark, sf):
    """B1: y = (label = pos_class)."""
    return labelled(spark, sf).select("doc_id", "label", "y")


@query("pos_rate", sql=f"""WITH {corpus_ctes()}
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS n_pos, round(avg(y), 6) AS pos_rate FROM corpus""")
def pos_rate(spark, sf):
    """B2."""
    return C.positive_rate(labelled(spark, sf))


@query("class_weights", sql=f"""WITH {corpus_ctes()}
SELECT y, CAST(count(*) AS BIGINT) AS n_c,
       round((SELECT count(*) FROM corpus) / ((SELECT count(DISTINCT y) FROM corpus) * count(*)), 6) AS weight
FROM corpus GROUP BY y""")
def class_weights(spark, sf):
    """Balanced weights n / (k * n_c)."""
    return C.class_weights(labelled(spark, sf)).withColumn("weight", F.round("weight", 6))


@query("seeded_sample", sql=f"""
SELECT vec_id AS doc_id FROM embeddings
ORDER BY {md5_key('vec_id', f'history{TD.seed}')}, vec_id
LIMIT least({TD.topk_history_size}, (SELECT count(*) - 1 FROM embeddings))""")
def seeded_sample(spark, sf):
    """Exact seeded sample without replacement (the simulated history)."""
    return sampled_history(emb_vectors(spark, sf), TD).select("doc_id")


@query("stratified_folds", sql=f"WITH {corpus_ctes()}, {folds_cte()} SELECT doc_id, y, fold FROM folds")
def stratified_folds(spark, sf):
    """G1 (E6): stratified K-fold by hash rank within class."""
    return S.stratified_folds(labelled(spark, sf).select("doc_id", "y"), TD)


@query("stratified_folds_k5", sql=f"WITH {corpus_ctes()}, {folds_cte(k=5)} SELECT doc_id, y, fold FROM folds")
def stratified_folds_k5(spark, sf):
    """G1 with k=5 (the fold x class counts of FIXTURES T7)."""
    return S.stratified_folds(labelled(spark, sf).select("doc_id", "y"), TD, k=5)


@query("inner_split", sql=f"WITH {corpus_ctes()}, {folds_cte()}, {splits_cte()} SELECT fold, doc_id, y, split FROM splits")
def inner_split(spark, sf):
    """G2 + J1: per outer fold, test / stratified val hold-out / train."""
    folds = S.stratified_folds(labelled(spark, sf).select("doc_id", "y"), TD)
    return S.split_table(folds, TD)
