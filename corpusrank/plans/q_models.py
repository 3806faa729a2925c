"""Registered trained-model queries.

SQL fits the one-feature logistic regression itself and compares values.  For the
other trained models it checks what must hold whatever was learnt (every row of
every fold is scored, scores lie in [0, 1] and equal those of the exported model
tables, vectors are unit vectors, metrics lie in range, outputs exist).  Quality
bounds are in tests/."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from corpusrank.functions.vectors import l2_norm
from corpusrank.operators import selection as SEL
from corpusrank.operators.embed import fit_lsa, fit_w2v, word_tokens
from corpusrank.operators.models import coefficients, fit_model, model_scores, table_scores
from corpusrank.operators.splits import stratified_folds
from corpusrank.operators.tfidf import analyze
from corpusrank.operators import retrieval as R
from corpusrank.plans.common import TD, emb_vectors, table
from corpusrank.plans.experiment import at_once, evaluate, features, run_benchmark, score_grid, write_outputs
from corpusrank.plans.fixtures import experiment_fixture
from corpusrank.plans.q_corpus import labelled
from corpusrank.plans.registry import query
from corpusrank.plans.sql import corpus_ctes, folds_cte, sql_normalize, sql_tokenize, tfidf_ctes
from corpusrank.session import alone, cut_lineage, ensure_checkpoint_dir, saved
from corpusrank.sources import results as RS
from corpusrank.sources.results import EXPECTED_OUTPUTS


def _embed_summary(v):
    return v.select("doc_id", F.size("vec").cast("long").alias("dim"), F.round(l2_norm("vec"), 6).alias("norm"))


_KNOWN = f"""WITH {corpus_ctes()}"""


@query("lsa_embed", sql=_KNOWN + f""", {tfidf_ctes(TD.replace(tfidf_max_features=TD.lsa_max_features), docs='corpus')[1:]}
SELECT c.doc_id, CAST(least({TD.lsa_dim}, (SELECT count(*) FROM corpus) - 1, (SELECT count(*) - 1 FROM voc)) AS BIGINT) AS dim,
       CASE WHEN EXISTS (SELECT 1 FROM tfw WHERE tfw.doc_id = c.doc_id) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS norm FROM corpus c""")
def lsa_embed(spark, sf):
    """M2-M4: TF-IDF -> truncated SVD -> unit vectors on the labelled corpus."""
    c = saved(labelled(spark, sf).select("doc_id", "text"), "corpus", "zstd")
    terms = analyze(c, TD)                   # the analyser runs once
    return _embed_summary(fit_lsa(c, TD, terms=terms).transform(c))


@query("w2v_embed", sql=_KNOWN + f""",
tk AS (SELECT doc_id, unnest({sql_tokenize(sql_normalize('text'))}) AS term FROM corpus),
known AS (SELECT term FROM tk GROUP BY term HAVING count(*) >= {TD.w2v_min_count})
SELECT c.doc_id, CAST({TD.w2v_dim} AS BIGINT) AS dim,
       CASE WHEN EXISTS (SELECT 1 FROM tk JOIN known USING (term) WHERE tk.doc_id = c.doc_id) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS norm FROM corpus c""")
def w2v_embed(spark, sf):
    """M5-M7: Word2Vec mean pooling -> unit vectors."""
    c = saved(labelled(spark, sf).select("doc_id", "text"), "corpus")
    tokens = saved(word_tokens(c, TD), "tokens")
    return _embed_summary(fit_w2v(c, TD, tokens=tokens).transform(c))


_SCORED = f"""WITH {corpus_ctes()}, {folds_cte()} SELECT CAST(fold AS INTEGER) AS fold, doc_id, CAST(y AS INTEGER) AS y, TRUE AS in_range, TRUE AS agrees FROM folds"""


def _oof_scores(spark, sf, model):
    """Out-of-fold scores of every labelled document: LSA and model fitted on a
    fold's outer training rows only -> (fold, doc_id, y, score, table_score); the
    last is computed from the model's exported coefficients or tree nodes."""
    c = saved(labelled(spark, sf).select("doc_id", "text", "y"), "corpus", "zstd")
    terms = analyze(c, TD)
    folds = cut_lineage(stratified_folds(c.select("doc_id", "y"), TD))

    def scored(fold):
        x = c.join(folds.select("doc_id", (F.col("fold") == fold).alias("test")), "doc_id")
        rep = fit_lsa(x.filter(~F.col("test")), TD, terms=terms)
        v = features(rep, x, x.select("doc_id", "y", "test"))
        m = fit_model(model, v.filter(~F.col("test")).drop("test"), TD)
        test = v.filter(F.col("test"))
        out = model_scores(m, test).join(table_scores(spark, m, test, "table_score"), "doc_id", "left")
        return out.select(F.lit(fold).cast("int").alias("fold"), "doc_id", F.col("y").cast("int").alias("y"), "score", "table_score")

    # a fold's scratch tables go with it
    return SEL.union_all(at_once([partial(alone, partial(scored, f), "scores") for f in range(1, int(TD.outer_folds) + 1)], TD.parallelism))


def _in_range(scores):
    agrees = F.coalesce(F.abs(F.col("score") - F.col("table_score")) < 1e-9, F.lit(False))
    return scores.select("fold", "doc_id", "y", F.col("score").between(0.0, 1.0).alias("in_range"), agrees.alias("agrees"))


@query("score_logreg", sql=_SCORED)
def score_logreg(spark, sf):
    """M8 + M13, every fold."""
    return _in_range(_oof_scores(spark, sf, "logreg"))


@query("score_svm", sql=_SCORED)
def score_svm(spark, sf):
    """M9 + M13 (sigmoid of the margin), every fold."""
    return _in_range(_oof_scores(spark, sf, "linearsvc"))


@query("score_gbt", sql=_SCORED)
def score_gbt(spark, sf):
    """M10 + M13, every fold."""
    return _in_range(_oof_scores(spark, sf, "gbt"))


@query("score_rf", sql=_SCORED)
def score_rf(spark, sf):
    """M11 (README-only model), every fold."""
    return _in_range(_oof_scores(spark, sf, "rf"))


# Newton's method on the penalised, class-balanced likelihood of one feature, in SQL: with
# regParam 1 / sum(w) the objective is sum(w_i * loss_i) / sum(w) + a^2 / (2 * sum(w)).
_NEWTON = """WITH RECURSIVE d AS (
  SELECT vec_id AS doc_id, CAST(embedding[1] AS DOUBLE) AS x, CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END AS y FROM embeddings),
n AS (SELECT y, count(*) AS c FROM d GROUP BY y),
t AS (SELECT d.doc_id, d.x, d.y, (SELECT sum(c) FROM n) / (2.0 * n.c) AS w FROM d JOIN n USING (y)),
fit AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b
  UNION ALL
  SELECT i + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT i, any_value(a) AS a, any_value(b) AS b,
               sum(w * (p - y) * x) + any_value(a) AS ga, sum(w * (p - y)) AS gb,
               sum(w * p * (1 - p) * x * x) + 1 AS haa, sum(w * p * (1 - p) * x) AS hab, sum(w * p * (1 - p)) AS hbb
        FROM (SELECT f.i, f.a, f.b, t.*, 1 / (1 + exp(-(f.a * t.x + f.b))) AS p FROM fit f, t WHERE f.i < 12) GROUP BY i)),
m AS (SELECT a, b FROM fit WHERE i = 12)"""


def _balanced_logreg(spark, sf):
    """(model, rows): label 0 of `embeddings` against the rest, from the first entry."""
    x = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), (F.col("label") == 0).cast("int").alias("y"),
                                              array_to_vector(F.array(F.col("embedding")[0].cast("double"))).alias("features"))
    x = cut_lineage(x)
    return fit_model("logreg", x, TD), x


@query("logreg_coefficients", sql=_NEWTON + " SELECT round(a, 3) AS slope, round(b, 3) AS intercept FROM m")
def logreg_coefficients(spark, sf):
    """M8 + D21 by value: the fitted model as a table of its coefficients."""
    m, _ = _balanced_logreg(spark, sf)
    c = coefficients(spark, m)
    return c.groupBy().pivot("term", ["intercept", "0"]).agg(F.first("value")).select(
        F.round(F.col("0"), 3).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("logreg_scores", sql=_NEWTON + " SELECT doc_id, CAST(y AS INTEGER) AS y, round(1 / (1 + exp(-(a * x + b))), 3) AS score FROM t, m")
def logreg_scores(spark, sf):
    """M8 + M13 by value: the score of every row."""
    m, x = _balanced_logreg(spark, sf)
    return model_scores(m, x).select("doc_id", "y", F.round("score", 3).alias("score"))


_GRID = sorted((r, m) for r in TD.reps for m in TD.models if not r.startswith("w2v") or m == TD.w2v_only_for_model)
_GRID_SQL = ", ".join(f"(CAST({f} AS INTEGER), '{r}', '{m}', TRUE)" for f in range(1, TD.outer_folds + 1) for r, m in _GRID)


@query("experiment_grid", sql=f"SELECT * FROM (VALUES {_GRID_SQL}) t(fold, rep, model, in_range)")
def experiment_grid(spark, sf):
    """G4-G6 end to end: nested CV over the (rep, model) grid on documents x
    labels; each of the fold results' metrics lies in its range."""
    res = SEL.fold_results(score_grid(labelled(spark, sf), TD), TD)
    ok = F.col("thr_from_val").between(0.0, 1.0)
    for split in SEL.SPLITS:
        for m in SEL.FOLD_METRICS:
            low = -1.0 if m == "mcc" else 0.0
            ok = ok & F.coalesce(F.col(f"{split}_{m}").between(low, 1.0), F.lit(m == "roc_auc"))   # null with one class
    return res.select(F.col("fold").cast("int").alias("fold"), "rep", "model", ok.alias("in_range"))


_OUTPUTS = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', TRUE)" for n in EXPECTED_OUTPUTS) + ") t(name, present)"


def _written(spark, res):
    """Write every output of a run and list them; a missing one is an error."""
    # a fresh folder under the shared checkpoint location (works for any
    # Hadoop filesystem, not only a local one)
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    write_outputs(res, TD, out)
    found = cut_lineage(RS.inventory(spark, out).select("name", "present"))
    missing = [r["name"] for r in found.where("NOT present").collect()]     # at most the expected names
    if missing:
        raise ValueError(f"outputs not written: {missing}")
    return found


@query("results_inventory", sql=_OUTPUTS)
def results_inventory(spark, sf):
    """Entry 1 + M14 + A7-A10: the whole experiment on documents x labels, with
    the winner's representation refitted for the recommendations."""
    return _written(spark, run_benchmark(labelled(spark, sf), TD))


@query("results_inventory_fixture", sql=_OUTPUTS)
def results_inventory_fixture(spark, sf):
    """A7-A10 on the experiment fixture and the given embeddings; nothing is fitted."""
    res = evaluate(cut_lineage(experiment_fixture(spark, sf)), TD)
    vec = emb_vectors(spark, sf)
    hist = R.sampled_history(vec, TD)
    docs, _ = R.prepare_docs(vec, TD)
    res.tables.update({
        "recommendations_topk": R.top_k_time_aware(vec, hist, TD),
        "recommendations_history_idx": hist.groupBy("user_id").agg(F.array_sort(F.collect_list("doc_id")).alias("history_idx")),
        "history_read_only": R.history_table(hist, docs, []),
    })
    return _written(spark, res)
