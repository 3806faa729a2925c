"""The nested cross-validation experiment end to end.

Driver-side control flow is limited to the tiny grid (folds x representations
x models); every fit, transform and metric is a Spark job, and up to
``Options.parallelism`` of them run at once.  Features are fitted once per (fold,
stage, representation), written in as few partitions as their size allows, and
shared by all models (N20); the long ``scores`` table is the single source for fold results, summary,
winner, OOF tables and diagnostics - nothing is refitted (N18).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrank.config import Options
from corpusrank.operators import errors as E
from corpusrank.operators import metrics as M
from corpusrank.operators import retrieval as R
from corpusrank.operators import selection as SEL
from corpusrank.operators.embed import as_ml_vector, fit_representation
from corpusrank.operators.models import fit_model, model_scores
from corpusrank.operators.splits import split_table, stratified_folds
from corpusrank.session import alone, cut_lineage, saved


@dataclass
class ExperimentResult:
    scores: DataFrame
    fold_results: DataFrame
    summary: DataFrame
    winner: DataFrame | None = None
    winner_record: DataFrame | None = None
    thr_global: float | None = None
    oof: DataFrame | None = None
    tables: dict = field(default_factory=dict)


FEATURE_BYTES = 32 << 20       # of a partition of features


def features(rep_model, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled features of ``docs`` as a written table.  Iterative fits start a job
    per iteration, so the rows go to few partitions of ``FEATURE_BYTES``."""
    x = alone(lambda: as_ml_vector(rep_model.transform(docs.select("doc_id", "text")).join(labels, "doc_id"), "vec", "features")
              .drop("vec"), "features")
    one = x.select("features").first()
    size = 8 * (one[0].size if one else 1) * x.count()
    return x.coalesce(max(1, -(-size // FEATURE_BYTES)))


def at_once(jobs: list, parallelism: int) -> list:
    """Results of the functions ``jobs``, run by a few driver threads."""
    from multiprocessing.pool import ThreadPool
    wrap = inheritable_thread_target(SparkSession.getActiveSession())
    with ThreadPool(max(1, min(int(parallelism), len(jobs)))) as pool:
        return pool.map(lambda job: job(), [wrap(job) for job in jobs], chunksize=1)


def analyses(corpus: DataFrame, opts: Options) -> dict:
    """Stateless per-document analyses, computed once for the whole corpus:
    they learn nothing, so sharing them across folds leaks nothing."""
    from corpusrank.operators.embed import word_tokens
    from corpusrank.operators.tfidf import analyze
    out = {}
    if any(r.startswith("tfidf") for r in opts.reps):
        out["terms"] = analyze(corpus, opts)
    if any(r.startswith("w2v") for r in opts.reps) and opts.run_w2v:
        out["tokens"] = saved(word_tokens(corpus, opts), "tokens", "zstd")
    return out


def score_grid(corpus: DataFrame, opts: Options) -> DataFrame:
    """Scores of every (fold, rep, model) on its train / val / test rows.

    ``corpus``: (doc_id, text, y).  Returns the long scores table
    (fold, rep, model, split, doc_id, y, score), checkpointed."""
    spark = corpus.sparkSession
    corpus = saved(corpus.select("doc_id", "text", "y"), "corpus", "zstd")
    cache = analyses(corpus, opts)
    splits = cut_lineage(split_table(stratified_folds(corpus.select("doc_id", "y"), opts), opts))
    grid = [(r["rep"], r["model"]) for r in SEL.candidate_grid(spark, opts).collect()]
    reps = sorted({r for r, _ in grid})
    stages = []
    for fold in range(1, int(opts.outer_folds) + 1):
        sf = splits.filter(F.col("fold") == fold).select("doc_id", "split")
        labelled = corpus.join(sf, "doc_id")
        inner_all = labelled.filter(F.col("split").isin("train", "val"))
        outer = labelled.withColumn("split", F.when(F.col("split") == "test", "test").otherwise("outer_train"))
        for rep in reps:
            models = [m for r, m in grid if r == rep]
            stages.append((fold, rep, models, inner_all, "train", ["train", "val"]))
            stages.append((fold, rep, models, outer, "outer_train", ["test"]))

    def represented(fold, rep, models, rows, fit_on, wanted):
        # Fit on the stage's training rows only, transform both sides
        fitted = fit_representation(rep, rows.filter(F.col("split") == fit_on).drop("split"), opts, cache)
        x = features(fitted, rows, rows.select("doc_id", "y", "split"))
        return [(fold, rep, m, x, fit_on, wanted) for m in models]

    def scored(fold, rep, model, x, fit_on, wanted):
        m = fit_model(model, x.filter(F.col("split") == fit_on), opts)
        s = model_scores(m, x.filter(F.col("split").isin(wanted))).select(
            F.lit(fold).cast("int").alias("fold"), F.lit(rep).alias("rep"), F.lit(model).alias("model"), "split", "doc_id",
            F.col("y").cast("int").alias("y"), "score")
        return saved(s, "scores")

    fits = [f for some in at_once([partial(represented, *s) for s in stages], opts.parallelism) for f in some]
    slow = {"gbt": 0, "gbt_exact": 0, "linearsvc": 1}
    fits.sort(key=lambda f: slow.get(f[2], 2))             # the longest first
    return cut_lineage(SEL.union_all(at_once([partial(scored, *f) for f in fits], opts.parallelism)))


def evaluate(scores: DataFrame, opts: Options, corpus: DataFrame | None = None) -> ExperimentResult:
    """G5-G12 on a scores table: fold results, summary, winner, OOF,
    global threshold, error tables and diagnostic point tables."""
    folds = cut_lineage(SEL.fold_results(scores, opts))
    summary = cut_lineage(SEL.fold_summary(folds))
    res = ExperimentResult(scores, folds, summary)
    ok = SEL.overfit_filter(summary, opts)
    winner = SEL.pick_winner(ok, opts)
    if winner.limit(1).count() == 0:          # N29: all flagged -> no winner
        return res
    res.winner = winner
    res.winner_record = SEL.winner_record(summary, winner, opts)
    res.thr_global = float(SEL.global_threshold(folds, winner).first()["thr_global"])
    oof = cut_lineage(SEL.oof_scores(scores, winner))
    res.oof = oof
    dec = E.decisions(oof, res.thr_global)
    t = {
        "winner_oof_false_positives": E.false_positives(dec, opts.error_top_k),
        "winner_oof_false_negatives": E.false_negatives(dec, opts.error_top_k),
        "winner_oof_most_uncertain": E.most_uncertain(dec, opts.error_top_k),
    }
    if corpus is not None:
        t = {k: E.with_text(v, corpus) for k, v in t.items()}
    stats = M.score_stats(oof, [])
    t["winner_oof_roc_points"] = M.roc_curve(stats, [])
    t["winner_oof_pr_points"] = M.pr_points(stats, [])
    t["winner_oof_calibration_bins"] = M.calibration_bins(oof, [], opts.n_bins)
    t["winner_oof_reliability"] = M.reliability_curve(oof, [], opts.n_bins)
    t["winner_oof_ece"] = M.ece(oof, [], opts.n_bins)
    res.tables = t
    return res


def recommend(corpus: DataFrame, rep: str, opts: Options) -> dict:
    """M14 + F8: refit the winning representation on the whole corpus, then
    time-decayed top-K for the simulated user (seeded history).  With
    ``topk_use_real_time`` the corpus' ``doc_time`` decides, if it has one."""
    fitted = fit_representation(rep, corpus.select("doc_id", "text"), opts, analyses(corpus, opts))
    vec = fitted.transform(corpus.select("doc_id", "text"))
    time_col = "doc_time" if opts.topk_use_real_time and "doc_time" in corpus.columns else None
    if time_col:
        vec = vec.select("doc_id", "vec").join(corpus.select("doc_id", time_col), "doc_id")
    vec = cut_lineage(vec)
    hist = R.sampled_history(vec, opts)
    recs = R.top_k_time_aware(vec, hist, opts, time_col=time_col)
    docs, _ = R.prepare_docs(vec, opts, time_col)
    payload = docs.join(corpus.select("doc_id", "text"), "doc_id")
    return {
        "recommendations_topk": R.join_payload(recs, corpus, ["text"]),
        "recommendations_history_idx": hist.groupBy("user_id").agg(
            F.array_sort(F.collect_list("doc_id")).alias("history_idx")),
        "history_read_only": R.history_table(hist, payload, ["text"]),
    }


def run_benchmark(corpus: DataFrame, opts: Options) -> ExperimentResult:
    """Entry 1: the whole experiment; retrieval runs only when there is a
    winner (N29)."""
    scores = score_grid(corpus, opts)
    res = evaluate(scores, opts, corpus)
    if res.winner is not None:
        rep = res.winner.first()["rep"]
        res.tables.update(recommend(corpus, rep, opts))
    return res


def write_outputs(res: ExperimentResult, opts: Options, out_dir: str) -> str:
    """A7/A8 for a whole run: fold results, summary, the winner record (with
    the paths it refers to) and every diagnostic / recommendation table."""
    from corpusrank.sources import results as RS
    folds_path = RS.write_table(res.fold_results, out_dir, "results_folds")
    summary_path = RS.write_table(res.summary, out_dir, "results_summary")
    if res.winner is not None:
        rec = SEL.winner_record(res.summary, res.winner, opts, folds_path, summary_path)
        RS.write_table(rec, out_dir, "winner")
    for name, df in res.tables.items():
        RS.write_table(df, out_dir, name)
    return out_dir
