"""Fold results, summary, overfit filter and winner selection
(G5-G9, G10, D6, D20, B4, B5, S5, S9, J6).

All of it is SQL over the long scores table
``(fold, rep, model, split, doc_id, y, score)`` written by the experiment;
nothing is refitted (N18)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusrank.config import DEFAULT, Options
from corpusrank.operators import metrics as M

CAND = ["rep", "model"]
SPLITS = ("train", "val", "test")
# Metric order of the fold-result table.
FOLD_METRICS = ("pr_auc", "roc_auc", "acc", "f1", "mcc", "bal_acc")


def candidate_grid(spark, opts: Options) -> DataFrame:
    """J6 + B4: representation x model grid; W2V only with the permitted
    model and only when W2V runs."""
    rows = [(r, m) for r in opts.reps for m in opts.models
            if not r.startswith("w2v") or (opts.run_w2v and m == opts.w2v_only_for_model)]
    return spark.createDataFrame(sorted(rows), "rep string, model string")


def fold_results(scores: DataFrame, opts: Options) -> DataFrame:
    """Per (fold, rep, model): the best-F1 threshold on 'val', then the
    metric bundle of each split at that threshold, pivoted to
    ``{split}_{metric}``; G5 overfit gap ``train_acc - val_acc`` and flag."""
    k3 = ["fold", *CAND]
    k4 = [*k3, "split"]
    val = scores.filter(F.col("split") == "val")
    thr = M.best_threshold(val, k3).select(*k3, "thr")
    all_keys = scores.select(*k4).distinct()
    thr4 = all_keys.join(thr, k3, "left").withColumn("thr", F.coalesce("thr", F.lit(0.5)))
    m = M.metrics_bundle(scores, thr4, k4)
    aggs = [F.first("thr").alias("thr_from_val")]
    for sp in SPLITS:
        for met in FOLD_METRICS:
            aggs.append(F.first(F.when(F.col("split") == sp, F.col(met)), ignorenulls=True).alias(f"{sp}_{met}"))
    wide = m.groupBy(*k3).agg(*aggs)
    gap = F.col("train_acc") - F.col("val_acc")
    flag = (F.lit(bool(opts.enable_overfit_flag)) & (gap > F.lit(float(opts.overfit_acc_gap_thr)))).cast("int")
    cols = ["fold", "rep", "model", "thr_from_val", "overfit_acc_gap", "overfit_flag",
            *[f"{sp}_{met}" for sp in SPLITS for met in FOLD_METRICS]]
    return wide.withColumn("overfit_acc_gap", gap).withColumn("overfit_flag", flag).select(*cols)


def numeric_columns(df: DataFrame, exclude=("fold",)) -> list:
    num = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType, T.DecimalType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, num) and f.name not in exclude]


def fold_summary(folds: DataFrame, keys=CAND) -> DataFrame:
    """Mean and sample std of every numeric column (fold excluded) by
    (rep, model); NaN is skipped as pandas does (N10)."""
    aggs = []
    for c in numeric_columns(folds):
        v = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        aggs += [F.avg(v).alias(f"{c}_mean"), F.stddev_samp(v).alias(f"{c}_std")]
    return folds.groupBy(*keys).agg(*aggs)


def overfit_filter(summary: DataFrame, opts: Options) -> DataFrame:
    """Keep candidates never flagged (overfit_flag_mean = 0)."""
    if not opts.enable_overfit_flag:
        return summary
    return summary.filter(F.col("overfit_flag_mean") == 0)


def better(a: Column, b: Column, eps: float) -> Column:
    """A > b + eps (NULL-safe: false when either side is NULL)."""
    return F.coalesce(a > b + F.lit(float(eps)), F.lit(False))


def pick_winner(summary: DataFrame, opts: Options, group_keys=(), strict: bool = False) -> DataFrame:
    """Left fold over the candidates in (rep, model) order: a candidate
    replaces the incumbent when its primary metric is better by more than eps;
    within eps the tie metrics decide in order.  One winner per group (many
    experiments evaluate in parallel); the candidate list per group is the
    grid, a handful of rows.

    Default drops candidates with a NULL/NaN selection metric first; ``strict``
    reproduces the plain scan (a NaN incumbent is never replaced)."""
    prim = f"{opts.primary_metric}_mean"
    ties = [f"{m}_mean" for m in opts.tie_metrics]
    mcols = [prim, *ties]
    gk = list(group_keys)
    s = summary
    if not strict:
        for c in mcols:
            s = s.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c)))
    for c in mcols:   # NaN compares as NULL (Spark orders NaN above numbers)
        s = s.withColumn(c, F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")))
    st = F.struct(*[F.col(c) for c in CAND], *[F.col(c) for c in mcols])
    arr = s.groupBy(*gk).agg(F.array_sort(F.collect_list(st)).alias("_c")) if gk else \
        s.agg(F.array_sort(F.collect_list(st)).alias("_c"))
    eps = float(opts.tie_eps)
    stype = T.StructType([T.StructField(c, T.StringType()) for c in CAND] +
                         [T.StructField(c, T.DoubleType()) for c in mcols])

    def merge(acc, x):
        def tie(i):
            if i == len(ties):
                return acc
            m = ties[i]
            return (F.when(better(x[m], acc[m], eps), x)
                     .when(better(acc[m], x[m], eps), acc)
                     .otherwise(tie(i + 1)))
        a, b = x[prim], acc[prim]
        return (F.when(acc.isNull(), x)
                 .when(better(a, b, eps), x)
                 .when(F.coalesce(F.abs(a - b) <= F.lit(eps), F.lit(False)), tie(0))
                 .otherwise(acc))

    w = arr.select(*gk, F.aggregate("_c", F.lit(None).cast(stype), merge).alias("w"))
    w = w.filter(F.col("w").isNotNull())
    return w.select(*gk, F.col("w.rep").alias("rep"), F.col("w.model").alias("model"))


def winner_record(summary: DataFrame, winner: DataFrame, opts: Options, folds_path: str = "",
                  summary_path: str = "") -> DataFrame:
    """Names, primary metric, paths and a map of every ``_mean`` column."""
    means = [c for c in summary.columns if c.endswith("_mean")]
    row = summary.join(winner, CAND)
    mp = F.map_from_arrays(F.array(*[F.lit(c) for c in means]),
                           F.array(*[F.col(c).cast("double") for c in means]))
    return row.select(F.col("rep").alias("winner_rep"), F.col("model").alias("winner_model"),
                      F.lit(opts.primary_metric).alias("winner_primary"),
                      F.lit(folds_path).alias("results_folds_csv"),
                      F.lit(summary_path).alias("results_summary_csv"),
                      mp.alias("winner_metrics_mean"))


def sort_summary(summary: DataFrame, opts: Options = DEFAULT) -> DataFrame:
    """Order by the primary and tie metrics that exist, all descending."""
    cols = [F.col(f"{m}_mean").desc() for m in (opts.primary_metric, *opts.tie_metrics) if f"{m}_mean" in summary.columns]
    return summary.orderBy(*cols) if cols else summary


def oof_scores(scores: DataFrame, winner: DataFrame) -> DataFrame:
    """Out-of-fold predictions of the winner = its test rows."""
    return (scores.filter(F.col("split") == "test").join(winner.select(*CAND), CAND, "left_semi")
                  .select("fold", "doc_id", "y", "score"))


def global_threshold(folds: DataFrame, winner: DataFrame) -> DataFrame:
    """Median of the winner's fold thresholds, 0.5 when there are none."""
    t = folds.join(winner.select(*CAND), CAND, "left_semi")
    return t.agg(F.coalesce(F.median("thr_from_val"), F.lit(0.5)).alias("thr_global"))


def union_all(dfs) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)
