"""Exact classification metrics as grouped DataFrame queries (D7-D19, D25, D26,
E1-E4, S8, B6, G12).

Input: a long scores table ``(keys..., y int 0/1, score double)``; every
operator works per group, so one pass evaluates all folds / models / splits.

Plan shape: scores are first reduced to one row per (keys, distinct score)
(map-side partial aggregation), then cumulative counts come from the exact
bucketed running sum (``prefix.running_sums``) - never a window without a
partition key.  Threshold lookups (F1 sweep, quantile grid) are as-of probes
merged into the same ordered stream, O(n log n) rather than thresholds x rows.

Undefined values (ROC-AUC with one class, empty calibration bins) are NULL,
the table form of the reference's NaN.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusrank.operators.prefix import quantile_bucketizer, running_sums
from corpusrank.session import cut_lineage

N_QUANTILES = 801


def _k(keys):
    return list(keys or [])


def _join(a: DataFrame, b: DataFrame, keys: list, how: str = "inner") -> DataFrame:
    """Join on the group keys.  Ungrouped, ``b`` is one row of scalars (group
    totals, a threshold): it is fetched with one small action and attached as
    literals, so the plan holds no cross / nested-loop join."""
    return a.join(b, keys, how) if keys else with_scalars(a, b)


def with_scalars(a: DataFrame, one_row: DataFrame) -> DataFrame:
    row = one_row.first()
    if row is None:
        out = a.limit(0)
        for f in one_row.schema.fields:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
        return out
    for f in one_row.schema.fields:
        a = a.withColumn(f.name, F.lit(row[f.name]).cast(f.dataType))
    return a


# ------------------------------------------------------------------ E2 basis
def score_stats(scores: DataFrame, keys=None, n_buckets: int = 256) -> DataFrame:
    """S8 + E2: one row per (keys, distinct score) with pos/neg counts and the
    inclusive cumulative counts in descending score order; P and N are the
    group totals."""
    keys = _k(keys)
    agg = cut_lineage(scores.groupBy(*keys, "score")
                            .agg(F.sum(F.col("y").cast("long")).alias("pos"),
                                 F.sum((1 - F.col("y")).cast("long")).alias("neg")))
    cum = running_sums(agg, keys, "score", {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")},
                       descending=True, n_buckets=n_buckets)
    tot = agg.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                                 F.count(F.lit(1)).alias("n_distinct"))
    # reused by AUC, AP, ROC/PR points and every threshold lookup: materialise
    # once in the shared checkpoint folder
    return cut_lineage(_join(cum, tot, keys))


def auc_ap(stats: DataFrame, keys=None) -> DataFrame:
    """D14 ROC-AUC (tie-aware rank formula) and D15 average precision
    (step sum over distinct scores).  AUC is NULL with one class; AP is 0 with
    no positives."""
    keys = _k(keys)
    above = F.col("cum_pos") - F.col("pos")
    g = stats.groupBy(*keys).agg(
        F.sum(F.col("neg") * (above + F.col("pos") / 2.0)).alias("_auc_num"),
        F.sum(F.col("pos") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))).alias("_ap_num"),
        F.first("P").alias("P"), F.first("N").alias("N"))
    return g.select(*keys,
                    F.when((F.col("P") > 0) & (F.col("N") > 0),
                           F.col("_auc_num") / (F.col("P") * F.col("N"))).alias("roc_auc"),
                    F.when(F.col("P") > 0, F.col("_ap_num") / F.col("P")).otherwise(F.lit(0.0)).alias("pr_auc"))


def roc_points(stats: DataFrame, keys=None) -> DataFrame:
    """(fpr, tpr) at every distinct score, plus the origin."""
    keys = _k(keys)
    pts = stats.select(*keys, F.col("score").alias("threshold"),
                       F.when(F.col("N") > 0, F.col("cum_neg") / F.col("N")).alias("fpr"),
                       F.when(F.col("P") > 0, F.col("cum_pos") / F.col("P")).alias("tpr"))
    origin = (stats.select(*keys).distinct()
                   .select(*keys, F.lit(None).cast("double").alias("threshold"),
                           F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))
    return pts.unionByName(origin)


def roc_curve(stats: DataFrame, keys=None, n_buckets: int = 256) -> DataFrame:
    """E1 without collinear points: a point between two others stays only where the
    counts gained by it and by the next one differ; the origin, the first and the last
    point stay -> (keys, threshold, fpr, tpr).

    The next point is the next row of the same score bucket, or the first row of the
    next bucket, so no window holds a whole group's scores."""
    keys = _k(keys)
    x = quantile_bucketizer(stats, "score", n_buckets, "_b", descending=True)
    gain = F.struct("pos", "neg")
    first = x.groupBy(*keys, "_b").agg(F.max_by(gain, F.col("score")).alias("_f"))         # groups x buckets rows
    after = first.select(*keys, "_b", F.lead("_f").over(Window.partitionBy(*keys).orderBy("_b")).alias("_f"))
    x = x.withColumn("_n", F.lead(gain).over(Window.partitionBy(*keys, "_b").orderBy(F.col("score").desc())))
    x = x.join(after, [*keys, "_b"]).withColumn("_n", F.coalesce("_n", "_f"))
    first_point = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    kept = x.where(first_point | F.col("_n").isNull() | (F.col("_n.pos") != F.col("pos")) | (F.col("_n.neg") != F.col("neg")))
    return roc_points(kept, keys)


def pr_points(stats: DataFrame, keys=None) -> DataFrame:
    """(recall, precision) at every distinct score, plus the
    (recall 0, precision 1) end row.  Recall is 1 when there are no positives."""
    keys = _k(keys)
    pts = stats.select(*keys, F.col("score").alias("threshold"),
                       F.when(F.col("P") > 0, F.col("cum_pos") / F.col("P")).otherwise(F.lit(1.0)).alias("recall"),
                       (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"))
    end = (stats.select(*keys).distinct()
                .select(*keys, F.lit(None).cast("double").alias("threshold"),
                        F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision")))
    return pts.unionByName(end)


# ------------------------------------------------------------------ as-of counts
def counts_at(stats: DataFrame, probes: DataFrame, keys=None, n_buckets: int = 256) -> DataFrame:
    """E4 as-of lookup: for each probe threshold t (keys, thr), the number of
    positives and negatives with score >= t.

    Probes are merged into the descending score stream with zero weight;
    at equal values score rows sort first, so they are counted."""
    keys = _k(keys)
    s = stats.select(*keys, "score", "pos", "neg", F.lit(0).alias("_kind"))
    p = probes.select(*keys, F.col("thr").cast("double").alias("score"),
                      F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"),
                      F.lit(1).alias("_kind"))
    r = running_sums(cut_lineage(s.unionByName(p)), keys, "score", {"tp": F.col("pos"), "fp": F.col("neg")},
                     descending=True, n_buckets=n_buckets, tiebreak=[F.col("_kind")])
    return r.filter(F.col("_kind") == 1).select(*keys, F.col("score").alias("thr"), "tp", "fp")


def _totals(stats: DataFrame, keys) -> DataFrame:
    return stats.groupBy(*keys).agg(F.first("P").alias("P"), F.first("N").alias("N"),
                                    F.first("n_distinct").alias("n_distinct"))


def f1_expr(tp, fp, P) -> Column:
    """D11 with zero_division=0: 2tp / (2tp + fp + fn)."""
    den = 2 * tp + fp + (P - tp)
    return F.when(den > 0, (2.0 * tp) / den).otherwise(F.lit(0.0))


# ------------------------------------------------------------------ D26 quantiles
def quantile_grid(scores: DataFrame, keys=None, n_q: int = N_QUANTILES, n_buckets: int = 256) -> DataFrame:
    """The n_q linearly interpolated quantiles q_i = i/(n_q-1) of the
    scores of each group -> (keys, i, q, value), exact.

    Position h = q (n-1), lo = floor(h), value = s[lo] + (s[lo+1]-s[lo]) (h-lo).
    s[p] is found by an as-of probe into the ascending cumulative counts, so no
    group is ever held in one buffer."""
    keys = _k(keys)
    agg = cut_lineage(scores.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("cnt")))
    asc = cut_lineage(running_sums(agg, keys, "score", {"cum": F.col("cnt")}, descending=False,
                                   n_buckets=n_buckets))
    rows = asc.select(*keys, "score", (F.col("cum") - F.col("cnt")).alias("_p"), F.lit(0).alias("_kind"))
    n = agg.groupBy(*keys).agg(F.sum("cnt").alias("n"))
    step = 1.0 / (n_q - 1)
    grid = (n.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
             .withColumn("q", F.when(F.col("i") == n_q - 1, F.lit(1.0)).otherwise(F.col("i") * F.lit(step)))
             .withColumn("h", F.col("q") * (F.col("n") - 1).cast("double"))
             .withColumn("lo", F.floor("h").cast("long"))
             .withColumn("hi", F.least(F.col("lo") + 1, F.col("n") - 1))
             .withColumn("t", F.col("h") - F.col("lo")))
    probes = (grid.select(*keys, "i", F.col("lo").alias("_p"))
                  .unionByName(grid.select(*keys, "i", F.col("hi").alias("_p"))).distinct()
                  .select(*keys, "_p").distinct()
                  .withColumn("score", F.lit(None).cast("double")).withColumn("_kind", F.lit(1)))
    u = cut_lineage(rows.unionByName(probes))
    # monotone buckets on the position, from quantiles of the positions
    u = quantile_bucketizer(u, "_p", n_buckets, "_b")
    w = (Window.partitionBy(*keys, "_b").orderBy("_p", "_kind")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # A probe before the first score row of its bucket takes the last score of
    # the earlier buckets: per-bucket last values (a groups x buckets table)
    # carried forward.
    is_s = F.col("_kind") == 0
    per_b = u.groupBy(*keys, "_b").agg(F.max_by(F.when(is_s, F.col("score")), F.when(is_s, F.col("_p"))).alias("_last"))
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_b.withColumn("_carry", F.last("_last", ignorenulls=True).over(wb)).select(*keys, "_b", "_carry")
    u = (u.withColumn("_v", F.last("score", ignorenulls=True).over(w))
          .join(carry, [*keys, "_b"], "left")
          .withColumn("_v", F.coalesce("_v", "_carry")))
    val = u.filter(F.col("_kind") == 1).select(*keys, "_p", F.col("_v").alias("v"))
    a = val.select(*keys, F.col("_p").alias("lo"), F.col("v").alias("a"))
    b = val.select(*keys, F.col("_p").alias("hi"), F.col("v").alias("b"))
    out = (grid.join(a, [*keys, "lo"]).join(b, [*keys, "hi"])
               .withColumn("value", F.col("a") + (F.col("b") - F.col("a")) * F.col("t")))
    return out.select(*keys, F.col("i").cast("long").alias("i"), "q", "value")


# ------------------------------------------------------------------ D25 / E4
def f1_sweep(scores: DataFrame, keys=None, stats: DataFrame | None = None,
             thresholds: DataFrame | None = None) -> DataFrame:
    """F1 of ``score >= thr`` -> (keys, thr, tp, fp, fn, f1).

    Every distinct score of a group with at least two is a threshold, at any
    size: its counts are the cumulative counts already in ``stats``.  Other
    ``thresholds`` (keys, thr), such as a quantile grid, take an as-of lookup."""
    keys = _k(keys)
    stats = score_stats(scores, keys) if stats is None else stats
    if thresholds is None:
        c = stats.filter(F.col("n_distinct") >= 2).select(
            *keys, F.col("score").alias("thr"), F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"), "P")
    else:
        c = _join(counts_at(stats, thresholds, keys), _totals(stats, keys).select(*keys, "P"), keys)
    return c.select(*keys, "thr", "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"),
                    f1_expr(F.col("tp"), F.col("fp"), F.col("P")).alias("f1"))


def grid_thresholds(scores: DataFrame, keys=None) -> DataFrame:
    """The distinct values of the 801-quantile grid as thresholds."""
    keys = _k(keys)
    return quantile_grid(scores, keys).select(*keys, F.col("value").alias("thr")).distinct()


def best_threshold(scores: DataFrame, keys=None, stats: DataFrame | None = None,
                   thresholds: DataFrame | None = None) -> DataFrame:
    """The lowest threshold with maximal F1; 0.5 when fewer than two
    distinct scores -> (keys, thr, f1)."""
    keys = _k(keys)
    stats = score_stats(scores, keys) if stats is None else stats
    sw = f1_sweep(scores, keys, stats, thresholds)
    best = sw.groupBy(*keys).agg(F.min_by(F.struct("thr", "f1"), F.struct(-F.col("f1"), F.col("thr"))).alias("b"))
    best = best.select(*keys, F.col("b.thr").alias("thr"), F.col("b.f1").alias("f1"))
    allk = _totals(stats, keys).select(*keys)
    out = allk.join(best, keys, "left") if keys else best
    return out.withColumn("thr", F.coalesce("thr", F.lit(0.5)))


# ------------------------------------------------------------------ D7-D16
def confusion(scores: DataFrame, thr, keys=None) -> DataFrame:
    """D7 (with B6 ``score >= thr``): tp, fp, tn, fn per group.  ``thr`` is a
    number or a DataFrame (keys, thr)."""
    keys = _k(keys)
    if isinstance(thr, DataFrame):
        x = _join(scores, thr.select(*keys, "thr"), keys)
    else:
        x = scores.withColumn("thr", F.lit(float(thr)))
    yhat = (F.col("score") >= F.col("thr")).cast("long")
    y = F.col("y").cast("long")
    return x.groupBy(*keys).agg(
        F.first("thr").alias("thr"),
        F.sum(yhat * y).alias("tp"), F.sum(yhat * (1 - y)).alias("fp"),
        F.sum((1 - yhat) * (1 - y)).alias("tn"), F.sum((1 - yhat) * y).alias("fn"))


def _div(a, b) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def rates(conf: DataFrame) -> DataFrame:
    """D8-D13 from confusion counts (all in double)."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    mcc_den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    r1 = F.when(tp + fn > 0, tp / (tp + fn))
    r0 = F.when(tn + fp > 0, tn / (tn + fp))
    bal = (F.when(r1.isNotNull() & r0.isNotNull(), (r1 + r0) / 2.0)
            .otherwise(F.coalesce(r1, r0)))
    return (conf.withColumn("acc", _div(tp + tn, n))
                .withColumn("precision", _div(tp, tp + fp))
                .withColumn("recall", _div(tp, tp + fn))
                .withColumn("f1", _div(2 * tp, 2 * tp + fp + fn))
                .withColumn("mcc", _div(tp * tn - fp * fn, mcc_den))
                .withColumn("bal_acc", bal))


def metrics_bundle(scores: DataFrame, thr, keys=None, stats: DataFrame | None = None) -> DataFrame:
    """roc_auc, pr_auc, acc, f1, precision, recall, mcc, bal_acc (and the
    confusion counts) per group in one pass over the scores table."""
    keys = _k(keys)
    stats = score_stats(scores, keys) if stats is None else stats
    conf = rates(confusion(scores, thr, keys))
    a = auc_ap(stats, keys)
    return _join(conf, a, keys)


# ------------------------------------------------------------------ D17-D19
def ece_edges(n_bins: int) -> list:
    """Bin edges exactly as ``linspace(0, 1, n_bins + 1)``."""
    return [float(e) for e in np.linspace(0.0, 1.0, n_bins + 1)]


def _ece_bin_expr(p: Column, n_bins: int) -> Column:
    e = ece_edges(n_bins)
    expr = F.when(p < F.lit(e[0]), F.lit(-1))
    for i in range(len(e) - 1):
        expr = expr.when(p < F.lit(e[i + 1]), F.lit(i))
    return expr.otherwise(F.lit(len(e) - 1))


def calibration_bins(scores: DataFrame, keys=None, n_bins: int = 15) -> DataFrame:
    """All n_bins bins (empty ones with count 0 and NULL means):
    (keys, bin, count, p_mean, y_rate, abs_gap)."""
    keys = _k(keys)
    b = scores.withColumn("bin", _ece_bin_expr(F.col("score"), n_bins))
    g = (b.filter((F.col("bin") >= 0) & (F.col("bin") < n_bins))
          .groupBy(*keys, "bin")
          .agg(F.count(F.lit(1)).alias("count"), F.avg("score").alias("p_mean"),
               F.avg(F.col("y").cast("double")).alias("y_rate")))
    allb = scores.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    out = allb.join(g, [*keys, "bin"], "left")
    return out.select(*keys, F.col("bin").cast("int").alias("bin"),
                      F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                      "p_mean", "y_rate", F.abs(F.col("y_rate") - F.col("p_mean")).alias("abs_gap"))


def ece(scores: DataFrame, keys=None, n_bins: int = 15) -> DataFrame:
    """Sum over bins of (n_b / N) * |y_rate - p_mean|; N counts every row,
    including p = 1.0 which falls in no bin."""
    keys = _k(keys)
    bins = calibration_bins(scores, keys, n_bins)
    n = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"))
    x = _join(bins, n, keys)
    return x.groupBy(*keys).agg(
        F.sum(F.when(F.col("count") > 0, F.col("count") / F.col("n_total") * F.col("abs_gap"))
               .otherwise(F.lit(0.0))).alias("ece"))


def reliability_curve(scores: DataFrame, keys=None, n_bins: int = 15) -> DataFrame:
    """Right-closed uniform bins (p = 0 in bin 0, p = 1 in the last),
    non-empty bins only: (keys, bin, p_mean, y_rate)."""
    keys = _k(keys)
    e = ece_edges(n_bins)
    inner = e[1:-1]
    p = F.col("score")
    expr = F.lit(0)
    for i, edge in enumerate(inner):           # bin id = number of inner edges < p
        expr = expr + F.when(p > F.lit(edge), F.lit(1)).otherwise(F.lit(0))
    return (scores.withColumn("bin", expr).groupBy(*keys, "bin")
                  .agg(F.avg("score").alias("p_mean"), F.avg(F.col("y").cast("double")).alias("y_rate"))
                  .select(*keys, F.col("bin").cast("int").alias("bin"), "p_mean", "y_rate"))
