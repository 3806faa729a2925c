"""Registered metric queries on the score fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusrank.operators import metrics as M
from corpusrank.plans.fixtures import events_fixture, score_fixture
from corpusrank.plans.registry import query
from corpusrank.plans.sql import (auc_ap_select, best_cte, confusion_select, dbl, ece_bin_sql,
                                  events_fixture_cte, fixture_cte, rates_select, reliability_bin_sql,
                                  stats_cte, sweep_cte)

K = ["variant"]
R6 = 6


def _r(cols):
    return [F.round(c, R6).alias(c) for c in cols]


@query("score_fixture", sql=f"WITH {fixture_cte()} SELECT variant, doc_id, y, score FROM fx")
def q_score_fixture(spark, sf):
    return score_fixture(spark, sf)


@query("distinct_scores", sql=f"""WITH {fixture_cte()}, {stats_cte('fx')}
SELECT variant, score, pos, neg, CAST(cum_pos AS BIGINT) AS cum_pos, CAST(cum_neg AS BIGINT) AS cum_neg FROM st""")
def distinct_scores(spark, sf):
    """S8 + E2: distinct scores with cumulative counts (descending)."""
    st = M.score_stats(score_fixture(spark, sf), K)
    return st.select("variant", "score", "pos", "neg", "cum_pos", "cum_neg")


@query("roc_auc", sql=f"""WITH {fixture_cte()}, {stats_cte('fx')}
SELECT variant, round(roc_auc, 6) AS roc_auc FROM ({auc_ap_select()})""")
def roc_auc(spark, sf):
    """D14."""
    a = M.auc_ap(M.score_stats(score_fixture(spark, sf), K), K)
    return a.select("variant", *_r(["roc_auc"]))


@query("avg_precision", sql=f"""WITH {fixture_cte()}, {stats_cte('fx')}
SELECT variant, round(pr_auc, 6) AS pr_auc FROM ({auc_ap_select()})""")
def avg_precision(spark, sf):
    """D15."""
    a = M.auc_ap(M.score_stats(score_fixture(spark, sf), K), K)
    return a.select("variant", *_r(["pr_auc"]))


@query("roc_points", sql=f"""WITH {fixture_cte()}, {stats_cte('fx')}
SELECT variant, score AS threshold, round(CAST(cum_neg AS DOUBLE) / N, 6) AS fpr, round(CAST(cum_pos AS DOUBLE) / P, 6) AS tpr FROM st
UNION ALL SELECT DISTINCT variant, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM st""")
def roc_points(spark, sf):
    """E1."""
    p = M.roc_points(M.score_stats(score_fixture(spark, sf), K), K)
    return p.select("variant", "threshold", *_r(["fpr", "tpr"]))


@query("roc_curve", sql=f"""WITH {fixture_cte()}, {stats_cte('fx')},
nx AS (SELECT *, lead(pos) OVER w AS npos, lead(neg) OVER w AS nneg, row_number() OVER w AS i FROM st WINDOW w AS (PARTITION BY variant ORDER BY score DESC))
SELECT variant, score AS threshold, round(CAST(cum_neg AS DOUBLE) / N, 6) AS fpr, round(CAST(cum_pos AS DOUBLE) / P, 6) AS tpr FROM nx
WHERE i = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg
UNION ALL SELECT DISTINCT variant, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM st""")
def roc_curve(spark, sf):
    """E1 without the collinear points."""
    p = M.roc_curve(M.score_stats(score_fixture(spark, sf), K), K)
    return p.select("variant", "threshold", *_r(["fpr", "tpr"]))


@query("pr_points", sql=f"""WITH {fixture_cte()}, {stats_cte('fx')}
SELECT variant, score AS threshold, round(CASE WHEN P > 0 THEN CAST(cum_pos AS DOUBLE) / P ELSE 1.0 END, 6) AS recall,
       round(CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg), 6) AS precision FROM st
UNION ALL SELECT DISTINCT variant, CAST(NULL AS DOUBLE), 0.0, 1.0 FROM st""")
def pr_points(spark, sf):
    """E3."""
    p = M.pr_points(M.score_stats(score_fixture(spark, sf), K), K)
    return p.select("variant", "threshold", *_r(["recall", "precision"]))


@query("f1_sweep", sql=f"""WITH {fixture_cte()}, {stats_cte('fx')}, {sweep_cte()}
SELECT variant, thr, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(f1, 6) AS f1 FROM sw""")
def f1_sweep(spark, sf):
    """E4 over the distinct-score thresholds."""
    s = M.f1_sweep(score_fixture(spark, sf), K)
    return s.select("variant", "thr", "tp", "fp", "fn", *_r(["f1"]))


@query("best_threshold", sql=f"""WITH {fixture_cte()}, {stats_cte('fx')}, {sweep_cte()}, {best_cte()}
SELECT variant, thr, round(f1, 6) AS f1 FROM best""")
def best_threshold(spark, sf):
    """Lowest threshold with maximal F1."""
    b = M.best_threshold(score_fixture(spark, sf), K)
    return b.select("variant", "thr", *_r(["f1"]))


_STEP = 1.0 / (M.N_QUANTILES - 1)
_GRID_SQL = f"""
qn AS (SELECT variant, count(*) AS n FROM evx GROUP BY variant),
qg AS (SELECT variant, i, CASE WHEN i = {M.N_QUANTILES - 1} THEN 1.0 ELSE i * {dbl(_STEP)} END AS q, n FROM qn, range(0, {M.N_QUANTILES}) t(i)),
qh AS (SELECT *, q * CAST(n - 1 AS DOUBLE) AS h FROM qg),
ql AS (SELECT *, CAST(floor(h) AS BIGINT) AS lo, least(CAST(floor(h) AS BIGINT) + 1, n - 1) AS hi FROM qh),
srt AS (SELECT variant, score, row_number() OVER (PARTITION BY variant ORDER BY score) - 1 AS p FROM evx),
qv AS (SELECT l.variant, l.i, l.q, a.score + (b.score - a.score) * (l.h - l.lo) AS value
       FROM ql l JOIN srt a ON a.variant = l.variant AND a.p = l.lo JOIN srt b ON b.variant = l.variant AND b.p = l.hi)"""


@query("quantile_grid", sql=f"""WITH {events_fixture_cte()}, {_GRID_SQL}
SELECT variant, CAST(i AS BIGINT) AS i, round(q, 6) AS q, round(value, 12) AS value FROM qv""")
def quantile_grid(spark, sf):
    """801 linearly interpolated quantiles of a 10,000-row pool."""
    g = M.quantile_grid(events_fixture(spark, sf), K)
    # interpolated values have at most 11 decimals: 12 places avoids rounding ties
    return g.select("variant", "i", *_r(["q"]), F.round("value", 12).alias("value"))


@query("f1_sweep_grid", sql=f"""WITH {events_fixture_cte()}, {_GRID_SQL},
{stats_cte('evx')}, grid AS (SELECT DISTINCT variant, value AS thr FROM qv), {sweep_cte(grid='grid')}, {best_cte()}
SELECT variant, round(thr, 12) AS thr, round(f1, 6) AS f1 FROM best""")
def f1_sweep_grid(spark, sf):
    """D25 over the thresholds of the 801-quantile grid, an explicit option."""
    x = events_fixture(spark, sf)
    b = M.best_threshold(x, K, thresholds=M.grid_thresholds(x, K))
    return b.select("variant", F.round("thr", 12).alias("thr"), *_r(["f1"]))


@query("best_threshold_large", sql=f"""WITH {events_fixture_cte()}, {stats_cte('evx')}, {sweep_cte()}, {best_cte()}
SELECT variant, thr, round(f1, 6) AS f1 FROM best""")
def best_threshold_large(spark, sf):
    """D25 over every distinct score of a pool of thousands."""
    b = M.best_threshold(events_fixture(spark, sf), K)
    return b.select("variant", "thr", *_r(["f1"]))


@query("confusion", sql=f"""WITH {fixture_cte()}, {stats_cte('fx')}, {sweep_cte()}, {best_cte()}
{confusion_select('fx', 'best')}""")
def confusion(spark, sf):
    """D7 at the best-F1 threshold of each variant."""
    fx = score_fixture(spark, sf)
    return M.confusion(fx, M.best_threshold(fx, K), K)


_BUNDLE = ["roc_auc", "pr_auc", "acc", "f1", "precision", "recall", "mcc", "bal_acc"]


@query("metrics_bundle", sql=f"""WITH {fixture_cte()}, {stats_cte('fx')}, {sweep_cte()}, {best_cte()},
conf AS ({confusion_select('fx', 'best')}), rt AS ({rates_select('conf')}), au AS ({auc_ap_select()})
SELECT rt.variant, rt.thr, rt.tp, rt.fp, rt.tn, rt.fn, {', '.join(f'round({c}, 6) AS {c}' for c in _BUNDLE)}
FROM rt JOIN au USING (variant)""")
def metrics_bundle(spark, sf):
    """D8-D16 at the best-F1 threshold."""
    fx = score_fixture(spark, sf)
    m = M.metrics_bundle(fx, M.best_threshold(fx, K), K)
    return m.select("variant", "thr", "tp", "fp", "tn", "fn", *_r(_BUNDLE))


@query("metrics_at_half", sql=f"""WITH {fixture_cte()}, {stats_cte('fx')},
half AS (SELECT DISTINCT variant, CAST(0.5 AS DOUBLE) AS thr FROM fx),
conf AS ({confusion_select('fx', 'half')}), rt AS ({rates_select('conf')}), au AS ({auc_ap_select()})
SELECT rt.variant, rt.thr, rt.tp, rt.fp, rt.tn, rt.fn, {', '.join(f'round({c}, 6) AS {c}' for c in _BUNDLE)}
FROM rt JOIN au USING (variant)""")
def metrics_at_half(spark, sf):
    """D16 at a fixed threshold 0.5."""
    m = M.metrics_bundle(score_fixture(spark, sf), 0.5, K)
    return m.select("variant", "thr", "tp", "fp", "tn", "fn", *_r(_BUNDLE))


@query("calibration_bins", sql=f"""WITH {fixture_cte()},
b AS (SELECT variant, {ece_bin_sql('score')} AS bin, score, y FROM fx),
g AS (SELECT variant, bin, count(*) AS cnt, avg(score) AS p_mean, avg(CAST(y AS DOUBLE)) AS y_rate
      FROM b WHERE bin >= 0 AND bin < 15 GROUP BY variant, bin),
allb AS (SELECT DISTINCT variant, unnest(generate_series(0, 14)) AS bin FROM fx)
SELECT a.variant, CAST(a.bin AS INTEGER) AS bin, CAST(coalesce(g.cnt, 0) AS BIGINT) AS count,
       round(g.p_mean, 6) AS p_mean, round(g.y_rate, 6) AS y_rate, round(abs(g.y_rate - g.p_mean), 6) AS abs_gap
FROM allb a LEFT JOIN g ON g.variant = a.variant AND g.bin = a.bin""")
def calibration_bins(spark, sf):
    """All 15 bins, empty ones with count 0."""
    b = M.calibration_bins(score_fixture(spark, sf), K)
    return b.select("variant", "bin", "count", *_r(["p_mean", "y_rate", "abs_gap"]))


@query("ece", sql=f"""WITH {fixture_cte()},
b AS (SELECT variant, {ece_bin_sql('score')} AS bin, score, y FROM fx),
n AS (SELECT variant, count(*) AS n_total FROM fx GROUP BY variant),
g AS (SELECT variant, bin, count(*) AS cnt, abs(avg(CAST(y AS DOUBLE)) - avg(score)) AS gap
      FROM b WHERE bin >= 0 AND bin < 15 GROUP BY variant, bin)
SELECT n.variant, round(coalesce(sum(CAST(g.cnt AS DOUBLE) / n.n_total * g.gap), 0.0), 6) AS ece
FROM n LEFT JOIN g USING (variant) GROUP BY n.variant""")
def ece(spark, sf):
    """D17."""
    e = M.ece(score_fixture(spark, sf), K)
    return e.select("variant", *_r(["ece"]))


@query("reliability_curve", sql=f"""WITH {fixture_cte()}
SELECT variant, CAST({reliability_bin_sql('score')} AS INTEGER) AS bin, round(avg(score), 6) AS p_mean,
       round(avg(CAST(y AS DOUBLE)), 6) AS y_rate
FROM fx GROUP BY variant, {reliability_bin_sql('score')}""")
def reliability_curve(spark, sf):
    """Right-closed bins, non-empty only."""
    r = M.reliability_curve(score_fixture(spark, sf), K)
    return r.select("variant", "bin", *_r(["p_mean", "y_rate"]))
