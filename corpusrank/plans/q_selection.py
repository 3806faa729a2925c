"""Registered selection and error-analysis queries on the experiment fixture
(G4-G11, D6, D20, B5, B7, B8, S2-S5, S9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusrank.operators import errors as E
from corpusrank.operators import selection as SEL
from corpusrank.plans.common import TD
from corpusrank.plans.fixtures import experiment_fixture
from corpusrank.plans.registry import query
from corpusrank.plans.sql import (auc_ap_select, best_cte, confusion_select, fixture_cte, folds_cte,
                                  rates_select, splits_cte, stats_cte, sweep_cte)

_MET = SEL.FOLD_METRICS
_SPL = SEL.SPLITS
_WIDE = [f"{sp}_{m}" for sp in _SPL for m in _MET]
_NUM = ["thr_from_val", "overfit_acc_gap", "overfit_flag", *_WIDE]

_XS = f"""WITH {fixture_cte()},
emb_y AS (SELECT vec_id AS doc_id, CAST(label = 0 AS INTEGER) AS y FROM embeddings),
{folds_cte(src='emb_y', name='efolds')},
{splits_cte(folds='efolds', name='esplits')},
xs AS (SELECT s.fold, 'centroid' AS rep, f.variant AS model, s.split, s.doc_id, s.y, f.score
       FROM esplits s JOIN fx f USING (doc_id)),
xv AS (SELECT CAST(fold AS VARCHAR) || '|' || rep || '|' || model AS variant, y, score FROM xs WHERE split = 'val'),
{stats_cte('xv', name='vst')}, {sweep_cte(st='vst', name='vsw')}, {best_cte(sw='vsw', st='vst', name='vbest')},
xa AS (SELECT CAST(fold AS VARCHAR) || '|' || rep || '|' || model || '|' || split AS variant, fold, rep, model, split, y, score FROM xs),
xk AS (SELECT DISTINCT variant, fold, rep, model, split FROM xa),
xthr AS (SELECT k.variant, coalesce(b.thr, 0.5) AS thr FROM xk k
         LEFT JOIN vbest b ON b.variant = CAST(k.fold AS VARCHAR) || '|' || k.rep || '|' || k.model),
{stats_cte('xa', name='ast')},
conf AS ({confusion_select('xa', 'xthr')}), rt AS ({rates_select('conf')}), au AS ({auc_ap_select('ast')}),
mm AS (SELECT k.fold, k.rep, k.model, k.split, rt.thr, rt.acc, rt.f1, rt.mcc, rt.bal_acc, au.pr_auc, au.roc_auc
       FROM rt JOIN au USING (variant) JOIN xk k USING (variant)),
wide AS (SELECT fold, rep, model, max(thr) AS thr_from_val,
         {', '.join(f"max(CASE WHEN split = '{sp}' THEN {m} END) AS {sp}_{m}" for sp in _SPL for m in _MET)}
         FROM mm GROUP BY fold, rep, model),
folds_res AS (SELECT fold, rep, model, thr_from_val, train_acc - val_acc AS overfit_acc_gap,
              CAST({'TRUE' if TD.enable_overfit_flag else 'FALSE'} AND (train_acc - val_acc) > {TD.overfit_acc_gap_thr!r} AS INTEGER) AS overfit_flag,
              {', '.join(_WIDE)} FROM wide),
summary AS (SELECT rep, model, {', '.join(f'avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std' for c in _NUM)}
            FROM folds_res GROUP BY rep, model),
ok AS (SELECT * FROM summary WHERE overfit_flag_mean = 0),
win AS (SELECT rep, model FROM ok WHERE val_pr_auc_mean IS NOT NULL AND NOT isnan(val_pr_auc_mean)
        ORDER BY val_pr_auc_mean DESC, rep, model LIMIT 1),
gthr AS (SELECT coalesce(median(thr_from_val), 0.5) AS thr_global FROM folds_res WHERE (rep, model) IN (SELECT rep, model FROM win)),
oof AS (SELECT doc_id, y, score FROM xs WHERE split = 'test' AND (rep, model) IN (SELECT rep, model FROM win)),
dec AS (SELECT doc_id, y AS y_true, score, CAST(score >= thr_global AS INTEGER) AS y_pred, score - thr_global AS margin_to_thr FROM oof, gthr)
"""


def _r(cols):
    return [F.round(c, 6).alias(c) for c in cols]


def _fixture_folds(spark, sf):
    return SEL.fold_results(experiment_fixture(spark, sf), TD)


@query("fold_results", sql=_XS + f"""SELECT fold, rep, model, {', '.join(f'round({c}, 6) AS {c}' for c in _NUM)} FROM folds_res""")
def fold_results(spark, sf):
    """Thresholds on val, metrics per split, overfit gap and flag."""
    f = _fixture_folds(spark, sf)
    return f.select("fold", "rep", "model", *_r(_NUM))


_SUM_COLS = [f"{c}_{s}" for c in _NUM for s in ("mean", "std")]


@query("fold_summary", sql=_XS + f"""SELECT rep, model, {', '.join(f'round({c}, 6) AS {c}' for c in _SUM_COLS)} FROM summary""")
def fold_summary(spark, sf):
    """Mean / sample std of the 21 numeric columns by (rep, model)."""
    s = SEL.fold_summary(_fixture_folds(spark, sf))
    return s.select("rep", "model", *_r(_SUM_COLS))


@query("overfit_flags", sql=_XS + "SELECT rep, model, round(overfit_flag_mean, 6) AS overfit_flag_mean FROM ok")
def overfit_flags(spark, sf):
    """Candidates never flagged as overfitting."""
    s = SEL.overfit_filter(SEL.fold_summary(_fixture_folds(spark, sf)), TD)
    return s.select("rep", "model", *_r(["overfit_flag_mean"]))


@query("winner", sql=_XS + f"""SELECT w.rep AS winner_rep, w.model AS winner_model, '{TD.primary_metric}' AS winner_primary,
round(s.val_pr_auc_mean, 6) AS val_pr_auc_mean FROM win w JOIN summary s USING (rep, model)""")
def winner(spark, sf):
    """Epsilon-tie left fold over (rep, model); winner record."""
    s = SEL.overfit_filter(SEL.fold_summary(_fixture_folds(spark, sf)), TD)
    w = SEL.pick_winner(s, TD)
    rec = SEL.winner_record(s, w, TD)
    return (rec.join(s.select(F.col("rep").alias("winner_rep"), F.col("model").alias("winner_model"),
                              "val_pr_auc_mean"), ["winner_rep", "winner_model"])
               .select("winner_rep", "winner_model", "winner_primary", *_r(["val_pr_auc_mean"])))


def _oof_and_thr(spark, sf):
    scores = experiment_fixture(spark, sf)
    folds = SEL.fold_results(scores, TD)
    s = SEL.overfit_filter(SEL.fold_summary(folds), TD)
    w = SEL.pick_winner(s, TD)
    thr = SEL.global_threshold(folds, w).first()["thr_global"]
    return SEL.oof_scores(scores, w), thr, w, folds


@query("global_threshold", sql=_XS + "SELECT round(thr_global, 6) AS thr_global FROM gthr")
def global_threshold(spark, sf):
    """Median of the winner's fold thresholds."""
    scores = experiment_fixture(spark, sf)
    folds = SEL.fold_results(scores, TD)
    w = SEL.pick_winner(SEL.overfit_filter(SEL.fold_summary(folds), TD), TD)
    return SEL.global_threshold(folds, w).select(*_r(["thr_global"]))


@query("oof_scores", sql=_XS + "SELECT doc_id, y, score FROM oof")
def oof_scores(spark, sf):
    """The winner's out-of-fold predictions (no refit)."""
    oof, _, _, _ = _oof_and_thr(spark, sf)
    return oof.select("doc_id", "y", "score")


_ERR = "doc_id, y_true, score, y_pred, round(margin_to_thr, 6) AS margin_to_thr"


def _err(df):
    return df.select("doc_id", "y_true", "score", "y_pred", *_r(["margin_to_thr"]))


@query("error_fp", sql=_XS + f"""SELECT {_ERR} FROM dec WHERE y_true = 0 AND y_pred = 1
ORDER BY score DESC, doc_id LIMIT {TD.error_top_k}""")
def error_fp(spark, sf):
    """Worst false positives."""
    oof, thr, _, _ = _oof_and_thr(spark, sf)
    return _err(E.false_positives(E.decisions(oof, thr), TD.error_top_k))


@query("error_fn", sql=_XS + f"""SELECT {_ERR} FROM dec WHERE y_true = 1 AND y_pred = 0
ORDER BY score ASC, doc_id LIMIT {TD.error_top_k}""")
def error_fn(spark, sf):
    """S3: worst false negatives."""
    oof, thr, _, _ = _oof_and_thr(spark, sf)
    return _err(E.false_negatives(E.decisions(oof, thr), TD.error_top_k))


@query("error_uncertain", sql=_XS + f"""SELECT {_ERR} FROM dec ORDER BY abs(margin_to_thr), doc_id LIMIT {TD.error_top_k}""")
def error_uncertain(spark, sf):
    """Closest to the threshold."""
    oof, thr, _, _ = _oof_and_thr(spark, sf)
    return _err(E.most_uncertain(E.decisions(oof, thr), TD.error_top_k))


# Fixed values of the many-experiments fixture: metrics in steps of 0.004 with ties up to 0.006,
# so that chains of near ties decide most winners.
_MANY = TD.replace(tie_eps=0.006)
_MANY_METRICS = [f"{m}_mean" for m in (_MANY.primary_metric, *_MANY.tie_metrics)]


def _many_summary(spark, sf):
    """One experiment per source of `documents`, eight candidates each, some flagged and some without a metric."""
    from corpusrank.plans.common import table
    d = table(spark, sf, "documents").groupBy("source", (F.col("doc_id") % 8).alias("c")).agg(F.sum("n_chars").cast("long").alias("s"))
    m = [(F.lit(0.5) + F.expr(f"(s DIV {k + 1}) % 5") * F.lit(0.004)).alias(c) for k, c in enumerate(_MANY_METRICS)]
    m[0] = F.when(F.expr("s % 11 <> 3"), m[0]).alias(_MANY_METRICS[0])
    return d.select("source", F.concat(F.lit("r"), (F.col("c") % 2).cast("string")).alias("rep"),
                    F.concat(F.lit("m"), F.expr("c DIV 2").cast("string")).alias("model"),
                    F.when(F.expr("s % 7 = 0"), 0.5).otherwise(0.0).alias("overfit_flag_mean"), *m)


def _tied(i):
    if i == len(_MANY_METRICS):
        return "w.i"
    m, e = _MANY_METRICS[i], _MANY.tie_eps
    return f"CASE WHEN x.{m} > w.{m} + {e} THEN x.i WHEN w.{m} > x.{m} + {e} THEN w.i ELSE {_tied(i + 1)} END"


_P = _MANY_METRICS[0]


@query("winner_many", sql=f"""WITH RECURSIVE d AS (SELECT source, doc_id % 8 AS c, CAST(sum(n_chars) AS BIGINT) AS s FROM documents GROUP BY 1, 2),
m AS (SELECT source, 'r' || (c % 2) AS rep, 'm' || (c // 2) AS model, s,
      {", ".join(f"CAST(0.5 AS DOUBLE) + ((s // {k + 1}) % 5) * CAST(0.004 AS DOUBLE) AS {c}" for k, c in enumerate(_MANY_METRICS))} FROM d),
cand AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rep, model) AS i FROM m WHERE s % 7 <> 0 AND s % 11 <> 3),
fold AS (SELECT source, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS win FROM cand WHERE i = 1
  UNION ALL SELECT f.source, x.i, CASE WHEN x.{_P} > w.{_P} + {_MANY.tie_eps} THEN x.i
      WHEN abs(x.{_P} - w.{_P}) <= {_MANY.tie_eps} THEN {_tied(1)} ELSE w.i END
  FROM fold f JOIN cand x ON x.source IS NOT DISTINCT FROM f.source AND x.i = f.i + 1
              JOIN cand w ON w.source IS NOT DISTINCT FROM f.source AND w.i = f.win)
SELECT f.source, c.rep, c.model FROM fold f JOIN cand c ON c.source IS NOT DISTINCT FROM f.source AND c.i = f.win
WHERE NOT EXISTS (SELECT 1 FROM fold g WHERE g.source IS NOT DISTINCT FROM f.source AND g.i > f.i)""")
def winner_many(spark, sf):
    """B5, G7, G8 for many experiments at once: flagged candidates and those without a metric
    leave, near ties go on to the tie metrics."""
    return SEL.pick_winner(SEL.overfit_filter(_many_summary(spark, sf), _MANY), _MANY, group_keys=["source"])


@query("sorted_summary", sql=_XS + f"""SELECT row_number() OVER (ORDER BY {", ".join(f"{c} DESC NULLS LAST" for c in _MANY_METRICS)}, rep, model) AS place, rep, model FROM summary""")
def sorted_summary(spark, sf):
    """The candidates from the best on (one row per candidate of the grid)."""
    s = SEL.sort_summary(SEL.fold_summary(_fixture_folds(spark, sf)), TD).select("rep", "model")
    rows = [(i + 1, r["rep"], r["model"]) for i, r in enumerate(s.collect())]
    return spark.createDataFrame(rows, "place long, rep string, model string")


_MEAN_KEYS = [f"{c}_mean" for c in _NUM]


@query("sink_json", sql=_XS + f"""SELECT rep AS winner_rep, model AS winner_model, 'folds.csv' AS results_folds_csv, 'summary.csv' AS results_summary_csv,
unnest([{", ".join(f"'{c}'" for c in _MEAN_KEYS)}]) AS key, unnest([{", ".join(f"round({c}, 6)" for c in _MEAN_KEYS)}]) AS value FROM win JOIN summary USING (rep, model)""")
def sink_json(spark, sf):
    """The winner record with its paths and map, written as JSON and read back by its schema."""
    import uuid

    from corpusrank.session import ensure_checkpoint_dir
    from corpusrank.sources import results as RS
    s = SEL.fold_summary(_fixture_folds(spark, sf))
    rec = SEL.winner_record(s, SEL.pick_winner(SEL.overfit_filter(s, TD), TD), TD, "folds.csv", "summary.csv")
    path = RS.write_table(rec, f"{ensure_checkpoint_dir(spark).rstrip('/')}/sinks-{uuid.uuid4().hex}", "winner")
    back = RS.read_json(spark, path, rec.schema)
    return (back.select("winner_rep", "winner_model", "results_folds_csv", "results_summary_csv", F.explode_outer("winner_metrics_mean").alias("key", "value"))
            .withColumn("value", F.round("value", 6)))
