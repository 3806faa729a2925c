"""Winner selection goldens (FIXTURES T8)."""

import math

from corpusrank.config import Options
from corpusrank.operators import selection as SEL

O = Options()
COLS = ["rep", "model", "val_pr_auc_mean", "val_roc_auc_mean", "val_f1_mean", "val_mcc_mean",
        "val_bal_acc_mean", "val_acc_mean", "overfit_flag_mean"]


def summ(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} {'string' if i < 2 else 'double'}" for i, c in enumerate(COLS)))


def win(spark, rows, **kw):
    r = SEL.pick_winner(SEL.overfit_filter(summ(spark, rows), O), O, **kw).collect()
    return (r[0]["rep"], r[0]["model"]) if r else None


def test_eps_tie_uses_tie_metric(spark):
    rows = [("a", "m", 0.8, 0.6, .5, .5, .5, .5, 0.0), ("b", "m", 0.8000005, 0.5, .5, .5, .5, .5, 0.0)]
    assert win(spark, rows) == ("a", "m")
    rows = [("a", "m", 0.8, 0.5, .5, .5, .5, .5, 0.0), ("b", "m", 0.8000005, 0.6, .5, .5, .5, .5, 0.0)]
    assert win(spark, rows) == ("b", "m")


def test_nan_candidate(spark):
    rows = [("a", "m", math.nan, 0.9, .5, .5, .5, .5, 0.0), ("b", "m", 0.7, 0.5, .5, .5, .5, .5, 0.0)]
    assert win(spark, rows) == ("b", "m")
    assert win(spark, rows, strict=True) == ("a", "m")      # a NaN incumbent is never replaced


def test_all_flagged_no_winner(spark):
    rows = [("a", "m", 0.8, 0.6, .5, .5, .5, .5, 0.5), ("b", "m", 0.7, 0.5, .5, .5, .5, .5, 1.0)]
    assert win(spark, rows) is None


def test_chain_of_near_ties_scan_order(spark):
    # a ~ b (within eps) and b ~ c, but c beats a by more than eps: the scan order decides
    rows = [("a", "m", 0.8000000, 0.5, .5, .5, .5, .5, 0.0),
            ("b", "m", 0.8000008, 0.4, .5, .5, .5, .5, 0.0),
            ("c", "m", 0.8000016, 0.3, .5, .5, .5, .5, 0.0)]
    # a vs b: tie, a keeps (roc higher); a vs c: c better by 1.6e-6 > eps -> c
    assert win(spark, rows) == ("c", "m")


def test_grid_filter(spark):
    g = [(r["rep"], r["model"]) for r in SEL.candidate_grid(spark, O).collect()]
    assert g == [("tfidf_lsa", "gbt"), ("tfidf_lsa", "linearsvc"), ("tfidf_lsa", "logreg"), ("w2v_avg", "logreg")]
