"""Metric goldens (FIXTURES T2-T4) and brute-force properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusrank.operators import metrics as M


def frame(spark, y, s, keys=None):
    rows = [(int(a), float(b), i) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "y int, score double, doc_id long")


def test_t2_auc_ap_threshold(spark):
    df = frame(spark, [1, 0, 1, 1, 0, 0], [.9, .8, .8, .3, .3, .1])
    st_ = M.score_stats(df, [])
    a = M.auc_ap(st_, []).first()
    assert a["roc_auc"] == pytest.approx(0.777778, abs=1e-6)
    assert a["pr_auc"] == pytest.approx(0.755556, abs=1e-6)
    sw = {r["thr"]: (r["tp"], r["fp"], r["f1"]) for r in M.f1_sweep(df, [], st_).collect()}
    assert sw[0.9][:2] == (1, 0) and sw[0.9][2] == pytest.approx(0.5)
    assert sw[0.8][:2] == (2, 1) and sw[0.8][2] == pytest.approx(0.666667, abs=1e-6)
    assert sw[0.3][:2] == (3, 2) and sw[0.3][2] == pytest.approx(0.75)
    assert sw[0.1][:2] == (3, 3)
    b = M.best_threshold(df, [], st_).first()
    assert b["thr"] == 0.3
    m = M.metrics_bundle(df, 0.3, [], st_).first()
    assert m["acc"] == pytest.approx(0.666667, abs=1e-6)
    assert m["f1"] == pytest.approx(0.75)
    assert m["mcc"] == pytest.approx(0.447214, abs=1e-6)
    assert m["bal_acc"] == pytest.approx(0.666667, abs=1e-6)
    m8 = M.metrics_bundle(df, 0.8, [], st_).first()
    assert (m8["acc"], m8["f1"], m8["mcc"], m8["bal_acc"]) == pytest.approx((0.666667, 0.666667, 0.333333, 0.666667), abs=1e-6)


def test_t3_threshold_ties(spark):
    df = frame(spark, [1, 0, 0, 1], [.9, .5, .4, .2])
    assert M.best_threshold(df, []).first()["thr"] == 0.2
    one = frame(spark, [1, 0, 1], [.7, .7, .7])
    assert M.best_threshold(one, []).first()["thr"] == 0.5


def test_t4_calibration(spark):
    df = frame(spark, [0, 0, 1, 0, 1, 1], [0, .05, 1 / 15, .2, .6, 1.0])
    bins = {r["bin"]: r for r in M.calibration_bins(df, [], 15).collect()}
    assert len(bins) == 15
    assert bins[0]["count"] == 2 and bins[0]["abs_gap"] == pytest.approx(0.025)
    assert bins[1]["count"] == 1 and bins[1]["abs_gap"] == pytest.approx(0.933333, abs=1e-6)
    assert bins[3]["count"] == 1 and bins[3]["abs_gap"] == pytest.approx(0.2)
    assert bins[9]["count"] == 1 and bins[9]["abs_gap"] == pytest.approx(0.4)
    assert sum(b["count"] for b in bins.values()) == 5        # p = 1.0 falls in no bin
    assert bins[2]["count"] == 0 and bins[2]["p_mean"] is None
    assert M.ece(df, [], 15).first()["ece"] == pytest.approx(0.263889, abs=1e-6)
    rel = {r["bin"]: r for r in M.reliability_curve(df, [], 15).collect()}
    assert 14 in rel                                           # right-closed: 1.0 in the last bin


def test_one_class_and_no_positives(spark):
    df = frame(spark, [0, 0, 0], [.1, .2, .3])
    a = M.auc_ap(M.score_stats(df, []), []).first()
    assert a["roc_auc"] is None and a["pr_auc"] == 0.0


def _brute(y, s):
    y, s = np.asarray(y), np.asarray(s)
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    order = np.unique(s)[::-1]
    ap, prev_r = 0.0, 0.0
    for t in order:
        pred = s >= t
        tp = np.sum(pred & (y == 1))
        r = tp / len(pos)
        ap += (r - prev_r) * tp / np.sum(pred)
        prev_r = r
    f1 = {t: 2 * np.sum((s >= t) & (y == 1)) / (np.sum(s >= t) + np.sum(y == 1)) for t in set(s.tolist())}
    best_t = min(t for t in f1 if f1[t] == max(f1.values()))
    return auc, ap, best_t


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12)), min_size=4, max_size=40))
def test_bruteforce_properties(spark, pairs):
    y = [p[0] for p in pairs]
    s = [p[1] / 12 for p in pairs]
    if len(set(y)) < 2 or len(set(s)) < 2:
        return
    df = frame(spark, y, s)
    st_ = M.score_stats(df, [], n_buckets=4)
    a = M.auc_ap(st_, []).first()
    auc, ap, thr = _brute(y, s)
    assert a["roc_auc"] == pytest.approx(auc, abs=1e-12)
    assert a["pr_auc"] == pytest.approx(ap, abs=1e-12)
    assert M.best_threshold(df, [], st_).first()["thr"] == pytest.approx(thr)


def test_quantile_grid_matches_numpy(spark):
    rng = np.random.default_rng(3)
    s = np.round(rng.random(1500), 3)
    df = frame(spark, [0] * len(s), s)
    got = sorted((r["i"], r["value"]) for r in M.quantile_grid(df, [], n_buckets=8).collect())
    want = np.quantile(s, np.linspace(0, 1, 801))
    assert len(got) == 801
    assert np.allclose([v for _, v in got], want, atol=1e-12)


def test_no_single_partition_exchange(spark):
    from corpusrank.plans.fixtures import score_fixture
    fx = score_fixture(spark, "/root/testdata/sf0.001")
    st_ = M.score_stats(fx, ["variant"])
    for df in (M.auc_ap(st_, ["variant"]), M.f1_sweep(fx, ["variant"], st_)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
