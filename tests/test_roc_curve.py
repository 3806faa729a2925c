"""E1 without collinear points, against the definition."""

import random

import pytest

from corpusrank.operators import metrics as M


def _kept(y, s):
    order = sorted(set(s), reverse=True)
    gains = [(sum(b for a, b in zip(s, y) if a == t), sum(1 - b for a, b in zip(s, y) if a == t)) for t in order]
    return [t for i, t in enumerate(order) if i in (0, len(order) - 1) or gains[i] != gains[i + 1]]


def test_golden(spark):
    y, s = [0, 0, 1, 1, 1, 1, 0], [0.1, 0.4, 0.35, 0.8, 0.9, 0.95, 0.05]
    df = spark.createDataFrame(list(zip(y, s)), "y int, score double")
    got = {r["threshold"]: (r["fpr"], r["tpr"]) for r in M.roc_curve(M.score_stats(df, []), []).collect()}
    # 0.9 lies between 0.95 and 0.8 on one line; 0.1 lies between 0.35 and 0.05
    assert set(got) == {None, 0.95, 0.8, 0.4, 0.35, 0.05} | ({0.1} if 0.1 in _kept(y, s) else set())
    assert got[None] == (0.0, 0.0) and got[0.05] == (1.0, 1.0) and got[0.4] == pytest.approx((1 / 3, 3 / 4))


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_borders_of_buckets(spark, buckets):
    rng = random.Random(7)
    rows = [(g, rng.choice([0, 0, 1]), rng.randrange(80) / 80) for g in "ab" for _ in range(150)]
    stats = M.score_stats(spark.createDataFrame(rows, "g string, y int, score double"), ["g"])
    got = M.roc_curve(stats, ["g"], n_buckets=buckets).collect()
    for g in "ab":
        y, s = [r[1] for r in rows if r[0] == g], [r[2] for r in rows if r[0] == g]
        assert sorted((r["threshold"] for r in got if r["g"] == g and r["threshold"] is not None), reverse=True) == _kept(y, s)


def test_no_single_partition(spark):
    df = spark.createDataFrame([(i % 2, i / 50) for i in range(50)], "y int, score double")
    plan = M.roc_curve(M.score_stats(df, []), [])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
