"""Vector helpers."""

import math

import pytest

from corpusrank.functions import vectors as V


def test_vector_helpers(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0], 0.0), ([0.0, 0.0], [2.0, 2.0], 2.0)],
                               "a array<double>, b array<double>, z double")
    r = df.select(V.dot("a", "b").alias("d"), V.l2_norm("a").alias("n"), V.l2_normalize("a").alias("u"),
                  V.sigmoid("z").alias("s"), V.to_float32("a").alias("f")).collect()
    assert r[0]["d"] == 3.0 and r[0]["n"] == 5.0 and r[0]["u"] == pytest.approx([0.6, 0.8])
    assert r[1]["u"] == [0.0, 0.0]                           # a zero vector stays zero
    assert r[0]["s"] == 0.5 and r[1]["s"] == pytest.approx(1 / (1 + math.exp(-2)))
    assert dict(df.select(V.to_float32("a").alias("f")).dtypes)["f"] == "array<float>"
