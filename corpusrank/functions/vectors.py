"""Dense-vector functions as Column expressions over ``array<double>``.

Spark 4.1 has no built-in dot/cosine for arrays, so these are higher-order
function compositions; they stay in the JVM and need no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double_array(c) -> Column:
    return _c(c).cast("array<double>")


def dot(a, b) -> Column:
    """Sum of element-wise products."""
    return F.aggregate(F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y),
                       F.lit(0.0), lambda s, v: s + v)


def l2_norm(a) -> Column:
    """Euclidean norm."""
    return F.sqrt(F.aggregate(F.transform(as_double_array(a), lambda x: x * x),
                              F.lit(0.0), lambda s, v: s + v))


def l2_normalize(a) -> Column:
    """Row L2 normalisation; a zero vector stays zero (C14)."""
    n = l2_norm(a)
    d = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return F.transform(as_double_array(a), lambda x: x / d)


def sigmoid(z) -> Column:
    """Logistic function 1/(1+e^-z)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def to_float32(a) -> Column:
    """Optional float32 storage of a vector (C15); we compute in double."""
    return _c(a).cast("array<float>")


def round_array(a, places: int = 6) -> Column:
    return F.transform(as_double_array(a), lambda x: F.round(x, places))
