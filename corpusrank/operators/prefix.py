"""Exact global ranks and running sums without a single-partition window.

``Window.orderBy(x)`` with no partition key plans ``Exchange SinglePartition``:
one task sorts everything.  Instead rows get a *monotone bucket*; per-bucket
totals (a table of at most groups x buckets rows) give each bucket its offset,
and the window runs partitioned by (group keys, bucket).  The result equals the
unpartitioned window exactly.

Buckets:
* hash orders: leading hex digits of the md5 key (uniform by construction);
* score orders: quantile edges of the *distinct* values, applied with
  ``Bucketizer`` (JVM binary search), so a pile-up of scores in a narrow range
  still spreads over many buckets.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(id_col: str, salt: str) -> Column:
    """md5('<salt>:' || id) as lowercase hex - the deterministic shuffle key."""
    return F.md5(F.concat(F.lit(f"{salt}:"), F.col(id_col).cast("string")))


def hash_bucket(h: Column, digits: int = 4) -> Column:
    """Leading ``digits`` hex digits as an int: monotone in the hash order."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("int")


def _offsets(df: DataFrame, keys: list, bucket: str, sums: dict) -> DataFrame:
    """Per (keys, bucket) totals and the exclusive running totals before each
    bucket.  The frame has at most |groups| x |buckets| rows."""
    tot = df.groupBy(*keys, bucket).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    for n in sums:
        tot = tot.withColumn(f"_o_{n}", F.coalesce(F.sum(f"_t_{n}").over(w), F.lit(0)))
    return tot.drop(*[f"_t_{n}" for n in sums])


def ranked(df: DataFrame, keys: list, bucket: Column, order: list, out: str = "rank",
           digits_hint: int | None = None) -> DataFrame:
    """1-based ``row_number()`` over ``partitionBy(keys).orderBy(order)``.

    ``bucket`` must be non-decreasing along ``order`` within each key group."""
    b = "_bkt"
    x = df.withColumn(b, bucket)
    off = _offsets(x, keys, b, {"n": F.lit(1).cast("long")})
    w = Window.partitionBy(*keys, b).orderBy(*order)
    return (x.join(off, [*keys, b])
             .withColumn(out, (F.col("_o_n") + F.row_number().over(w)).cast("long"))
             .drop(b, "_o_n"))


def ranked_by_hash(df: DataFrame, id_col: str, salt: str, keys: list | None = None,
                   out: str = "rank", digits: int = 4) -> DataFrame:
    """Rank within ``keys`` in the order md5('<salt>:' || id), id."""
    keys = list(keys or [])
    h = "_h"
    x = df.withColumn(h, hash_key(id_col, salt))
    r = ranked(x, keys, hash_bucket(F.col(h), digits), [F.col(h), F.col(id_col)], out=out)
    return r.drop(h)


def quantile_bucketizer(df: DataFrame, col: str, n_buckets: int, out: str,
                        descending: bool = False) -> DataFrame:
    """Attach a monotone bucket id from approximate quantile edges of ``col``.

    Edges (at most n_buckets - 1 doubles) are the only thing brought to the
    driver.  Descending mode flips the id so it grows as ``col`` falls."""
    probs = [i / n_buckets for i in range(1, n_buckets)]
    row = df.agg(F.percentile_approx(F.col(col).cast("double"), probs, 10 * n_buckets).alias("e")).first()
    edges = sorted({float(e) for e in (row["e"] or []) if e is not None and e == e})
    splits = [float("-inf")] + edges + [float("inf")]
    if len(splits) < 3:
        x = df.withColumn(out, F.lit(0).cast("int"))
        return x
    bz = Bucketizer(splits=splits, inputCol=col, outputCol="_bz", handleInvalid="keep")
    x = bz.transform(df.withColumn(col, F.col(col).cast("double")))
    nb = len(splits) - 1
    b = F.col("_bz").cast("int")
    if descending:
        b = F.lit(nb) - b        # NaN lands in bucket nb ("keep"), so it stays last ascending
    return x.withColumn(out, b).drop("_bz")


def running_sums(df: DataFrame, keys: list, order_col: str, sums: dict,
                 descending: bool = True, n_buckets: int = 256,
                 tiebreak: list | None = None, bucket_col: str | None = None) -> DataFrame:
    """Inclusive running sums of ``sums`` (name -> Column) ordered by
    ``order_col`` (descending by default) within ``keys``.

    Intended for tables that are already aggregated to one row per
    (keys, order value); ``tiebreak`` orders rows that share a value."""
    b = "_bkt"
    if bucket_col is None:
        x = quantile_bucketizer(df, order_col, n_buckets, b, descending=descending)
    else:
        x = df.withColumn(b, F.col(bucket_col))
    for n, e in sums.items():
        x = x.withColumn(f"_v_{n}", e)
    off = _offsets(x, keys, b, {n: F.col(f"_v_{n}") for n in sums})
    oc = F.col(order_col).desc() if descending else F.col(order_col).asc()
    w = (Window.partitionBy(*keys, b).orderBy(oc, *(tiebreak or []))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.join(off, [*keys, b])
    for n in sums:
        x = x.withColumn(n, F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(w))
    return x.drop(b, *[f"_v_{n}" for n in sums], *[f"_o_{n}" for n in sums])
