"""Stratified, seeded, partition-independent splits.

Random permutations are replaced by the hash order md5('<salt>:' || id), id.
Ranks within a class use the bucketed exact rank (a plain
``partitionBy(label)`` window would give one task per class).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusrank.config import Options
from corpusrank.operators.prefix import hash_bucket, ranked, ranked_by_hash


def stratified_folds(df: DataFrame, opts: Options, y: str = "y", id_col: str = "doc_id",
                     k: int | None = None) -> DataFrame:
    """G1: fold = (class_offset + rank_in_class - 1) % k + 1, where the class
    offset is the number of rows in smaller classes.  Class sizes per fold and
    fold sizes each differ by at most one."""
    k = int(k or opts.outer_folds)
    r = ranked_by_hash(df, id_col=id_col, salt=str(opts.seed), keys=[y], out="_rk")
    cnt = df.groupBy(y).agg(F.count(F.lit(1)).cast("long").alias("_n"))
    w = Window.orderBy(y).rowsBetween(Window.unboundedPreceding, -1)   # one row per class
    off = cnt.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).select(y, "_off")
    return (r.join(F.broadcast(off), y)
             .withColumn("fold", ((F.col("_off") + F.col("_rk") - 1) % k + 1).cast("int"))
             .drop("_rk", "_off"))


def _quotas(part: DataFrame, y: str, val_size: float) -> DataFrame:
    """Per (fold, class) validation quota: ceil(val_size * n) in total,
    floor of the proportional share plus one for the largest remainders
    (ties by class value)."""
    cnt = part.groupBy("fold", y).agg(F.count(F.lit(1)).cast("long").alias("n_c"))
    wf = Window.partitionBy("fold")
    q = (cnt.withColumn("n_part", F.sum("n_c").over(wf))
            .withColumn("n_val", F.ceil(F.lit(float(val_size)) * F.col("n_part")).cast("long"))
            .withColumn("cont", F.col("n_c").cast("double") / F.col("n_part").cast("double")
                        * F.col("n_val").cast("double"))
            .withColumn("flo", F.floor("cont").cast("long"))
            .withColumn("need", F.col("n_val") - F.sum("flo").over(wf))
            .withColumn("rem", F.col("cont") - F.col("flo"))
            .withColumn("rr", F.row_number().over(wf.orderBy(F.col("rem").desc(), F.col(y))))
            .withColumn("quota", F.col("flo") + F.when(F.col("rr") <= F.col("need"), 1).otherwise(0)))
    return q.select("fold", y, "quota")


def split_table(folds: DataFrame, opts: Options, y: str = "y", id_col: str = "doc_id") -> DataFrame:
    """G2 + J1 driver table: for every outer fold f, rows of fold f are
    'test'; the rest are split by a stratified hold-out (salt seed + f) into
    'val' (ceil(inner_val_size * n)) and 'train'.

    Returns (fold, doc_id, y, split).  The input is replicated k times
    (k = number of folds, a small constant)."""
    k = int(opts.outer_folds)
    base = folds.select(F.col(id_col).alias("doc_id"), y, F.col("fold").alias("_own"))
    x = base.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    test = x.filter(F.col("_own") == F.col("fold")).withColumn("split", F.lit("test"))
    part = x.filter(F.col("_own") != F.col("fold"))
    quotas = _quotas(part, y, opts.inner_val_size)
    h = F.md5(F.concat((F.lit(int(opts.seed)) + F.col("fold")).cast("string"), F.lit(":"),
                       F.col("doc_id").cast("string")))
    part = part.withColumn("_h", h)
    r = ranked(part, ["fold", y], hash_bucket(F.col("_h")), [F.col("_h"), F.col("doc_id")], out="_rk")
    inner = (r.join(F.broadcast(quotas), ["fold", y])
              .withColumn("split", F.when(F.col("_rk") <= F.col("quota"), "val").otherwise("train")))
    cols = ["fold", "doc_id", y, "split"]
    return inner.select(*cols).unionByName(test.select(*cols))


def gather(splits: DataFrame, features: DataFrame, on: str = "doc_id") -> DataFrame:
    """Index gather of features for the split rows (inner equi-join)."""
    return splits.join(features, on, "inner")
