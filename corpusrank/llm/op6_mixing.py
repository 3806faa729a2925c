"""Mixing sources to target weights by capped water-filling.

Word counts are summed per source (one row per source, the mixture's own
table, is all that reaches the driver).  Every source's share of the total
follows its weight; a source whose share exceeds ``max_epochs`` times its words
is clamped there, and the excess is dealt again by weight over the others until
none is above.

A source's target is met by whole repetitions of all its documents plus one
fractional repetition: documents in a seeded hash order up to the remaining
words; the document at the edge gives the words that still fit.  The running
sum is exact and distributed: per (source, hash bucket) totals give every
bucket its start, and the window runs inside a bucket, so a source with a third
of all rows is 4096 small windows.

Null text has no words; null is a source of its own, after all others.  Null
ids are ordered as one value; repeated rows count as rows of their own.  An
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusrank.llm.common import WORD, saved, text_or_empty

# The weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)


def water_fill(sizes: list[int], weights: list[int], max_epochs: int) -> list[float]:
    """Targets that follow the weights and sum to all words, none above
    ``max_epochs`` times its source."""
    target, free = [0.0] * len(sizes), set(range(len(sizes)))
    rest = sum(sizes)
    while free:
        total = sum(weights[i] for i in free)
        over = {i for i in free if rest * weights[i] > max_epochs * sizes[i] * total}
        if not over:
            for i in free:
                target[i] = rest * weights[i] / total
            break
        for i in over:
            target[i] = float(max_epochs * sizes[i])
            rest -= max_epochs * sizes[i]
        free -= over
    return target


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = 3, seed: int = 42, bucket_digits: int = 3,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, size, source, source_size, target, taken)``, one row per document."""
    spark = docs.sparkSession
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = saved(docs.select(F.col(id_col), F.col(source_col).alias("source"), order.alias("place"),
                             F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"))
                 .withColumn("key", F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source")))
                 .withColumn("bucket", F.substring("place", 1, bucket_digits)), "sizes")
    buckets = rows.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    totals = sorted((r["key"], r["words"]) for r in buckets.groupBy("key").agg(F.sum("words").alias("words")).collect())
    sizes = [n for _, n in totals]
    target = water_fill(sizes, [weights[i % len(weights)] for i in range(len(totals))], max_epochs)
    plan = spark.createDataFrame([(k, n, t, int(t + 0.5)) for (k, n), t in zip(totals, target)],
                                 "key string, source_size long, target double, budget long")
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (buckets.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
              .join(plan, "key").select("key", "bucket", "start", "source_size", "target", "budget"))
    inside = (Window.partitionBy("key", "bucket").orderBy("place", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    at = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    rest = F.expr("if(source_size > 0, budget % source_size, 0)")
    whole = F.expr("if(source_size > 0, budget div source_size, 0)")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("at")))
    return (rows.join(starts, ["key", "bucket"]).withColumn("at", at)
            .select(id_col, "size", "source", "source_size", "target",
                    (whole * F.col("size") + part).cast("long").alias("taken")))


def repeated(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` in the proportions of ``mixed``: every document once per whole
    repetition, and once more when at least half of it lies in the fractional
    one.  Documents without words weigh nothing in the mixture and have no copy.
    Keeps the columns of ``docs``; repeated rows of an id share a count."""
    copies = F.expr("if(size > 0, int(floor(taken / size + 0.5D)), 0)")
    n = mixed.select(F.col(id_col).alias("id"), copies.alias("copies")).groupBy("id").agg(F.max("copies").alias("copies"))
    d = docs.select(F.struct(*docs.columns).alias("d"))       # extra columns can't clash with ours
    return (d.join(saved(n.where("copies > 0"), "copies"), F.col(f"d.{id_col}").eqNullSafe(F.col("id")))
            .select("d", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("d.*"))
