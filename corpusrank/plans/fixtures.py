"""Score fixtures derived from the given tables (computable in Spark and SQL).

* ``score_fixture``: (1 + cos(embedding, centroid of label 0)) / 2 on
  `embeddings`, y = (label = 0); variant 'r6' rounds to 6 places, 'r2' to 2
  (ties).  The centroid is one vector of the embedding dimension.
* ``events_fixture``: y = (event_type = 'purchase'), score = value / 500 on
  `events` - a pool with more than 800 distinct scores (quantile-grid path).
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrank.functions.vectors import dot, l2_norm
from corpusrank.plans.common import table
from corpusrank.session import cut_lineage


def score_fixture(spark, sf) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    # the centroid is one vector of the embedding dimension: computed by a
    # distributed mean and attached as a literal (no join)
    cen = (emb.filter(F.col("label") == 0)
              .agg(Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>"))).alias("c"))
              .select(vector_to_array("c").alias("c")).first())
    c = F.array(*[F.lit(float(v)) for v in (cen["c"] if cen is not None and cen["c"] is not None else [])])
    x = (emb.withColumn("c", c)
            .select(F.col("vec_id").alias("doc_id"), (F.col("label") == 0).cast("int").alias("y"),
                    ((F.lit(1.0) + dot("embedding", "c") / (l2_norm("embedding") * l2_norm("c"))) / 2.0)
                    .alias("s")))
    r6 = x.select(F.lit("r6").alias("variant"), "doc_id", "y", F.round("s", 6).alias("score"))
    r2 = x.select(F.lit("r2").alias("variant"), "doc_id", "y", F.round("s", 2).alias("score"))
    return r6.unionByName(r2)


def events_fixture(spark, sf) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.select(F.lit("events").alias("variant"), F.col("event_id").alias("doc_id"),
                     (F.col("event_type") == "purchase").cast("int").alias("y"),
                     F.round(F.col("value") / 500.0, 6).alias("score"))


def experiment_fixture(spark, sf, opts=None) -> DataFrame:
    """A scores table shaped like the experiment's output,
    (fold, rep, model, split, doc_id, y, score), from the score fixture:
    stratified folds and inner hold-outs over `embeddings` (y = label 0), two
    candidate 'models' = the two rounding variants of the fixture score."""
    from corpusrank.operators.splits import split_table, stratified_folds
    from corpusrank.plans.common import TD
    opts = opts or TD
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"),
                                                (F.col("label") == 0).cast("int").alias("y"))
    splits = split_table(stratified_folds(emb, opts), opts)
    fx = score_fixture(spark, sf).select(F.col("variant").alias("model"), "doc_id", "score")
    # read by every checkpoint of the metric chain: materialised once
    return cut_lineage(splits.join(fx, "doc_id")
                  .select("fold", F.lit("centroid").alias("rep"), "model", "split", "doc_id", "y", "score"))
