"""Token counts from an exact length histogram.

Every whole text is encoded once, inside Spark tasks; only its length leaves.
The histogram has one row per distinct length.  Suffix sums over it (documents
and tokens at this length or above) answer every question about context limits
exactly: totals, quantiles, and what a limit would truncate.

The suffix sums run in blocks of lengths: each block is a window of its own, and
the block totals, at most longest text / block rows, are summed once more.  The
number of documents never matters for that.

Null and empty texts have length 0; repeated rows count each; ids are not
looked at.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusrank.llm.common import saved
from corpusrank.llm.tokens import default_path, encode


def lengths(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(length)`` of every document."""
    path = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"length": np.array([len(encode(t, path)) for t in pdf["text"]], dtype=np.int64)})

    return docs.select(F.col(text_col).alias("text")).mapInPandas(run, "length long")


def histogram(docs: DataFrame, text_col: str = "text", path: str | None = None, block: int = 1024) -> DataFrame:
    """One row per distinct length: ``length, n_docs, n_tokens`` at that length,
    ``docs_at_least, tokens_at_least`` (suffix sums), ``docs_at_most``,
    ``total_docs, total_tokens``, and ``truncated_tokens``, what remains of all
    tokens under a context limit of ``length``."""
    # one row per length, written once: the texts are not encoded again for each use
    own = (saved(lengths(docs, text_col, path).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")
           .withColumn("n_tokens", F.col("length") * F.col("n_docs"))
           .withColumn("block", F.expr(f"length div {block}")))
    up = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = (own.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
              .select("block", F.coalesce(F.sum("d").over(up), F.lit(0)).alias("docs_above"),
                      F.coalesce(F.sum("t").over(up), F.lit(0)).alias("tokens_above"),
                      F.sum("d").over(whole).alias("total_docs"), F.sum("t").over(whole).alias("total_tokens")))
    inside = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (own.withColumn("docs_at_least", F.sum("n_docs").over(inside))
            .withColumn("tokens_at_least", F.sum("n_tokens").over(inside))
            .join(blocks, "block")
            .select("length", "n_docs", "n_tokens",
                    (F.col("docs_at_least") + F.col("docs_above")).alias("docs_at_least"),
                    (F.col("tokens_at_least") + F.col("tokens_above")).alias("tokens_at_least"),
                    "total_docs", "total_tokens")
            .withColumn("docs_at_most", F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs"))
            .withColumn("truncated_tokens", F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")))


def under_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """``(limit, docs_over, truncated_tokens)`` for any context limits: the
    first length above a limit holds its suffix sums."""
    spark = hist.sparkSession
    at = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    total = hist.agg(F.max("total_tokens")).first()[0] or 0
    above = (at.join(hist, hist["length"] > at["limit"]).groupBy("limit")
             .agg(F.max("docs_at_least").alias("docs_over"), F.max("tokens_at_least").alias("tokens_over")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (at.join(above, "limit", "left")
            .select("limit", zero("docs_over").alias("docs_over"),
                    (F.lit(total) - zero("tokens_over") + F.col("limit") * zero("docs_over")).alias("truncated_tokens")))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """``(share, length)``: the smallest length that at least this share of the
    documents does not exceed."""
    at = hist.sparkSession.createDataFrame([(float(q),) for q in shares], "share double")
    return (at.join(hist, hist["docs_at_most"] >= at["share"] * hist["total_docs"])
            .groupBy("share").agg(F.min("length").alias("length")))
