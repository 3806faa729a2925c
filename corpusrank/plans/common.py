"""Shared inputs for the registered queries over /root/testdata-style tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrank.config import Options
from corpusrank.operators.retrieval import unit_vectors
from corpusrank.sources.corpus import read_table

# The given tables carry the target in `labels.quality` (0/1); class 1 is positive.
TD = Options(label_col="quality", pos_class=1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def emb_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, vec) unit vectors of the `embeddings` table."""
    return unit_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def emb_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
