"""The corpus pipeline: five stages over `documents`, each reading what its
predecessor kept.

STAGES lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which the caller writes as Parquet and reads again.
All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrank.llm import op4_toxicity, op6_mixing, op7_minhash, op9_packing, op10_line_dedup
from corpusrank.llm.common import read, saved


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = op4_toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return op4_toxicity.reject(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-equal lines one occurrence stays; a document that
    has lost all its lines goes.  `n_chars` follows the text."""
    out = op10_line_dedup.apply(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the smallest id."""
    gone = op7_minhash.near_dedup(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated in the proportions of the mixture."""
    return op6_mixing.repeated(docs, op6_mixing.mix(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return op9_packing.pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("mixing", mixing), ("packing", packing)]

# Trained scores, hashes and a tokenizer: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
