"""Registered text queries on `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusrank.functions import text as T
from corpusrank.plans.common import TD, table
from corpusrank.plans.registry import query
from corpusrank.plans.sql import (sql_bigrams, sql_normalize, sql_remove_stop, sql_tokenize,
                                  sql_vector_tokens)

CAP = TD.w2v_max_tokens_per_doc


def _docs(spark, sf):
    from corpusrank.session import spread
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def _clean(spark, sf):
    return _docs(spark, sf).select("doc_id", T.normalize_text("text").alias("clean"))


@query("normalize_text", sql=f"SELECT doc_id, {sql_normalize('text')} AS clean FROM documents")
def normalize_text(spark, sf):
    """C1-C7 on every document."""
    return _clean(spark, sf)


@query("tokenize", sql=f"""
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, ' ') AS tokens
FROM (SELECT doc_id, {sql_tokenize(sql_normalize('text'), CAP)} AS toks FROM documents)""")
def tokenize(spark, sf):
    """Space tokens of length >= 2, capped at w2v_max_tokens_per_doc."""
    t = _clean(spark, sf).select("doc_id", T.tokenize("clean", CAP).alias("toks"))
    return t.select("doc_id", F.size("toks").cast("long").alias("n_tokens"),
                    F.array_join("toks", " ").alias("tokens"))


@query("vector_tokens", sql=f"""
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, ' ') AS tokens
FROM (SELECT doc_id, {sql_vector_tokens(sql_normalize('text'))} AS toks FROM documents)""")
def vector_tokens(spark, sf):
    """The vectoriser's own tokeniser (word runs of >= 2 characters)."""
    t = _clean(spark, sf).select("doc_id", T.vector_tokens("clean").alias("toks"))
    return t.select("doc_id", F.size("toks").cast("long").alias("n_tokens"),
                    F.array_join("toks", " ").alias("tokens"))


@query("stop_words_removed", sql=f"""
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, ' ') AS tokens
FROM (SELECT doc_id, {sql_remove_stop(sql_vector_tokens(sql_normalize('text')))} AS toks FROM documents)""")
def stop_words_removed(spark, sf):
    """English stop words removed, order and duplicates preserved."""
    t = _clean(spark, sf).select("doc_id", T.remove_stop_words(T.vector_tokens("clean")).alias("toks"))
    return t.select("doc_id", F.size("toks").cast("long").alias("n_tokens"),
                    F.array_join("toks", " ").alias("tokens"))


@query("ngrams", sql=f"""
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_terms, array_to_string(g, '|') AS terms
FROM (SELECT doc_id, {sql_bigrams('toks')} AS g
      FROM (SELECT doc_id, {sql_remove_stop(sql_vector_tokens(sql_normalize('text')))} AS toks FROM documents))""")
def ngrams(spark, sf):
    """C11: unigrams + bigrams over the surviving tokens (the full analyser)."""
    g = T.with_terms(_docs(spark, sf), out="g")
    return g.select("doc_id", F.size("g").cast("long").alias("n_terms"),
                    F.array_join("g", "|").alias("terms"))
