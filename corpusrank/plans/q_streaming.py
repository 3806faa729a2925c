"""Registered streaming query: C1 over a file stream of `documents`."""

from __future__ import annotations

from corpusrank.plans.registry import query
from corpusrank.plans.sql import sql_normalize
from corpusrank.streaming.scoring import document_stream, normalized_stream, run_to_table


@query("stream_normalize_text", sql=f"""
SELECT doc_id, {sql_normalize('text')} AS clean,
       CAST(len(list_filter(string_split({sql_normalize('text')}, ' '), lambda t: length(t) >= 2)) AS BIGINT) AS n_tokens
FROM documents""")
def stream_normalize_text(spark, sf):
    """C1 + C8 on readStream; the drained result is read back as a table."""
    s = document_stream(spark, sf, glob="documents.parquet")
    path = run_to_table(normalized_stream(s))
    return spark.read.parquet(path)
