"""Exact dedup by a tree merge of sorted digest runs.

Rows fall into ``fan_in ** rounds`` leaf runs by a hash of their id.  A leaf
run holds one entry per text: digest, byte length, second hash, kept id, count.
In each round ``fan_in`` neighbouring runs merge into one; entries meet only
when digest, length and second hash all agree (the verification), and the kept
id and the count are folded.  The last round leaves one entry per text.

The answer then walks back down: root entries join the leaf entries (at most
one per leaf run, so a text with a third of all rows is 64 entries, never one
group of rows), and the leaf entries join the rows of their own run.

Texts are equal when identical after lower-casing A-Z; null is the empty text.
The row with the largest id stays (``keep="min"``: the smallest).  Null ids
never win against an id; a group of null ids keeps them all.  Repeated rows
(same id and text) share their verdict.  An empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrank.llm.common import ascii_lower, saved, text_or_empty

ENTRY = ["digest", "n_bytes", "second"]


def digest_runs(docs: DataFrame, id_col: str, text_col: str, n_runs: int) -> DataFrame:
    """One narrow row per document, written in sorted runs."""
    norm = ascii_lower(text_or_empty(text_col))
    return saved(
        docs.select(F.col(id_col).alias("id"), norm.alias("t"))
        .select("id", F.pmod(F.xxhash64("id"), F.lit(n_runs)).cast("int").alias("run"),
                F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"),
                F.octet_length("t").alias("n_bytes"), F.xxhash64("t").alias("second"))
        .sortWithinPartitions("run", "digest"), "digest-runs")


def tree_merge(entries: DataFrame, fan_in: int, rounds: int, best) -> DataFrame:
    """Merge neighbouring runs round by round; one entry per text remains."""
    for _ in range(rounds):
        entries = (entries.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
                   .groupBy("run", *ENTRY)
                   .agg(best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    return entries.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max",
                fan_in: int = 4, rounds: int = 3) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)``, one row per document."""
    best = F.max if keep == "max" else F.min
    rows = digest_runs(docs, id_col, text_col, fan_in ** rounds)
    leaves = rows.groupBy("run", *ENTRY).agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    root = tree_merge(leaves, fan_in, rounds, best)
    answers = leaves.select("run", *ENTRY).join(root, ENTRY)
    return (rows.join(answers, ["run", *ENTRY])
            .select(F.col("id").alias(id_col), "keep_id", "group_size",
                    F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))
