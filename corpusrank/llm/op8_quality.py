"""Quality rules with cross-document line frequency.

Base rules are counted inside each row from its word array.  For the method's
verdict every line with a word is normalised (A-Z lowered, white space
collapsed) and hashed; a host's documents with a line are counted once per
distinct document text (so copies of one document are not taken for
boilerplate); lines found in more than ``max_docs`` of them, whatever the host's size,
or in more than ``min_docs`` and more than ``share`` of the host's, are removed, and a
document of which less than ``min_left`` of the words remains is rejected.

Only hashes leave the scan.  Counting is a map-side combined sum per
(host, line); the lines above a limit are few by arithmetic (a host has at most its
lines / min_docs of them).

Null text has no words and fails the base rules; null hosts form one host;
documents with a null id are judged like others but no line is removed from
them.  Repeated rows of an id are one document and share a verdict.  An empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusrank.llm.common import SPACE, WORD, ascii_lower, saved, text_or_empty, words

# Symbol characters and white space.
SYMBOLS = r"[#*$%&|<>]+"
PACKED = 1 << 16


def repeat_words(word_hashes: str) -> Column:
    """Words covered by 3-word windows that occur at least twice.

    Windows are 64-bit hashes.  Sorting hash-high-bits | position, with as many low
    bits as the text's positions need, brings equal windows together, and the full
    hashes confirm neighbours; texts of more than ``PACKED`` windows sort (hash,
    position) pairs instead, as their positions would take too many bits.  The covered
    words are the sum of min(3, distance to the next such window)."""
    packed = """filter(transform(_sorted, (x, i) -> IF(
            (i > 0 AND (_sorted[i - 1] & ~_mask) = (x & ~_mask) AND _win[int(_sorted[i - 1] & _mask)] = _win[int(x & _mask)])
            OR (i < size(_sorted) - 1 AND (_sorted[i + 1] & ~_mask) = (x & ~_mask) AND _win[int(_sorted[i + 1] & _mask)] = _win[int(x & _mask)]),
            int(x & _mask), -1)), p -> p >= 0)"""
    paired = """filter(transform(_pairs, (x, i) -> IF((i > 0 AND _pairs[i - 1].h = x.h) OR (i < size(_pairs) - 1 AND _pairs[i + 1].h = x.h),
            x.i, -1)), p -> p >= 0)"""
    return F.expr(f"""
      CASE WHEN size({word_hashes}) < 4 OR size(array_distinct(_win)) = size(_win) THEN 0L
      ELSE aggregate(
        array_sort(CASE WHEN size(_win) <= {PACKED} THEN {packed} ELSE {paired} END),
        named_struct('n', 0L, 'last', -3),
        (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p),
        a -> a.n) END""")


def base_counts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    t = F.col("_t")
    x = docs.select(F.col(id_col), F.col(host_col).alias("host"), text_or_empty(text_col).alias("_t"))
    x = x.withColumn("_wh", F.transform(words(t), lambda w: F.xxhash64(w)))
    x = x.withColumn("_win", F.expr("""IF(size(_wh) < 3, array(), transform(sequence(0, size(_wh) - 3),
        i -> xxhash64(_wh[i], _wh[i + 1], _wh[i + 2])))"""))
    x = x.withColumn("_mask", F.expr("shiftleft(1L, int(floor(log2(size(_win) + 1))) + 1) - 1"))
    x = x.withColumn("_sorted", F.expr(f"IF(size(_win) <= {PACKED}, array_sort(transform(_win, (h, i) -> (h & ~_mask) | i)), NULL)"))
    x = x.withColumn("_pairs", F.expr(f"IF(size(_win) > {PACKED}, array_sort(transform(_win, (h, i) -> struct(h, i))), NULL)"))
    x = x.withColumn("_lines", F.filter(F.split(t, "\n"), lambda s: s.rlike(WORD)))
    return x.select(
        id_col, "host",
        F.size("_wh").cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words("_wh").alias("n_repeat_words"),
        F.xxhash64(t).alias("text_hash"),
        F.transform("_lines", lambda s: F.struct(
            F.xxhash64(F.trim(F.regexp_replace(ascii_lower(s), SPACE, " "))).alias("line"),
            F.regexp_count(s, F.lit(WORD)).alias("n"))).alias("lines"))


def quality(docs: DataFrame, share: float = 0.1, min_docs: int = 20, max_docs: int = 100, min_left: float = 0.3,
            id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, removed_words, kept)``, one row per document."""
    rows = saved(base_counts(docs, id_col, text_col, host_col)
                 .withColumn("host", F.coalesce(F.concat(F.lit("h"), "host"), F.lit("null"))), "quality")
    # one row per distinct text of a host stands for its copies
    texts = rows.groupBy("host", "text_hash").agg(F.min(id_col).alias("rep"))
    n_docs = texts.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    lines = rows.select(id_col, "host", "text_hash", F.explode("lines").alias("l")).select(
        id_col, "host", "text_hash", F.col("l.line").alias("line"), F.col("l.n").alias("n"))
    reps = texts.select("host", "text_hash", F.col("rep").alias(id_col))
    once = (rows.select(id_col, "host", "text_hash", F.array_distinct(F.transform("lines", lambda l: l["line"])).alias("ls"))
            .join(reps, [id_col, "host", "text_hash"], "left_semi")
            .dropDuplicates([id_col, "host", "text_hash"])
            .select("host", F.explode("ls").alias("line")))
    common = (once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("df"))
              .where(F.col("df") > min_docs)
              .join(n_docs, "host").where((F.col("df") > max_docs) | (F.col("df") > share * F.col("host_docs"))).select("host", "line"))
    removed = (lines.join(common, ["host", "line"], "left_semi")
               .groupBy(id_col, "text_hash").agg(F.sum("n").alias("removed_words")))
    copies = rows.groupBy(id_col, "text_hash").agg(F.count(F.lit(1)).alias("n_rows"))
    removed = removed.join(copies, [id_col, "text_hash"]).select(
        id_col, "text_hash", (F.col("removed_words") / F.col("n_rows")).cast("long").alias("removed_words"))
    out = rows.drop("lines").join(removed, [id_col, "text_hash"], "left").withColumn(
        "removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("n_words") - F.col("removed_words") < min_left * F.col("n_words")
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), "removed_words", (~failed & ~depleted).alias("kept"))
