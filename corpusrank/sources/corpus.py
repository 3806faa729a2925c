"""Labelled-corpus scan and corpus-level operators.

The reference keeps texts, labels and times in parallel lists joined by
position.  Here position becomes an explicit key (``doc_id``) and every random
stream is replaced by a deterministic hash order
``md5('<salt>:' || id), id`` that is independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrank.config import Options
from corpusrank.functions.text import safe_text
from corpusrank.operators.prefix import hash_key, ranked_by_hash

# Candidate time-column names, searched in this order.
TIME_COLUMN_CANDIDATES = ("timestamp", "time", "date", "published", "created_at",
                          "created", "published_at")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_corpus(spark: SparkSession, sf_dir: str, opts: Options,
                docs: str = "documents", labels: str = "labels",
                split: str | None = "train") -> DataFrame:
    """A1/A2/A4/A5: documents inner-joined to labels on the id.

    ``split``: when the source has a ``split`` column, keep ``train`` if that
    value exists, otherwise the smallest split name (A2).  Returns
    ``(doc_id, text, label[, doc_time])``."""
    d = read_table(spark, sf_dir, docs)
    lab = read_table(spark, sf_dir, labels)
    return corpus_from(d, lab, opts, split=split)


def corpus_from(docs: DataFrame, labels: DataFrame | None, opts: Options,
                split: str | None = "train") -> DataFrame:
    idc = opts.id_col
    df = docs if labels is None else docs.join(labels, idc, "inner")
    if split is not None and "split" in df.columns:
        has = df.filter(F.col("split") == split).limit(1).count() > 0
        if has:
            df = df.filter(F.col("split") == split)
        else:
            first = df.agg(F.min("split")).first()[0]
            df = df.filter(F.col("split") == first)
    cols = [F.col(idc).alias("doc_id"),
            safe_text(opts.text_col).alias("text"),                     # A4
            F.col(opts.label_col).cast("int").alias("label")]          # A5
    tcol = resolve_time_column(df, opts)
    if tcol is not None:
        cols.append(tcol.alias("doc_time"))
    return df.select(*cols)


def resolve_time_column(df: DataFrame, opts: Options) -> Column | None:
    """First of the candidate names present.  Numeric -> double; timestamp
    -> epoch seconds (an extension); anything else -> None so the caller uses
    the synthetic index (E7).  Only when ``topk_use_real_time``."""
    if not opts.topk_use_real_time:
        return None
    fields = {f.name: f.dataType.typeName() for f in df.schema.fields}
    for cand in TIME_COLUMN_CANDIDATES:
        if cand in fields:
            t = fields[cand]
            if t in ("integer", "long", "short", "byte", "float", "double", "decimal"):
                return F.col(cand).cast("double")
            if t in ("timestamp", "timestamp_ntz", "date"):
                return F.unix_micros(F.col(cand).cast("timestamp")) / F.lit(1e6)
            return None
    return None


def corpus_order(df: DataFrame, opts: Options, id_col: str = "doc_id",
                 out: str = "pos") -> DataFrame:
    """0-based position in the seeded corpus order (md5 of seed and id,
    then id), computed with the bucketed exact rank - no single-partition
    window."""
    r = ranked_by_hash(df, id_col=id_col, salt=str(opts.seed), out="_r")
    return r.withColumn(out, (F.col("_r") - 1).cast("long")).drop("_r")


def cap_corpus(df: DataFrame, opts: Options, id_col: str = "doc_id") -> DataFrame:
    """A3: the first ``max_docs`` rows of the seeded order; 0 keeps all."""
    return seeded_sample(df, opts.max_docs, salt=str(opts.seed), id_col=id_col) if opts.max_docs else df


def seeded_sample(df: DataFrame, n: int, salt: str, id_col: str = "doc_id") -> DataFrame:
    """Exact sample of ``n`` rows without replacement in hash order.

    The rank is bucketed by the hash, so neither a sort of the whole table nor
    one task with ``n`` rows of every other is needed."""
    return ranked_by_hash(df, id_col, salt, out="_rank").filter(F.col("_rank") <= int(n)).drop("_rank")


def binary_target(df: DataFrame, opts: Options, label: str = "label", out: str = "y") -> DataFrame:
    """B1: 1 where label = pos_class, else 0 (kept as is when make_binary is off)."""
    if not opts.make_binary:
        return df.withColumn(out, F.col(label).cast("int"))
    return df.withColumn(out, (F.col(label) == F.lit(int(opts.pos_class))).cast("int"))


def positive_rate(df: DataFrame, y: str = "y") -> DataFrame:
    """B2: share of positives."""
    return df.agg(F.count(F.lit(1)).cast("long").alias("n"),
                  F.sum(y).cast("long").alias("n_pos"),
                  F.round(F.avg(F.col(y).cast("double")), 6).alias("pos_rate"))


def class_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """Balanced class weights n / (n_classes * n_c) per class."""
    from corpusrank.operators.metrics import with_scalars
    per = df.groupBy(y).agg(F.count(F.lit(1)).cast("long").alias("n_c"))
    # totals over the (one row per class) table, attached as literals
    tot = per.agg(F.sum("n_c").cast("long").alias("_n"), F.count(F.lit(1)).cast("long").alias("_k"))
    return (with_scalars(per, tot)
               .select(F.col(y), "n_c", (F.col("_n") / (F.col("_k") * F.col("n_c"))).alias("weight")))


def with_class_weights(df: DataFrame, y: str = "y", out: str = "weight") -> DataFrame:
    w = class_weights(df, y).select(y, F.col("weight").alias(out))
    return df.join(F.broadcast(w), y)   # one row per class
