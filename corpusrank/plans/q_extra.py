"""Registered queries of operators that other queries only use inside."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusrank.functions import text as T
from corpusrank.functions.vectors import sigmoid, to_float32
from corpusrank.operators.embed import mean_pool
from corpusrank.plans.common import TD, emb_vectors, table
from corpusrank.plans.q_selection import fold_results
from corpusrank.plans.registry import ORACLES, query
from corpusrank.plans.sql import sql_normalize, sql_tokenize, unit_vectors_cte
from corpusrank.session import ensure_checkpoint_dir
from corpusrank.sources import corpus as C
from corpusrank.sources import results as RS


@query("split_choice", sql="""SELECT d.doc_id, CAST(l.quality AS INTEGER) AS label
FROM documents d JOIN labels l USING (doc_id) WHERE d.source = 'src0'""")
def split_choice(spark, sf):
    """A2: a source with a split column keeps `train`."""
    d = table(spark, sf, "documents").withColumn("split", F.when(F.col("source") == "src0", "train").otherwise("test"))
    return C.corpus_from(d, table(spark, sf, "labels"), TD).select("doc_id", "label")


@query("resolved_time", sql="SELECT event_id, round(epoch_us(ts) / 1000000.0, 3) AS doc_time FROM events")
def resolved_time(spark, sf):
    """The first candidate time column, a timestamp as epoch seconds."""
    e = table(spark, sf, "events").withColumnRenamed("ts", "timestamp")
    c = C.resolve_time_column(e, TD.replace(topk_use_real_time=True))
    return e.select("event_id", F.round(c, 3).alias("doc_time"))


@query("url_masking", sql=f"SELECT page_id, {sql_normalize('url')} AS clean FROM pages")
def url_masking(spark, sf):
    """C3 on real URLs."""
    return table(spark, sf, "pages").select("page_id", T.normalize_text("url").alias("clean"))


@query("trainable_docs", sql=f"""SELECT doc_id FROM documents
WHERE len({sql_tokenize(sql_normalize('text'))}) > 0""")
def trainable_docs(spark, sf):
    """Documents without a token are dropped before Word2Vec."""
    d = table(spark, sf, "documents")
    return d.where(F.size(T.tokenize(T.normalize_text("text"))) > 0).select("doc_id")


@query("margin_scores", sql="""SELECT vec_id, round(1.0 / (1.0 + exp(-4 * CAST(embedding[1] AS DOUBLE))), 6) AS score FROM embeddings""")
def margin_scores(spark, sf):
    """Sigmoid of a raw margin."""
    return table(spark, sf, "embeddings").select(
        "vec_id", F.round(sigmoid(F.col("embedding")[0].cast("double") * 4), 6).alias("score"))


@query("float32_vectors", sql=f"""WITH {unit_vectors_cte()}
SELECT doc_id, round(CAST(CAST(v[1] AS FLOAT) AS DOUBLE), 6) AS x0, CAST(len(v) AS BIGINT) AS dim FROM emb_unit""")
def float32_vectors(spark, sf):
    """Vectors stored in single precision."""
    v = emb_vectors(spark, sf).select("doc_id", to_float32("vec").alias("v"))
    return v.select("doc_id", F.round(F.col("v")[0].cast("double"), 6).alias("x0"), F.size("v").cast("long").alias("dim"))


@query("mean_pooling", sql=f"""WITH tk AS (SELECT doc_id, unnest({sql_tokenize(sql_normalize('text'))}) AS term FROM documents),
n AS (SELECT count(*) AS n FROM embeddings),
tv AS (SELECT doc_id, (length(term) * 31 + ascii(term)) % (2 * n.n) AS vec_id FROM tk, n),
x AS (SELECT tv.doc_id, unnest(generate_series(1, len(embedding))) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM tv JOIN embeddings USING (vec_id)),
m AS (SELECT doc_id, i, avg(x) AS m FROM x GROUP BY doc_id, i),
nr AS (SELECT doc_id, sqrt(sum(m * m)) AS nrm, count(*) AS dim FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(round(m.m / nr.nrm, 6), 0) AS x0, CASE WHEN nr.doc_id IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS norm
FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id AND m.i = 1 LEFT JOIN nr ON nr.doc_id = d.doc_id""")
def mean_pooling(spark, sf):
    """Word vectors looked up by token and mean-pooled; tokens are
    hashed onto the rows of `embeddings`, half of them to no row."""
    emb = table(spark, sf, "embeddings")
    n = emb.count()
    docs = table(spark, sf, "documents")
    tok = docs.select("doc_id", F.explode(T.tokenize(T.normalize_text("text"))).alias("t"))
    tok = tok.select("doc_id", ((F.length("t") * 31 + F.ascii("t")) % F.lit(2 * n)).cast("long").alias("term"))
    v = mean_pool(tok, emb.select(F.col("vec_id").alias("term"), F.col("embedding").cast("array<double>").alias("vec")), docs, 64)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return v.select("doc_id", F.round(F.col("vec")[0], 6).alias("x0"), F.round(norm, 6).alias("norm"))


def _round_trip(fmt):
    def run(spark, sf):
        df = fold_results(spark, sf)
        out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sinks-{uuid.uuid4().hex}"
        RS.write_table(df, out, "results_folds")
        back = RS.read_back(spark, f"{out}/results_folds.{fmt}", max_head_rows=1_000_000)
        return back.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return run


for _fmt in ("csv", "parquet"):
    _f = _round_trip(_fmt)
    _f.__doc__ = f"A7/A9/S7: fold results written as {_fmt} and read back."
    query(f"sink_{_fmt}", sql=ORACLES["fold_results"])(_f)
