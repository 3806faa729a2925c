"""Row-local operators on ``readStream`` (2.11: the reference has no stream
processor; text normalisation, tokenisation and scoring with fitted models
contain no aggregation, so they run on streams unchanged).

Stateless column expressions go straight into the streaming plan; fitted
representations that aggregate per document (TF-IDF norms, LSA projection)
run per micro-batch through ``foreachBatch``, where each batch is a static
DataFrame.  Progress lives in the checkpoint location, so a restarted query
resumes exactly where it stopped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrank.functions.text import normalize_text, tokenize
from corpusrank.session import ensure_checkpoint_dir


def document_stream(spark: SparkSession, directory: str, glob: str = "*.parquet", schema=None,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream of documents: parquet files in ``directory`` matching
    ``glob`` (new files are picked up by later triggers).  A match may also be a
    folder of parquet files, as Spark writes a table."""
    # a pattern even where it names one table: a plain path has to be a folder
    name = glob if any(c in glob for c in "*?[{") else f"{{{glob}}}"
    path = f"{directory.rstrip('/')}/{name}"
    schema = schema or spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return r.parquet(path)


def normalized_stream(stream: DataFrame, max_tokens: int = 0) -> DataFrame:
    """C1 + C8 on a stream (pure column expressions)."""
    return (stream.select("doc_id", normalize_text("text").alias("clean"))
                  .withColumn("n_tokens", F.size(tokenize("clean", max_tokens)).cast("long")))


def run_to_table(stream: DataFrame, out_dir: str | None = None, batch_fn=None) -> str:
    """Drain the available input (``availableNow``) into a parquet table in
    the shared checkpoint folder; ``batch_fn`` maps each micro-batch (static
    DataFrame) before it is written, each to its own folder.  Returns the path
    pattern that reads the table, without a column for the folders."""
    spark = stream.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    out_dir = out_dir or f"{base}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        b = batch_fn(batch) if batch_fn is not None else batch
        # a folder per batch, overwritten: a replayed batch replaces its rows
        b.write.mode("overwrite").parquet(f"{out_dir}/data/batch-{epoch}")

    q = (stream.writeStream.foreachBatch(write)
               .option("checkpointLocation", f"{out_dir}/_checkpoint")
               .trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{out_dir}/data/batch-*"


def score_stream(stream: DataFrame, representation, model, out_dir: str | None = None) -> str:
    """Score a document stream with a fitted representation and classifier,
    one micro-batch at a time (M13 score in [0, 1])."""
    from corpusrank.operators.embed import as_ml_vector
    from corpusrank.operators.models import model_scores

    def fn(batch: DataFrame) -> DataFrame:
        v = as_ml_vector(representation.transform(batch.select("doc_id", "text")))
        return model_scores(model, v).select("doc_id", "score")

    return run_to_table(stream, out_dir, fn)
