"""Row-local operators on readStream (2.11): normalisation and scoring with
fitted models, drained with availableNow into the checkpoint folder."""

from pyspark.sql import functions as F

from corpusrank.config import Options
from corpusrank.operators.embed import as_ml_vector, fit_lsa
from corpusrank.operators.models import fit_model
from corpusrank.plans.q_corpus import labelled
from corpusrank.streaming.scoring import document_stream, normalized_stream, run_to_table, score_stream

SF = "/root/testdata/sf0.001"
O = Options(label_col="quality", pos_class=1, lsa_dim=8, logreg_max_iter=20)


def test_normalized_stream(spark):
    path = run_to_table(normalized_stream(document_stream(spark, SF, glob="documents.parquet")))
    out = spark.read.parquet(path)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert set(out.columns) == {"doc_id", "clean", "n_tokens"}


def test_table_as_a_folder_of_files(spark, tmp_path):
    rows = [(i, f"Word{i} two") for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(99, "other")], "doc_id long, text string").write.parquet(str(tmp_path / "labels.parquet"))
    out = spark.read.parquet(run_to_table(normalized_stream(document_stream(spark, str(tmp_path), glob="documents.parquet"))))
    assert sorted((r["doc_id"], r["clean"], r["n_tokens"]) for r in out.collect()) == [(i, f"word{i} two", 2) for i in range(12)]
    few = run_to_table(normalized_stream(document_stream(spark, str(tmp_path), glob="doc*.parquet", max_files_per_trigger=1)))
    assert spark.read.parquet(few).count() == 12


def test_score_stream(spark):
    c = labelled(spark, SF)
    rep = fit_lsa(c, O)
    x = as_ml_vector(rep.transform(c).join(c.select("doc_id", "y"), "doc_id"))
    model = fit_model("logreg", x, O)
    path = score_stream(document_stream(spark, SF, glob="documents.parquet"), rep, model)
    out = spark.read.parquet(path)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert out.count() == n
    lo, hi = out.agg(F.min("score"), F.max("score")).first()
    assert 0.0 <= lo <= hi <= 1.0
