"""Representations as Spark ML estimators: pipelines and persistence."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from corpusrank.config import Options
from corpusrank.functions.text import TextNormalizer
from corpusrank.operators.embed import fit_lsa
from corpusrank.operators.estimators import LsaEmbedding, LsaEstimator, Word2VecEmbedding, Word2VecEstimator
from corpusrank.plans.q_corpus import labelled

LSA = dict(dim=6, minDF=2)
W2V = dict(dim=8, maxIter=1, numPartitions=1)
LSA_FIT, W2V_FIT = LsaEstimator(**LSA), Word2VecEstimator(**W2V)


@pytest.fixture(scope="module")
def corpus(spark):
    return labelled(spark, "/root/testdata/sf0.001").select("doc_id", "text", "y").cache()


@pytest.fixture(scope="module")
def fitted(corpus):
    """Both models, fitted once."""
    return {e: e.fit(corpus) for e in (LSA_FIT, W2V_FIT)}


def _vectors(df, col="features"):
    return {r["doc_id"]: r[col].toArray() for r in df.select("doc_id", col).collect()}


def _same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-12)


def test_lsa_model_equals_operator(corpus, fitted):
    out = fitted[LSA_FIT].transform(corpus)
    assert out.columns == ["doc_id", "text", "y", "features"]
    want = fit_lsa(corpus, Options(lsa_dim=6)).transform(corpus)
    got = _vectors(out)
    for r in want.collect():
        assert got[r["doc_id"]] == pytest.approx(r["vec"], abs=1e-9)


@pytest.mark.parametrize("estimator,model_class", [(LSA_FIT, LsaEmbedding), (W2V_FIT, Word2VecEmbedding)])
def test_model_round_trip(corpus, fitted, tmp_path, estimator, model_class):
    model = fitted[estimator]
    model.write().overwrite().save(str(tmp_path / "m"))
    back = model_class.load(str(tmp_path / "m"))
    assert back.uid == model.uid and back.getOrDefault("dim") == estimator.getOrDefault("dim")
    _same(_vectors(model.transform(corpus)), _vectors(back.transform(corpus)))
    estimator.write().overwrite().save(str(tmp_path / "e"))
    again = type(estimator).load(str(tmp_path / "e"))
    assert {p.name: v for p, v in again.extractParamMap().items()} == {p.name: v for p, v in estimator.extractParamMap().items()}


@pytest.mark.parametrize("estimator", [LsaEstimator(inputCol="clean", **LSA), Word2VecEstimator(inputCol="clean", **W2V)])
def test_in_a_pipeline(corpus, tmp_path, estimator):
    stages = [TextNormalizer("text", "clean"), estimator, LogisticRegression(featuresCol="features", labelCol="y", maxIter=5)]
    model = Pipeline(stages=stages).fit(corpus)
    model.write().overwrite().save(str(tmp_path / "p"))
    back = PipelineModel.load(str(tmp_path / "p"))
    a, b = model.transform(corpus), back.transform(corpus)
    assert a.count() == corpus.count()
    _same(_vectors(a, "probability"), _vectors(b, "probability"))


@pytest.mark.parametrize("estimator", [LSA_FIT, W2V_FIT])
def test_rows_without_known_words(spark, fitted, estimator):
    model = fitted[estimator]
    odd = spark.createDataFrame([(1, "qqqqzz xxxyyy", "a"), (2, None, "b"), (3, "", "c"), (None, "the text", "d")],
                                "doc_id long, text string, vec string")
    out = model.transform(odd)
    assert out.columns == ["doc_id", "text", "vec", "features"] and out.count() == 4     # a clashing name stays
    assert all(not r["features"].toArray().any() for r in out.collect())
    assert model.transform(odd.limit(0)).count() == 0


@pytest.mark.parametrize("estimator", [LsaEstimator(**LSA), Word2VecEstimator(**W2V)])
def test_nothing_to_learn_from(spark, tmp_path, estimator):
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    model = estimator.fit(none)
    model.write().overwrite().save(str(tmp_path / "m"))
    out = type(model).load(str(tmp_path / "m")).transform(none)
    assert all(not r["features"].toArray().any() for r in out.collect())
    assert out.where(F.col("features").isNull()).count() == 0
