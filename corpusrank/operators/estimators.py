"""Spark ML ``Estimator``/``Model`` pairs of the representations.

``LsaEstimator`` and ``Word2VecEstimator`` fit on a text column and give a model
that appends a unit vector (an ML vector, zero where a text has no known term), so
both work as stages of a ``Pipeline`` and in front of a classifier.  Rows are joined
by ``idCol``: it must be unique; a row with a null id gets the zero vector.

A saved model is its metadata plus the tables it holds (vocabulary and basis, or
word vectors) as Parquet; nothing of vocabulary size passes through the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import Word2VecModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrank.config import DEFAULT, Options
from corpusrank.operators import blocks as B
from corpusrank.operators.embed import LsaModel, W2vModel, fit_lsa, fit_w2v
from corpusrank.operators.tfidf import TfidfModel


class _TextParams(HasInputCol, HasOutputCol, HasSeed):
    idCol = Param(Params._dummy(), "idCol", "column of unique row ids", TypeConverters.toString)
    dim = Param(Params._dummy(), "dim", "dimensions of a vector (at most)", TypeConverters.toInt)

    def _rows(self, df: DataFrame) -> DataFrame:
        return df.select(F.col(self.getOrDefault("idCol")).alias("doc_id"), F.col(self.getInputCol()).alias("text"))

    def _appended(self, df: DataFrame, vec: DataFrame, dim: int) -> DataFrame:
        id_col, out = self.getOrDefault("idCol"), self.getOutputCol()
        zero = F.array_repeat(F.lit(0.0), int(dim))
        v = vec.select(F.col("doc_id").alias("_vec_id"), F.col("vec").alias("_vec"))
        return (df.join(v, df[id_col] == F.col("_vec_id"), "left")
                .withColumn(out, array_to_vector(F.coalesce("_vec", zero))).drop("_vec_id", "_vec"))


class _LsaParams(_TextParams):
    maxFeatures = Param(Params._dummy(), "maxFeatures", "terms kept (0: all)", TypeConverters.toInt)
    minDF = Param(Params._dummy(), "minDF", "documents a term must occur in", TypeConverters.toInt)
    ngramMax = Param(Params._dummy(), "ngramMax", "longest n-gram", TypeConverters.toInt)

    def _options(self) -> Options:
        p = self.getOrDefault
        return DEFAULT.replace(lsa_dim=p("dim"), lsa_max_features=p("maxFeatures"), tfidf_max_features=p("maxFeatures"),
                               tfidf_min_df=p("minDF"), tfidf_ngram_max=p("ngramMax"), seed=p("seed"))


class _Word2VecParams(_TextParams):
    windowSize = Param(Params._dummy(), "windowSize", "words on each side", TypeConverters.toInt)
    minCount = Param(Params._dummy(), "minCount", "occurrences a word must have", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "passes over the corpus", TypeConverters.toInt)
    numPartitions = Param(Params._dummy(), "numPartitions", "partitions trained apart", TypeConverters.toInt)

    def _options(self) -> Options:
        p = self.getOrDefault
        return DEFAULT.replace(w2v_dim=p("dim"), w2v_window=p("windowSize"), w2v_min_count=p("minCount"),
                               w2v_epochs=p("maxIter"), w2v_partitions=p("numPartitions"), seed=p("seed"))


class LsaEstimator(Estimator, _LsaParams, DefaultParamsReadable, DefaultParamsWritable):
    """TF-IDF and truncated SVD (M1-M4) as an ML estimator."""

    @keyword_only
    def __init__(self, *, inputCol="text", outputCol="features", idCol="doc_id", dim=DEFAULT.lsa_dim,
                 maxFeatures=DEFAULT.lsa_max_features, minDF=DEFAULT.tfidf_min_df, ngramMax=DEFAULT.tfidf_ngram_max,
                 seed=DEFAULT.seed):
        super().__init__()
        self._set(**{"inputCol": inputCol, "outputCol": outputCol, "idCol": idCol, "dim": dim, "maxFeatures": maxFeatures,
                     "minDF": minDF, "ngramMax": ngramMax, "seed": seed})

    def _fit(self, df: DataFrame) -> LsaEmbedding:
        rows = self._rows(df).filter(F.col("doc_id").isNotNull())
        return self._copyValues(LsaEmbedding(fit_lsa(rows, self._options())))


class Word2VecEstimator(Estimator, _Word2VecParams, DefaultParamsReadable, DefaultParamsWritable):
    """Mean-pooled Word2Vec (M5-M7) as an ML estimator."""

    @keyword_only
    def __init__(self, *, inputCol="text", outputCol="features", idCol="doc_id", dim=DEFAULT.w2v_dim,
                 windowSize=DEFAULT.w2v_window, minCount=DEFAULT.w2v_min_count, maxIter=DEFAULT.w2v_epochs,
                 numPartitions=DEFAULT.w2v_partitions, seed=DEFAULT.seed):
        super().__init__()
        self._set(**{"inputCol": inputCol, "outputCol": outputCol, "idCol": idCol, "dim": dim, "windowSize": windowSize,
                     "minCount": minCount, "maxIter": maxIter, "numPartitions": numPartitions, "seed": seed})

    def _fit(self, df: DataFrame) -> Word2VecEmbedding:
        rows = self._rows(df).filter(F.col("doc_id").isNotNull())
        return self._copyValues(Word2VecEmbedding(fit_w2v(rows, self._options()).model))


class LsaEmbedding(Model, _LsaParams, MLWritable, MLReadable):
    """Fitted by ``LsaEstimator``; ``lsa`` is the operator's own model."""

    def __init__(self, lsa: LsaModel | None = None):
        super().__init__()
        self.lsa = lsa

    def _transform(self, df: DataFrame) -> DataFrame:
        rows = self._rows(df).filter(F.col("doc_id").isNotNull())
        return self._appended(df, self.lsa.transform(rows), self.lsa.k)

    def write(self) -> MLWriter:
        return _LsaWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _LsaReader(cls)


class Word2VecEmbedding(Model, _Word2VecParams, MLWritable, MLReadable):
    """Fitted by ``Word2VecEstimator``; ``words`` is None where no text had a word."""

    def __init__(self, words: Word2VecModel | None = None):
        super().__init__()
        self.words = words

    def _transform(self, df: DataFrame) -> DataFrame:
        opts = self._options()
        rows = self._rows(df).filter(F.col("doc_id").isNotNull())
        return self._appended(df, W2vModel(self.words, opts).transform(rows), opts.w2v_dim)

    def write(self) -> MLWriter:
        return _Word2VecWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Word2VecReader(cls)


class _Writer(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def _metadata(self, path: str, **extra) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata=extra)


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def _metadata(self, path: str) -> dict:
        return DefaultParamsReader.loadMetadata(path, self.sparkSession, self.cls.__module__ + "." + self.cls.__name__)

    def _instance(self, model, meta: dict):
        DefaultParamsReader.getAndSetParams(model, meta)
        model._resetUid(meta["uid"])
        return model


class _LsaWriter(_Writer):
    def saveImpl(self, path: str) -> None:
        m = self.instance.lsa
        self._metadata(path, n_docs=int(m.tfidf.n_docs), k=int(m.k), singular_values=[float(s) for s in m.singular_values],
                       cols_per_block=B.COLS_PER_BLOCK)
        m.tfidf.vocab.write.parquet(f"{path}/vocabulary")
        m.basis.write.parquet(f"{path}/basis")


class _LsaReader(_Reader):
    def load(self, path: str) -> LsaEmbedding:
        meta = self._metadata(path)
        if meta["cols_per_block"] != B.COLS_PER_BLOCK:
            raise ValueError(f"the basis at {path} is in blocks of {meta['cols_per_block']} terms, not {B.COLS_PER_BLOCK}")
        model = self._instance(self.cls(), meta)
        spark: SparkSession = self.sparkSession
        tfidf = TfidfModel(spark.read.parquet(f"{path}/vocabulary"), meta["n_docs"], model._options())
        basis = spark.read.schema(B.TALL).parquet(f"{path}/basis")
        model.lsa = LsaModel(tfidf, basis, meta["k"], np.array(meta["singular_values"]))
        return model


class _Word2VecWriter(_Writer):
    def saveImpl(self, path: str) -> None:
        words = self.instance.words
        self._metadata(path, trained=words is not None)
        if words is not None:
            words.write().save(f"{path}/words")


class _Word2VecReader(_Reader):
    def load(self, path: str) -> Word2VecEmbedding:
        meta = self._metadata(path)
        return self._instance(self.cls(Word2VecModel.load(f"{path}/words") if meta["trained"] else None), meta)
