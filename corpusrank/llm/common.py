"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrank.session import CLEANUP, WIDE, cleaned, ensure_checkpoint_dir  # noqa: F401

# The words of a text, and the A-Z lower-casing pair.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays.  Texts of one byte a
    character take the faster lower()."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; the JVM that made it
    removes it when it ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


SMALL_BYTES = 1 << 20


def saved(df: DataFrame, name: str = "saved", codec: str = "snappy", wide: bool = False) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    again: cuts the lineage, survives lost executors, and later reads are
    column-pruned.  ``wide``: rows may have megabytes."""
    return _written(df, name, codec, WIDE if wide else {})[0]


def compacted(df: DataFrame, name: str = "saved") -> DataFrame:
    """``saved``, but a table of at most ``SMALL_BYTES`` is read as one partition:
    joins and sums of tables that small need no exchange."""
    out, path = _written(df, name)
    jvm = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    size = jvm.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(jvm).getLength()
    return out.coalesce(1) if size <= SMALL_BYTES else out


_TABLES: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def alone(make: Callable[[], DataFrame], name: str = "saved") -> DataFrame:
    """``compacted(make())``; the scratch tables that ``make`` wrote are removed
    once this one stands."""
    inner: list[str] = []
    before = _TABLES.set(inner)
    try:
        df = make()
    finally:
        _TABLES.reset(before)
    out = compacted(df, name)
    for path in inner:
        jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)
    return out


def _written(df: DataFrame, name: str, codec: str = "snappy", options: dict = {}) -> tuple[DataFrame, str]:
    """The shuffles of a written table are not needed again and go with the write."""
    path = scratch_path(df.sparkSession, name)
    if (tables := _TABLES.get()) is not None:
        tables.append(path)
    with cleaned(df.sparkSession):
        df.write.options(compression=codec, **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def sized(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """``df``, counted, as the small side of a join: broadcast up to
    ``max_rows`` narrow rows, otherwise left to a sort-merge join."""
    return F.broadcast(df) if df.count() <= max_rows else df
