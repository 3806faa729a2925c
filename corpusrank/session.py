"""Session helpers: a test/bench session and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "corpusrank") -> SparkSession:
    """Local session for tests and the bench.  On a cluster, build your own."""
    master = master or os.environ.get("CORPUSRANK_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CORPUSRANK_DRIVER_MEM", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.master.startswith("local[") and not checkpoint_dir(spark):
        # one process, one disk: a scratch folder is shared by construction
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusrank-ckpt-", dir="/tmp"))
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    sc = spark.sparkContext
    return sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Whoever builds the session sets it to a folder that the driver and all
    executors share.  Unset, a local session gets a scratch folder of its own;
    on a cluster that would be another disk on every node, so it is an error."""
    sc = spark.sparkContext
    d = checkpoint_dir(spark)
    if not d:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="corpusrank-ckpt-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (survives lost
    executors, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark, name: str) -> str:
    """A new folder below the shared checkpoint folder; the JVM that made it
    removes it when it ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


# Parquet looks at the size of pages and row groups from the 100th row on at first, which
# rows of megabytes may not wait for; a row group is what a reader holds at once.
WIDE = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CLEANING = {"n": 0, "before": "false"}
_CLEANING_LOCK = threading.Lock()
_TABLES: ContextVar[list[str] | None] = ContextVar("session_tables", default=None)


@contextmanager
def cleaned(spark):
    """Inside, a query's shuffles go when it ends.  Several threads may be inside at once."""
    with _CLEANING_LOCK:
        if not _CLEANING["n"]:
            _CLEANING["before"] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _CLEANING["n"] += 1
    try:
        yield
    finally:
        with _CLEANING_LOCK:
            _CLEANING["n"] -= 1
            if not _CLEANING["n"]:
                spark.conf.set(CLEANUP, _CLEANING["before"])


def saved(df, name: str = "saved", codec: str = "snappy", wide: bool = False):
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    again: cuts the lineage like a checkpoint, and later reads are pruned to the
    columns and rows they need.  The shuffles of a written table are not needed
    again and go with the write.  ``wide``: rows may have megabytes."""
    path = scratch_path(df.sparkSession, name)
    if (tables := _TABLES.get()) is not None:
        tables.append(path)
    with cleaned(df.sparkSession):
        df.write.options(compression=codec, **(WIDE if wide else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def alone(make, name: str = "saved", codec: str = "snappy", wide: bool = False):
    """``saved(make())``; the tables that ``make`` wrote are removed once this one stands."""
    inner: list[str] = []
    before = _TABLES.set(inner)
    try:
        df = make()
    finally:
        _TABLES.reset(before)
    out = saved(df, name, codec, wide)
    for path in inner:
        jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)
    return out


def spread(df):
    """Give CPU-heavy per-row work (regex analysis) at least one task per core.

    A scan of many files is left alone; a few small files are redistributed
    round-robin.  Only file names are looked at: nothing is executed."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if len(df.inputFiles()) < want else df


TASK_TEXT_BYTES = 64 << 20     # of text that a task analyses


def spread_text(df, text: str = "text"):
    """``spread``, with a task for at most some ``TASK_TEXT_BYTES`` of text as
    well, so that what a task groups by term stays in its memory."""
    from pyspark.sql import functions as F
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    want = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_TEXT_BYTES))
    return df.repartition(want) if len(df.inputFiles()) < want else df
