import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_rows import CLASH, ROWS  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(f"clash-{c}").alias(c) for c in CLASH]).cache()


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="package", autouse=True)
def few_partitions(spark):
    """The tables here are tiny and the operators run many small jobs."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
