"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrank.llm.common import compacted


SMALL = 500_000


def _stars(pairs: DataFrame, n: int) -> DataFrame:
    """Every pair with the smallest of its first node and that node's neighbours.
    Up to ``SMALL`` links the minima are broadcast; beyond that they are a
    written table, so both sides of the join are plain shuffles and a node with
    very many neighbours is split."""
    low = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return pairs.join(F.broadcast(low) if n <= SMALL else compacted(low, "stars"), "a")


def roots(parents: DataFrame) -> DataFrame:
    """``(id, component)`` of ``parents(id, parent)``, one smaller parent an id:
    every id jumps to its parent's parent until nothing changes."""
    p = parents
    while True:
        up = p.select(F.col("id").alias("parent"), F.col("parent").alias("next"))
        new = compacted(p.join(up, "parent", "left").select("id", F.coalesce("next", "parent").alias("parent"),
                                                        F.col("next").isNotNull().alias("moved")), "parents")
        p = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    members = p.select("id", F.col("parent").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("id"), "component").distinct())


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``links(a, b)``; the component is its
    smallest id.

    Alternates two local steps until the table of (node, parent) rows stops
    changing: every node hangs its larger neighbours on the smallest one, then
    its smaller ones.  Each step is an aggregation with map-side combine and a
    sort-merge join whose hot nodes Spark splits; the number of rounds grows
    with the logarithm of the longest chain."""
    up = compacted(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before, n = None, up.count()
    while n:
        both = up.unionByName(up.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _stars(both, n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        s = _stars(large, n)
        small = (s.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(s.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        up = compacted(small, "links")
        state = up.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if state == before:
            break
        before, n = state, state[0]
    members = up.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("id"), "component").distinct())
