"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A row's virtual slot is a hash of its id, for ever.  Bytes are summed per slot,
and only the map says which shard holds a slot.  Map version 1 deals slots
round; ``rebalance`` makes the next version by moving single slots from the
heaviest to the lightest shard (the slot nearest to half the difference) until
no move helps.  The map has ``n_slots`` rows by construction, the one thing
that reaches the driver, however large the table is.

A row's place in its shard comes from the slot's place in the shard plus its
rank in the slot, so no task sees a whole shard.

Size: UTF-8 bytes of the text (null: none) plus 8.  Null ids share one slot;
repeated rows get places of their own; an empty table gives no rows and extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusrank.llm.common import saved, text_or_empty


def first_map(n_slots: int, n_shards: int) -> np.ndarray:
    return np.arange(n_slots) % n_shards


def rebalance(slot_map: np.ndarray, slot_bytes: np.ndarray, n_shards: int) -> np.ndarray:
    """The next version of the map: slots move one at a time, heaviest shard to
    lightest, while a move narrows the difference."""
    new, load = slot_map.copy(), np.bincount(slot_map, weights=slot_bytes, minlength=n_shards)
    while True:
        low, moved = int(load.argmin()), False
        for high in np.argsort(-load, kind="stable"):
            gap = load[high] - load[low]
            here = np.flatnonzero((new == high) & (slot_bytes > 0) & (slot_bytes < gap))
            if len(here):
                s = here[np.abs(slot_bytes[here] - gap / 2).argmin()]
                new[s], moved = low, True
                load[high] -= slot_bytes[s]
                load[low] += slot_bytes[s]
                break
        if not moved:
            return new


def grow(slot_map: np.ndarray, slot_bytes: np.ndarray, n_shards: int) -> np.ndarray:
    """The map for one more shard: slots move only into the new one."""
    new, load = slot_map.copy(), np.bincount(slot_map, weights=slot_bytes, minlength=n_shards + 1)
    goal = slot_bytes.sum() / (n_shards + 1)
    while True:
        high = int(load[:n_shards].argmax())
        here = np.flatnonzero((new == high) & (slot_bytes > 0) & (slot_bytes <= goal - load[n_shards]))
        if not len(here):
            return new
        s = here[np.abs(slot_bytes[here] - (load[high] - goal)).argmin()]
        new[s] = n_shards
        load[high] -= slot_bytes[s]
        load[n_shards] += slot_bytes[s]


def save_map(spark: SparkSession, slot_map: np.ndarray, path: str, version: int) -> None:
    """Append one version of the map to the table at ``path``."""
    rows = [(version, i, int(s)) for i, s in enumerate(slot_map)]
    spark.createDataFrame(rows, "version int, virtual_slot int, shard int").coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, np.ndarray]:
    """A version (the newest by default) of the map at ``path``."""
    t = spark.read.parquet(path)
    if version is None:
        version = t.agg(F.max("version")).first()[0]
    rows = t.where(F.col("version") == version).orderBy("virtual_slot").collect()
    return version, np.array([r["shard"] for r in rows])


def slotted(docs: DataFrame, id_col: str, text_col: str, n_slots: int) -> DataFrame:
    t = text_or_empty(text_col)
    return saved(docs.select(F.col(id_col), (F.octet_length(t) + 8).cast("long").alias("size"),
                             F.crc32(t.cast("binary")).cast("long").alias("text_crc32"),
                             F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_slots)).cast("int").alias("virtual_slot")),
                 "slotted")


def shard(docs: DataFrame, n_shards: int = 24, n_slots: int = 4096, id_col: str = "doc_id",
          text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot,
    map_version)``.  With ``map_path`` the newest stored map is the one edited
    and the edit is stored as its next version; a map of another number of slots, or
    of more shards than asked for, is an error."""
    spark = docs.sparkSession
    rows = slotted(docs, id_col, text_col, n_slots)
    per_slot = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    slot_bytes, slot_rows = np.zeros(n_slots), np.zeros(n_slots, dtype=np.int64)
    for r in per_slot:
        slot_bytes[r["virtual_slot"]], slot_rows[r["virtual_slot"]] = r["bytes"], r["n"]
    jpath = spark._jvm.org.apache.hadoop.fs.Path(map_path) if map_path else None
    if jpath and jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        version, slot_map = load_map(spark, map_path)
        if len(slot_map) != n_slots or max(slot_map) >= n_shards:
            raise ValueError(f"the map in {map_path} has {len(slot_map)} slots and {max(slot_map) + 1} shards, not {n_slots} and at most {n_shards}")
    else:
        version, slot_map = 1, first_map(n_slots, n_shards)
        if map_path:
            save_map(spark, slot_map, map_path, version)
    slot_map = rebalance(slot_map, slot_bytes, n_shards)
    version += 1
    if map_path:
        save_map(spark, slot_map, map_path, version)
    start, at = np.zeros(n_slots, dtype=np.int64), np.zeros(n_shards, dtype=np.int64)
    for s in range(n_slots):
        start[s] = at[slot_map[s]]
        at[slot_map[s]] += slot_rows[s]
    placed = spark.createDataFrame([(s, int(slot_map[s]), int(start[s])) for s in range(n_slots)],
                                   "virtual_slot int, shard int, slot_start long")
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(id_col, "text_crc32", "size"))
    return (rows.withColumn("rank", rank).join(F.broadcast(placed), "virtual_slot")   # n_slots rows
            .select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("slot_start") + F.col("rank") - 1).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
                    F.lit(version).alias("map_version")))
