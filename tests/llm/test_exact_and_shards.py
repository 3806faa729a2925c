import collections
import hashlib
import zlib

import numpy as np

import pytest
from corpusrank.llm import op1_exact_dedup as o1
from corpusrank.llm import op2_sharding as o2
from llm_rows import ROWS


def _norm(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def test_exact_dedup_edges(edge):
    groups = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        groups[_norm(t)].append(i)
    want = collections.Counter()
    for i, t, *_ in ROWS:
        ids = [x for x in groups[_norm(t)] if x is not None]
        keep = max(ids) if ids else None
        want[(i, keep, len(groups[_norm(t)]), i == keep, hashlib.sha256(_norm(t).encode()).hexdigest())] += 1
    for fan_in, rounds in ((4, 3), (2, 1), (3, 0)):
        got = collections.Counter(tuple(r) for r in o1.exact_dedup(edge, fan_in=fan_in, rounds=rounds).collect())
        assert got == want


def test_exact_dedup_smallest_and_empty(edge, empty):
    got = {r["doc_id"]: r["keep_id"] for r in o1.exact_dedup(edge, keep="min").collect()}
    assert got[2] == 1 and got[5] == 4 and got[10] == 9
    assert o1.exact_dedup(empty).count() == 0


def test_only_ascii_letters_are_lowered(spark):
    df = spark.createDataFrame([(1, "É"), (2, "é"), (3, "K"), (4, "k"), (5, "K")], "doc_id long, text string")
    got = {r["doc_id"]: r["group_size"] for r in o1.exact_dedup(df).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2, 5: 1}


def test_shards(edge, empty):
    rows = o2.shard(edge, n_shards=3, n_slots=64).collect()
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    places = collections.defaultdict(list)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 3
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert o2.shard(empty).count() == 0


def test_shard_bytes_are_near_equal(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    load = [r["b"] for r in o2.shard(d).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()]
    assert len(load) == 24 and max(load) - min(load) < 0.02 * np.mean(load)


def test_map_versions_and_growth(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = f"file://{tmp_path}/map"
    o2.shard(d, n_shards=4, n_slots=256, map_path=path).count()
    v2, m2 = o2.load_map(spark, path)
    o2.shard(d, n_shards=4, n_slots=256, map_path=path).count()
    v3, m3 = o2.load_map(spark, path)
    assert (v2, v3) == (2, 3) and (m2 == m3).all()        # a balanced map needs no edit
    b = np.random.default_rng(1).integers(1, 100, 256).astype(float)
    m = o2.rebalance(o2.first_map(256, 4), b, 4)
    g = o2.grow(m, b, 4)
    moved = g != m
    assert (g[moved] == 4).all()
    load = np.bincount(g, weights=b, minlength=5)
    assert load.max() - load.min() < 0.1 * load.mean()


def test_a_map_of_another_shape_is_an_error(spark, edge, tmp_path):
    path = f"file://{tmp_path}/map"
    o2.shard(edge, n_shards=4, n_slots=64, map_path=path).count()
    for shards, slots in ((4, 128), (2, 64)):
        with pytest.raises(ValueError, match="64 slots"):
            o2.shard(edge, n_shards=shards, n_slots=slots, map_path=path)
    assert o2.shard(edge, n_shards=6, n_slots=64, map_path=path).count() == edge.count()
