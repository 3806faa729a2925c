import collections
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusrank.llm import op3_token_counts as o3
from corpusrank.llm import op4_toxicity as o4
from corpusrank.llm import op9_packing as o9
from corpusrank.llm.tokens import default_path, encode
from llm_rows import ROWS


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, t):
    return tokenizer.encode(t or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizer_file(spark, tokenizer):
    texts = [t for _, t, *_ in ROWS] + ["a" * 5000, "  lead", "trail \n\n ", "x<|endoftext|>y", "　wide", "a\x00b", "12345678 9", "I'll we've"]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for t in texts:
        assert encode(t, default_path()).tolist() == ids_of(tokenizer, t)


def test_token_histogram(edge, empty, tokenizer):
    n = np.array([len(ids_of(tokenizer, t)) for _, t, *_ in ROWS])
    rows = o3.histogram(edge, block=16).collect()
    assert {r["length"]: r["n_docs"] for r in rows} == dict(collections.Counter(n.tolist()))
    for r in rows:
        x = r["length"]
        assert (r["docs_at_least"], r["tokens_at_least"], r["docs_at_most"]) == ((n >= x).sum(), n[n >= x].sum(), (n <= x).sum())
        assert r["truncated_tokens"] == np.minimum(n, x).sum() and r["total_tokens"] == n.sum() and r["total_docs"] == len(n)
    hist = o3.histogram(edge)
    limits = [0, 1, 20, 21, 4096, 10**7]
    got = {r["limit"]: (r["docs_over"], r["truncated_tokens"]) for r in o3.under_limits(hist, limits).collect()}
    assert got == {x: ((n > x).sum(), np.minimum(n, x).sum()) for x in limits}
    q = {r["share"]: r["length"] for r in o3.quantiles(hist, [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    assert q == {s: min(x for x in n if (n <= x).sum() >= s * len(n)) for s in q}
    assert o3.histogram(empty).count() == 0


def check_pieces(pieces, docs, tokenizer, window=1024):
    """Exact round trip: every id of every row lies in exactly one piece."""
    want = collections.Counter()
    for i, t in docs:
        want[(i, tuple(ids_of(tokenizer, t) + [0]))] += 1
    sequences, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"]].append(p)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= window
    expected = collections.Counter()
    for (i, ids), n in want.items():
        for p in by_doc[i]:
            piece = np.array(ids[p["start"]: p["start"] + p["length"]], dtype="<u4")
            if p["doc_tokens"] == len(ids) and zlib.crc32(piece.tobytes()) == p["ids_crc32"]:
                expected[(i, len(ids))] += p["length"]
    for (i, ids), n in want.items():
        assert expected[(i, len(ids))] == n * len(ids)
    assert sum(p["length"] for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    return len(sequences) * window - sum(p["length"] for p in pieces)


def test_packing_round_trip_on_edges(edge, empty, tokenizer):
    pieces = o9.pack(edge).collect()
    assert check_pieces(pieces, [(r[0], r[1]) for r in ROWS], tokenizer) < 1024
    assert o9.pack(empty).count() == 0


def test_packing_round_trip_on_documents(spark, tokenizer):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in d.collect()]
    pieces = o9.pack(d).collect()
    assert check_pieces(pieces, docs, tokenizer) < 1024
    assert sorted(map(str, pieces)) == sorted(map(str, o9.pack(d.repartition(5)).collect()))
    tails = [p for p in pieces if p["length"] < 1024]
    cut = collections.Counter((p["doc_id"]) for p in tails)
    assert sum(n > 1 for n in cut.values()) < 0.1 * len(docs)       # most tails are packed whole


def test_plan_fills_windows_exactly():
    rng = np.random.default_rng(2)
    hist = np.bincount(rng.integers(1, 64, 5000), minlength=64)
    plan = o9.make_plan(hist, 64)
    fills = collections.defaultdict(list)
    for n in range(1, 64):
        for rank in range(hist[n]):
            fills[plan.place(n, rank)[0]].append((plan.place(n, rank)[1], n))
    assert plan.covered.sum() > 0.95 * hist.sum()
    for s in range(plan.n_fill):
        assert sum(n for _, n in fills[s]) == 64 and sorted(fills[s])[0][0] == 0
    x = o9.repeat_counts(np.array([[40, 24, 0], [32, 32, 0]]), np.bincount([40] * 10 + [24] * 10 + [32] * 20, minlength=64))
    assert np.allclose(x, [10, 10], atol=0.1)


def toxic_set(n, seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "ko", "li", "mu") for b in ("ra", "te", "si") for c in ("n", "l", "x", "da")]
    rows = []
    for i in range(n):
        w = list(rng.choice(vocabulary, rng.integers(5, 120)))
        toxic = i % 4 == 0
        if toxic:
            w[rng.integers(len(w))] = "zloth" + rng.choice(["er", "ing", "ed", "y", "s"])
        rows.append((i, " ".join(w), "en" if i % 3 else "de", "s", int(toxic)))
    return rows


def test_toxicity_held_out_accuracy(spark):
    rows = toxic_set(1600)
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, toxic int")
    model = o4.fit(docs, labels)
    got = {r["doc_id"]: r for r in o4.score(docs, model).collect()}
    truth = {r[0]: r[4] for r in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in set(held)) for i in truth)
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.95
    assert all(got[i]["predicted"] == int(got[i]["score"] >= 0.7) and 0 <= got[i]["score"] <= 1 for i in truth)
    kept = {r["doc_id"] for r in o4.reject(docs, model).collect()}
    assert kept == {i for i in truth if not got[i]["rejected"]}
    again = o4.fit(docs, labels)
    assert (again.scale, again.shift, again.thresholds) == (model.scale, model.shift, model.thresholds)
    # the language, the source and the id are no inputs
    other = docs.selectExpr("doc_id + 100000 AS doc_id", "text", "'xx' AS lang", "'t' AS source")
    assert {r["doc_id"] - 100000: r["score"] for r in o4.score(other, model).collect()} == pytest.approx({i: got[i]["score"] for i in truth})


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1), (3, 0), (7, None), (None, 1), (8, 0), (8, 1), (8, 1), (9, 0), (5, 0)], "doc_id long, toxic int")
    model = o4.fit(edge, labels)
    rows = o4.score(edge, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert o4.reject(edge, model).columns == edge.columns
    none = o4.fit(edge, labels.limit(0))
    assert {r["score"] for r in o4.score(edge, none).collect()} == {0.5}
    assert o4.score(empty, model).count() == 0 and o4.fit(empty, labels).network is None


def test_gradients_match_differences():
    s = o4.Settings(buckets=64, dim=3, filters=2)
    net = o4.Network(s)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    net.p["b"] += rng.normal(0, 0.1, len(net.p["b"]))       # away from the bend of max(0, x) for the empty text
    feats = np.concatenate([np.zeros((1, o4.FEATURES), dtype=int), rng.integers(1, 64, (20, o4.FEATURES))])
    words, starts = o4.joined([rng.integers(1, 21, 6), rng.integers(1, 21, 1), np.empty(0, dtype=int)], 3)
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.logits(net.responses(feats), words, starts)
        return np.mean(np.log1p(np.exp(-(2 * y - 1) * z)))

    g = net.gradients(feats, words, starts, y)
    for k in net.p:
        flat, gf = net.p[k].reshape(-1), g[k].reshape(-1)
        for i in rng.choice(len(flat), min(12, len(flat)), replace=False):
            if k == "E" and i < s.dim:
                continue
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert gf[i] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_a_score_does_not_depend_on_its_neighbours():
    net = o4.Network(o4.Settings(buckets=512))
    texts = ["alpha beta gamma", None, "", "delta", "one two three four five six"]
    model = o4.Model(net, 1.0, 0.0, {}, 0.7)
    together = o4.Scorer(model).scores(texts)
    assert together == pytest.approx([o4.Scorer(model).scores([t])[0] for t in texts])
    assert o4.Scorer(model).scores(texts[::-1])[::-1] == pytest.approx(together)


def test_sample_is_bounded(spark):
    rows = toxic_set(400)
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, toxic int")
    sample = o4.training_sample(docs, labels, o4.Settings(max_per_class=20), "doc_id", "toxic")
    assert isinstance(sample, pd.DataFrame) and collections.Counter(sample["y"]) == {0: 20, 1: 20}
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in docs.join(spark.createDataFrame(sample[["text"]]), "text").toPandas()["doc_id"])
