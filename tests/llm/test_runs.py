"""Operator 13 against brute force over all periods."""

import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusrank.llm import op13_runs as M

SF = "/root/testdata/sf0.001"


def brute_runs(w, min_length):
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            run = w[s: i + p]
            if len(run) >= max(min_length, 2 * p) and not any(run[q:] == run[:-q] for q in range(1, p)):
                out.append((s, len(run), p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_lyndon(x):
    def is_lyndon(s):
        return all(s < s[k:] for k in range(1, len(s)))
    return [max(j - i for j in range(i + 1, len(x) + 1) if is_lyndon(x[i:j])) for i in range(len(x))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=22))
def test_lyndon_array(x):
    assert M.lyndon_array(x + [0]) == brute_lyndon(x) + [0]


def test_runs_of_many_texts():
    rng = random.Random(3)
    for _ in range(60):
        texts = []
        for _ in range(6):
            w = [b"w%d" % rng.randint(1, rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 60))]
            texts.append(w[: rng.randint(1, 9)] * rng.randint(2, 9) + w if rng.random() < 0.4 else w)
        for least in (1, 2, 5, 12):
            got = M.runs_of_texts(texts, least)
            assert [[tuple(r) for r in g.tolist()] for g in got] == [brute_runs(w, least) for w in texts]


def test_long_repetitions():
    texts = [[b"a"] * 50_000, [b"a", b"b"] * 20_000 + [b"%d" % i for i in range(100)] * 50]
    one, two = (g.tolist() for g in M.runs_of_texts(texts))
    assert one == [[0, 50_000, 1]] and two == [[0, 40_000, 2], [40_000, 5000, 100]]


def planted(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is None:
        return w
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = planted(doc_id, text)
    runs = brute_runs(w, 12)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def query(df, **options):
    return M.digests(M.find_runs(M.with_planted_runs(df), **options))


def test_query(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000")
    rows = df.select("doc_id", "text").collect()
    assert sorted(map(tuple, query(df, chunk=500).collect())) == sorted(expected(r.doc_id, r.text) for r in rows)


def test_edges(edge, empty):
    short = edge.where("text IS NULL OR length(text) < 10000")
    want = [expected(r.doc_id, r.text) for r in short.select("doc_id", "text").collect()]
    assert sorted(map(repr, map(tuple, query(short).collect()))) == sorted(map(repr, want))
    assert query(edge).count() == edge.count()
    assert query(empty).collect() == []
