import collections
import random

from pyspark.sql import functions as F

from corpusrank.llm import op7_minhash as o7
from corpusrank.llm import op10_line_dedup as o10
from corpusrank.llm import sql
from corpusrank.llm.graph import components
from corpusrank.plans.check import compare
from llm_rows import LONG, PROSE, ROWS


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def groups(ids, links):
    parent = {i: i for i in ids}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {i: find(parent, i) for i in ids}


def shingles(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).encode().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute_near(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1:] if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return groups(ids, links), {i: len(s) for i, s in sets.items()}


def variants(n, seed, words=80, edits=6):
    rng = random.Random(seed)
    base = [f"t{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1300)] + [(1299, 2000), (3, 3), (2000, 5000)]
    links += [(rng.randrange(6000, 6200), rng.randrange(6000, 6200)) for _ in range(120)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {x for ab in links if ab[0] != ab[1] for x in ab}
    assert got == groups(ids, [ab for ab in links if ab[0] != ab[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup_edges(edge, empty):
    want, n = brute_near([(i, t) for i, t, *_ in ROWS])
    rows = o7.near_dedup(edge).collect()
    assert len(rows) == len(ROWS) and o7.near_dedup(empty).count() == 0
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], n[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_near_dedup_matches_brute_force_on_variants(spark):
    texts = [t for k in range(6) for t in variants(25, k)] + variants(60, 99, words=60, edits=10) + [f"only {i} of its kind here" for i in range(40)]
    rng = random.Random(1)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want, _ = brute_near(rows)
    got = {r["doc_id"]: r["component_id"] for r in o7.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] != want[i] for i in want) <= 2      # a pair at the threshold shares a table with 0.997


def test_near_dedup_matches_sql(spark):
    res = compare(spark, "/root/testdata/sf0.001", ["op7"], verbose=False, oracles={"op7": sql.NEAR_DEDUP},
                  queries={"op7": lambda s, d: o7.near_dedup(s.read.parquet(f"{d}/documents.parquet"))})
    assert res["op7"] == "OK"


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(rows, similarity=0.75):
    """removed lines per id by edit similarity alone."""
    first, occ = {}, []
    for i, norm in rows:
        for no, x in enumerate(norm):
            occ.append((i, no, x))
            first[x] = min(first.get(x, (i, no)), (i, no))
    keys = sorted(first)
    links = []
    for p, a in enumerate(keys):
        for b in keys[p + 1:]:
            most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
            if abs(len(a) - len(b)) <= most and edit(a, b) <= most:
                links.append((a, b))
    group = groups(keys, links)
    keep = {}
    for x in keys:
        keep[group[x]] = min(keep.get(group[x], first[x]), first[x])
    gone = collections.defaultdict(list)
    for i, no, x in sorted(set(occ)):
        if (i, no) != keep[group[x]]:
            gone[i].append(no)
    return gone, len(links)


def line_rows(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(600)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 30))) for _ in range(30)]
    docs = []
    for i in range(60):
        ls = []
        for _ in range(rng.randrange(1, 6)):
            x = rng.choice(base)
            if rng.random() < 0.5:
                w = x.split()
                k = rng.randrange(len(w))
                w.insert(k, w[k] if rng.random() < 0.7 else rng.choice(vocabulary))
                x = " ".join(w)
            ls.append(x.upper() + "!" if rng.random() < 0.2 else x)
        docs.append((i, "\n".join(ls)))
    return docs


def test_line_dedup_matches_brute_force(spark):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    full = o10.lines(df, "doc_id", "text").withColumn("norm", o10.normalise(F.col("line")))
    norm = collections.defaultdict(dict)
    for r in full.collect():
        norm[r["id"]][r["no"]] = r["norm"]
    want, n_links = brute_lines([(i, [norm[i][k] for k in sorted(norm[i])]) for i, _ in rows])
    assert n_links > 5
    got = {r["doc_id"]: r["removed"] for r in o10.per_document(df).collect()}
    want, got = ({(i, no) for i, ls in x.items() for no in ls} for x in (want, got))
    assert got <= want and len(got) >= 0.97 * len(want)


def test_simhash_is_the_majority_of_distinct_word_hashes(spark):
    texts = ["one two three", "aa bb aa cc aa", " ".join(f"v{i % 8700}" for i in range(9000)), "x y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string")
    got = {r["k"]: r["simhash"] for r in o10.with_simhash(df, ["k"], "t").collect()}
    hashes = {r["w"]: r["h"] for r in df.select(F.explode(F.split("t", " ")).alias("w")).distinct().withColumn("h", F.xxhash64("w")).collect()}
    for i, t in enumerate(texts):
        hs = [hashes[w] for w in set(t.split(" "))]
        bits = sum(1 << k for k in range(64) if 2 * sum((h >> k) & 1 for h in hs) > len(hs))
        assert got[i] & (2**64 - 1) == bits


def test_blocks_are_pigeonholes(spark):
    """Up to three replaced words leave a class of a line alone; equal classes mean equal keys."""
    rng = random.Random(9)
    rows = []
    for i in range(200):
        a = [f"word{rng.randrange(10**6)}" for _ in range(rng.choice([48, 80, 700, 3000]))]
        b = list(a)
        for k in rng.sample(range(len(a)), 3):
            b[k] = f"word{rng.randrange(10**6)}"
        rng.shuffle(b)
        rows.append((i, " ".join(a), " ".join(b)))
    df = spark.createDataFrame([(2 * i + k, t) for i, *two in rows for k, t in enumerate(two)], "line_hash long, norm string")
    keys = {}
    for r in o10.block_keys(df.union(df)).collect():
        assert r.key not in keys.setdefault(r.id, set())
        keys[r.id].add(r.key)
    assert all(keys[2 * i] & keys[2 * i + 1] and len(keys[2 * i]) <= o10.CLASSES for i, *_ in rows)
    plan = o10.block_keys(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(line_hash") == 1 and plan.count("Exchange") == plan.count("Exchange hashpartitioning(line_hash")


def test_line_dedup_edges(edge, empty):
    out = o10.per_document(edge).collect()
    rows = {r["doc_id"]: r for r in out}
    assert len(out) == len(ROWS)
    assert rows[1]["removed"] == [] and rows[2]["removed"] == [0] and rows[11]["removed"] == [0, 2]
    assert rows[4]["n_lines"] == rows[5]["n_lines"] == 1 and rows[9]["removed"] == [] and rows[10]["removed"] == [0]
    out = o10.apply(edge)
    assert out.columns == edge.columns
    left = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert left[(11, "second line of this text here")] == 1 and left[(1, PROSE)] == 1 and (2, PROSE.upper()) not in left
    assert left[(None, None)] == 1 and left[(None, "a row without an id")] == 1 and left[(5, "")] == 1 and left[(7, LONG)] == 1
    assert o10.apply(empty).count() == 0
