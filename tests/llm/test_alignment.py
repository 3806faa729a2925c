"""Operator 11 against a token-by-token walk over the whole texts."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from corpusrank.llm import op11_alignment as M

SF = "/root/testdata/sf0.001"
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
TEXTS = [None, "", "a▁b x", " lead  two ", "\n\n", "x" * 900, "漢字 かな 😀 é", "<|endoftext|> <s> \x00 \r\n <unk>",
         "ab " * 400, "word　word wörd " * 90 + " end ", "'s 't it's  they'll"]


@pytest.fixture(scope="module")
def tok():
    return M.tokenizers(*M.default_paths())


def _pieces(tok):
    a = {i: t for t, i in tok.a._mergeable_ranks.items()}
    b = {}
    for i in range(tok.n_b):
        p = tok.b.id_to_piece(i)
        b[i] = bytes([int(p[3:5], 16)]) if tok.b.is_byte(i) else p.replace("▁", " ").encode()
    return a, b


def walk(rows, tok):
    pa, pb = _pieces(tok)
    found, count, top = {}, Counter(), Counter()
    for key, text in rows:
        a = tok.a.encode_ordinary(" " + text) if text else []
        b = tok.b.encode(text) if text else []
        want = (" " + text).encode() if text else b""
        if b"".join(pa[i] for i in a) != want or b"".join(pb[i] for i in b) != want:
            a, b = [], []
        groups, ga, gb, at_a, at_b = [], [], [], 0, 0
        a, b = list(a), list(b)
        while a or b or ga or gb:
            if ga and gb and at_a == at_b:
                groups.append((ga, gb))
                ga, gb = [], []
            elif (at_a <= at_b and a and not (ga and at_a == at_b)) or not b:
                ga.append(a.pop(0))
                at_a += len(pa[ga[-1]])
            else:
                gb.append(b.pop(0))
                at_b += len(pb[gb[-1]])
        found[key] = groups
        count.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = {}
    for key, groups in found.items():
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out[key] = (sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                    sum(count[x] == top[x[0]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(text.encode()).hexdigest() if text else "")
    return out


@pytest.mark.parametrize("size, block", [(M.RANGE, M.BLOCK), (400, 5000)])
def test_whole_texts(spark, tok, size, block):
    """With small ranges most texts are dealt out over tasks and joined again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + list(enumerate(TEXTS, 1000))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in M.per_document(df, size=size, block=block).collect()}
    assert got == walk(rows, tok)


def test_joining_is_associative(tok):
    """Fragments of arbitrary byte ranges, joined in any tree, are the whole."""
    text = "Unbelievably long wörds 漢字漢字 and  numbers 1234567890, don't they? " * 3
    a, a_end, b, b_end, _ = M.tokenise([text], tok)
    whole = M.join(M.start(), M.fragment(0, a, a_end, b, b_end, tok), tok)
    rng, open_only = np.random.default_rng(5), 0

    def spelled(f):
        return ";".join(c["groups"] for c in sorted(f["closed"], key=lambda c: c["at"]))
    for _ in range(30):
        places = np.sort(rng.choice(np.arange(1, a_end[-1]), size=rng.integers(1, 60), replace=False)).tolist()
        frags = []
        for no, (x, y) in enumerate(zip([0] + places, places + [a_end[-1]])):
            i, j = (np.searchsorted(a_end, v, side="right") for v in (x, y))
            k, m = (np.searchsorted(b_end, v, side="right") for v in (x, y))
            frags.append(M.fragment(no, a[i:j], a_end[i:j], b[k:m], b_end[k:m], tok))
        open_only += sum(f["first"] is None for f in frags)
        while len(frags) > 1:
            i = int(rng.integers(0, len(frags) - 1))
            frags[i: i + 2] = [M.join(frags[i], frags[i + 1], tok)]
        one = M.join(M.start(), frags[0], tok)
        assert not len(one["tail_a"]) and not len(one["tail_b"])
        assert (one["n_groups"], one["n_links"]) == (whole["n_groups"], whole["n_links"])
        assert spelled(one) == spelled(whole)
    assert open_only > 50


def test_large_groups_pair_distinct_ids(tok):
    a, b = np.arange(60) % 7, np.arange(60) % 5
    groups = M.Groups(a, b, np.array([60]), np.array([60]))
    _, pair, times = groups.pairs(np.array([0]), tok.n_b)
    want = Counter(int(x) * tok.n_b + int(y) for x in a for y in b)
    assert dict(zip(pair.tolist(), times.tolist())) == want


def test_edges(edge, empty, tok):
    rows = edge.select("doc_id", "text").collect()
    want = walk([(i, r.text) for i, r in enumerate(rows)], tok)
    want = sorted((str(rows[i].doc_id), *v) for i, v in want.items())
    got = M.per_document(edge, size=20_000).collect()
    assert sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in got) == want
    assert M.per_document(empty).collect() == []


def test_wide_rows_make_small_row_groups(spark):
    """Rows of a megabyte are not gathered by the hundred before Parquet looks at their size."""
    from glob import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F
    from corpusrank.llm.common import saved
    rows = spark.range(0, 48, 1, 1).select("id", F.transform(F.sequence(F.lit(1), F.lit(125_000)), lambda i: F.xxhash64(i, "id")).alias("x"))
    files = glob(f"{saved(rows, 'wide-test', wide=True).inputFiles()[0].removeprefix('file:')}")
    meta = pq.ParquetFile(files[0]).metadata
    assert meta.num_rows == 48 and max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) < 24 << 20


def test_answers_are_small_rows(spark):
    """A block's answers come in small rows, which may lie in several batches."""
    import pandas as pd
    from pyspark.sql import functions as F
    best = spark.range(4000).select(F.col("id").cast("int").alias("pair"), F.lit(2).cast("long").alias("docs"), F.lit(True).alias("best"))
    rows = M.answers(best.crossJoin(spark.createDataFrame([(1,), (2,)], "block long")).select("block", "pair"), best).collect()
    assert sorted({r.block for r in rows}) == [1, 2] and max(len(r.known) for r in rows) < 500
    assert sorted(x for r in rows if r.block == 1 for x in r.known) == list(range(4000))

    nobody = {c: None for c in ("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "pair", "times")}
    texts = {"texts": True, "known": None, "docs": None, "best": None, "id": [5, None], "n_a": [2, 0], "n_b": [2, 0], "n_groups": [1, 0], "n_links": [3, 0],
             "groups_sha256": ["x", ""], "n_pairs": [2, 0], "pair": np.array([9, 4]), "times": np.array([1, 2])}
    ask = lambda pair, docs, best: {"texts": False, "known": np.array([pair]), "docs": np.array([docs]), "best": np.array([best]), **nobody}
    rows = [ask(4, 7, True), ask(9, 3, False), texts, ask(4, 7, True), ask(9, 3, False), texts, {**texts, "n_pairs": [0, 0], "pair": [], "times": []}]
    for cuts in ([7], [1, 2, 4], [2, 1, 1, 1, 1, 1]):
        at = np.cumsum([0, *cuts])
        got = pd.concat(M._answers(pd.DataFrame(rows[a:z], columns=list(rows[0])) for a, z in zip(at, at[1:])))
        assert got["count_sum"].tolist() == [17, 0, 17, 0, 0, 0] and got["n_best"].tolist() == [2, 0, 2, 0, 0, 0]
