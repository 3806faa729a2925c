import collections
import hashlib
import re

import pytest

from corpusrank.llm import op5_secrets as o5
from corpusrank.llm import op6_mixing as o6
from corpusrank.llm import op8_quality as o8
from llm_rows import ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PAT = {"assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
       "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+")}
LEAST = {"assign": 12, "access": 18, "hex": 16}


def brute_spans(t):
    out = []
    for i, (k, p) in enumerate(PAT.items()):
        for m in p.finditer(t or ""):
            if len(m.group(2 if k == "assign" else 0)) >= LEAST[k]:
                out.append((m.start(), i, m.end(), k))
    return sorted(out)


TRICKY = ["password=token: abcdefghijklmnop", "password=token=abcdefghijklmnop", "xAKIAAKIA" + "A" * 13, "AKIA" + "B" * 14,
          "é😀 secret : 'abcdefghijkl' tail 0123456789abcdef0 0123456789abcde", "API_KEY=\"Zm9vYmFyYmF6cXV4\" apikey:short",
          "token=" + "a" * 12 + "password=" + "b" * 11, "0123456789abcdef" * 3, "PassWD  :  abc.def-ghi_jkl",
          "token: aaaaaaaaaaaaaaaa token: bbbbbbbbbbbbbbbb", "", None, "nothing here"]


def test_secrets_match_brute_force(spark, edge):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(100, TRICKY[0]), (100, TRICKY[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["spans"], r["base_sha256"])
                              for r in o5.scan_secrets(df).collect())
    want = collections.Counter()
    for i, t in rows:
        s = brute_spans(t)
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
        n = collections.Counter(k for *_, k in s)
        want[(i, n["assign"], n["access"], n["hex"], text, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert got == want
    assert o5.scan_secrets(edge).count() == len(ROWS) and o5.scan_secrets(edge.limit(0)).count() == 0


def test_secrets_on_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    got = o5.scan_secrets(d).collect()
    assert len(got) == len(text) and sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in got) > 0
    for r in got:
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute_spans(text[r["doc_id"]]))


def test_ledger_scans_only_unseen_pairs(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    a = spark.createDataFrame([(1, TRICKY[1]), (2, TRICKY[1]), (3, "clean")], "doc_id long, text string")
    o5.scan_secrets(a, path).count()
    n1 = spark.read.parquet(path).count()
    b = a.unionByName(spark.createDataFrame([(4, TRICKY[3]), (5, "clean")], "doc_id long, text string"))
    assert o5.update_ledger(b, o5.read_ledger(spark, path)).select("blob").distinct().count() == 1
    got = {r["doc_id"]: r["spans"] for r in o5.scan_secrets(b, path).collect()}
    assert got[1] == got[2] != "" and got[4] != "" and got[5] == got[3] == ""
    assert spark.read.parquet(path).count() == n1 + 3
    newer = tuple(o5.Rule(r.name, 2 if r.name == "hex" else 1, r.pattern, r.group, r.min_chars) for r in o5.RULES)
    todo = o5.update_ledger(b, o5.read_ledger(spark, path), newer)
    assert {r["rule"] for r in todo.select("rule").distinct().collect()} == {"hex"}


def test_water_fill():
    assert o6.water_fill([100, 100, 100], [1, 1, 2], 3) == [75, 75, 150]
    t = o6.water_fill([10, 1000, 1000], [5, 2, 1], 3)
    assert t[0] == 30 and sum(t) == pytest.approx(2010) and t[1] / t[2] == pytest.approx(2)
    assert o6.water_fill([], [], 3) == [] and o6.water_fill([0, 10], [5, 2], 3) == [0, 10]


def test_mixing_edges(edge, empty):
    rows = o6.mix(edge).collect()
    assert collections.Counter((r["doc_id"], r["size"]) for r in rows) == collections.Counter(
        (i, len(WORD.findall(t or ""))) for i, t, *_ in ROWS)
    assert [tuple(r) for r in sorted(rows, key=str)] == [tuple(r) for r in sorted(o6.mix(edge.repartition(7)).collect(), key=str)]
    by = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    for part in by.values():
        assert sum(r["size"] for r in part) == part[0]["source_size"]
        assert sum(r["taken"] for r in part) == int(part[0]["target"] + 0.5)
    assert o6.mix(empty).count() == 0


def test_repeated_documents_follow_the_mixture(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = o6.mix(d)
    out = o6.repeated(d, mixed)
    assert out.columns == d.columns
    size = {r["doc_id"]: r["size"] for r in mixed.collect()}
    target = {r["source"]: (r["target"], r["source_size"]) for r in mixed.collect()}
    got = collections.Counter()
    for r in out.select("doc_id", "source").collect():
        got[r["source"]] += size[r["doc_id"]]
    biggest = max(size.values())
    assert all(abs(got[s] - t) <= biggest for s, (t, _) in target.items())


def brute_quality(t):
    t = t or ""
    w = WORD.findall(t)
    where = collections.defaultdict(list)
    for i in range(len(w) - 2):
        where[tuple(w[i:i + 3])].append(i)
    cover = {p for at in where.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), failed


def test_quality_base_counts(spark, edge, empty):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = collections.Counter((r["doc_id"], *[r[c] for c in names]) for r in o8.quality(edge).collect())
    assert got == collections.Counter((i, *brute_quality(t)) for i, t, *_ in ROWS)
    assert o8.quality(empty).count() == 0
    reps = ["a b c a b c a b c", "a a a a a", "x a b c y a b c z", "a b c d a b c d"]
    df = spark.createDataFrame(list(enumerate(reps)), "doc_id long, text string").selectExpr("*", "'s' AS source")
    assert {r["doc_id"]: r["n_repeat_words"] for r in o8.quality(df).collect()} == {i: brute_quality(t)[4] for i, t in enumerate(reps)}


def test_repeated_windows_of_long_texts(spark, monkeypatch):
    """Both ways of sorting windows, on either side of the border."""
    texts = [" ".join(f"w{k % n}" for k in range(3 * n // 2)) for n in (5, 50, 400)] + [" ".join(f"v{k}" for k in range(700))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' AS source")
    want = {i: brute_quality(t)[4] for i, t in enumerate(texts)}
    for border in (1 << 16, 100, 3):
        monkeypatch.setattr(o8, "PACKED", border)
        assert {r["doc_id"]: r["n_repeat_words"] for r in o8.quality(df).collect()} == want


def test_a_growing_host_keeps_its_boilerplate(spark):
    """A line of 150 documents stays boilerplate when its host grows tenfold."""
    menu = " ".join(f"menu{k}" for k in range(60))
    body = lambda i: " ".join(f"w{i}q{k}" for k in range(60))
    rows = [(i, f"{menu}\nonly {i}", "s") for i in range(150)]
    for others in (300, 3000):
        df = spark.createDataFrame(rows + [(1000 + i, body(i), "s") for i in range(others)], "doc_id long, text string, source string")
        kept = {r["doc_id"]: r["kept"] for r in o8.quality(df).collect()}
        assert not any(kept[i] for i in range(150)) and all(kept[1000 + i] for i in range(others))


def test_boilerplate_lines_reject_depleted_documents(spark):
    body = lambda i: " ".join(f"w{i}q{k}" for k in range(60))
    menu = " ".join(f"menu{k}" for k in range(60))
    rows = [(i, f"{menu}\n{body(i)}", "s") for i in range(30)]           # half of it is shared
    rows += [(100 + i, f"{menu}\nonly {i}", "s") for i in range(3)]      # nothing else
    rows += [(200 + i, f"copy\n{body(999)}", "s") for i in range(40)]    # one text, forty copies
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in o8.quality(df).collect()}
    assert all(kept[i] for i in range(30)) and not any(kept[100 + i] for i in range(3))
    assert all(kept[200 + i] for i in range(40))
