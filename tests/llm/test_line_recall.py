"""Op10 as registered, against brute-force edit similarity alone."""

import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from corpusrank.llm import op10_line_dedup as o10
from test_near_and_lines import edit, groups


def replaced(seed=5):
    """Lines and copies of them with up to an eighth of their words replaced."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(600)]
    out = []
    for _ in range(30):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(8, 30))]
        out.append(" ".join(w))
        for k in rng.sample(range(len(w)), rng.randrange(1, len(w) // 8 + 1)):
            w[k] = rng.choice(vocabulary)
        out.append(" ".join(w))
    return out


def test_replaced_words_are_found(spark):
    texts = list(dict.fromkeys(replaced()))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = list(range(len(texts)))          # the first line of each group, by edit similarity
    for i, a in enumerate(texts):
        for j in range(i):
            if abs(len(a) - len(texts[j])) <= 0.25 * max(len(a), len(texts[j])) and edit(a, texts[j]) <= 0.25 * max(len(a), len(texts[j])) + 1e-9:
                group = [group[j] if g == group[i] else g for g in group]
    want = {i for i, g in enumerate(group) if g != i}
    got = {r["doc_id"] for r in o10.per_document(df).collect() if r["removed"]}
    assert len(want) >= 25 and got <= want and len(got) >= 0.95 * len(want)


def test_recall_on_documents(spark):
    """Lines that brute-force edit similarity removes from the given texts."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500")
    rows = (o10.lines(df, "doc_id", "text").where(F.col("line").rlike(o10.WORD))
            .select("id", "no", o10.normalise(F.col("line")).alias("norm")).collect())
    first = {}
    for r in sorted(rows):
        first.setdefault(r.norm, (r.id, r.no))
    texts = [t for t in first if len(t.split(" ")) >= o10.MIN_WORDS or len(t) >= o10.MIN_CHARS]
    con = duckdb.connect()
    con.register("t", pd.DataFrame({"i": range(len(texts)), "x": texts}).assign(n=lambda d: d.x.str.len()))
    links = con.sql("""SELECT p.i, q.i FROM t p JOIN t q ON p.i < q.i AND abs(p.n - q.n) <= 0.25 * greatest(p.n, q.n) + 1e-9
                       WHERE levenshtein(p.x, q.x) <= 0.25 * greatest(p.n, q.n) + 1e-9""").fetchall()
    group = groups(range(len(texts)), links)
    keep = {}
    for i, t in enumerate(texts):
        keep[group[i]] = min(keep.get(group[i], first[t]), first[t])
    keeps = {t: keep[group[i]] for i, t in enumerate(texts)}
    want = {(r.id, r.no) for r in rows if (r.id, r.no) != keeps.get(r.norm, first[r.norm])}
    got = {(r.id, r.no) for r in o10.removed_lines(df).collect()}
    assert len(links) > 10 and got <= want and len(got) >= 0.97 * len(want)
    fuzzy = {r for r in want if r in {first[t] for t in texts}}
    assert len(got & fuzzy) >= 0.9 * len(fuzzy)


def test_punctuation_is_folded(spark):
    df = spark.createDataFrame([(1, "one, two; three (four)"), (2, "One two -- three four!")], "doc_id long, text string")
    assert {r["doc_id"]: r["removed"] for r in o10.per_document(df).collect()} == {1: [], 2: [0]}


def test_lines_of_any_length_and_script(spark):
    han = "".join(chr(0x4E00 + (37 * k) % 900) for k in range(40))
    texts = ["shared", "Shared", "***", "***\n---", "a\tb\tc\td", "a b c d", han, han[:20] + "\u9fa0" + han[21:], "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["removed"] for r in o10.per_document(df).collect()}
    assert got == {0: [], 1: [0], 2: [], 3: [0], 4: [], 5: [0], 6: [], 7: [0], 8: []}


def test_long_lines_by_their_windows(spark):
    """Beyond LONG_LINE characters, at any length: a few edits, and other lines of the same words."""
    rng = random.Random(8)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(20_000)]
    few = list(base)
    for k in rng.sample(range(len(few)), 3):
        few[k] = "changed"
    texts = [" ".join(w) for w in (base, few, [rng.choice(vocabulary) for _ in range(20_000)])]
    han = "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(6000))
    texts += [han, han[:3000] + "xyz" + han[3000:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["removed"] for r in o10.per_document(df).collect()} == {0: [], 1: [0], 2: [], 3: [], 4: [0]}


def test_long_lines_by_edit_similarity(spark):
    """Scattered edits spoil most windows of two words, exchanged halves hardly any."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfgklmnprstaeiou") for _ in range(rng.randrange(3, 9)))
    base = [word() for _ in range(900)]
    line = " ".join(base)
    scattered = " ".join(w[:1] + "z" + w[2:] if rng.random() < 0.9 else w for w in base)
    quarter = list(line)
    for k in rng.sample(range(len(line)), len(line) // 4 + 1):
        quarter[k] = "#"                      # one edit too many
    exactly = list(line)
    for k in rng.sample(range(len(line)), len(line) // 4):
        exactly[k] = "#"
    moved = line[:200] + "inserted " * 30 + line[200:2000] + line[2300:]
    texts = [line, scattered, "".join(quarter), "".join(exactly), moved, " ".join(base[450:] + base[:450]), " ".join(word() for _ in base),
             line[: len(line) * 3 // 4 + 1], line[: len(line) * 3 // 4 - 1]]
    assert len(line) > o10.LONG_LINE
    hashed = spark.createDataFrame(list(enumerate(texts)), "line_hash long, norm string")
    pairs = spark.createDataFrame([(0, b) for b in range(1, len(texts))], "a long, b long")
    got = {r.b for r in o10.verifier(hashed, o10.SIMILARITY)(pairs).collect()}
    assert got == {1, 3, 4, 7}


def edited(seed=3, n=60):
    """Short lines and copies of them with one or two characters replaced."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    out = []
    for _ in range(n):
        w = " ".join(word() for _ in range(rng.randrange(3, 6)))
        while len(w) < o10.MIN_CHARS:
            w += " " + word()
        t = list(w)
        for k in rng.sample(range(len(t)), rng.randrange(1, 3)):
            t[k] = "x"
        out += [w, "".join(t)]
    return list(dict.fromkeys(out))


def test_every_class_gives_a_key(spark):
    """Short lines, whose classes tell too little alone, are blocked like others."""
    texts = [*edited(), "a b c", "aaaaaaaaaaaaaaaaaaaaaaaa", "na na na na na na na", "one two three four five six seven"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = o10.block_keys(df.select(F.col("doc_id").alias("line_hash"), F.col("text").alias("norm")))
    assert {r["id"] for r in keys.select("id").distinct().collect()} == set(range(len(texts)))


def test_short_lines_with_few_edits_are_found(spark):
    texts = edited()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links = [(j, i) for i, a in enumerate(texts) for j, b in enumerate(texts[:i]) if edit(a, b) <= 0.25 * max(len(a), len(b)) + 1e-9]
    group = groups(range(len(texts)), links)
    want = {i for i, g in group.items() if g != i}
    got = {r["doc_id"] for r in o10.per_document(df).collect() if r["removed"]}
    assert len(want) >= 50 and got <= want and len(got) >= 0.75 * len(want)
