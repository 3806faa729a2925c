"""Alignment of two tokenizers' tokens, by a monoid of fragments.

Tokenizer A (byte-level BPE) encodes a blank and the text, tokenizer B (pieces with
byte fallback) the text, before which it puts a blank itself.  Both spell the same
bytes.  Offsets where an A and a B token both end cut the tokens into groups; every
A-B pair of occurrences in a group is a link; an id pair's count is the number of
documents that hold it linked.

Fragments.  The tokens that end inside a byte range form a fragment: an open prefix
(up to its first cut), closed groups, and an open suffix (after its last cut); a
fragment without a cut is all prefix.  Joining two neighbours closes one group (the
left one's suffix with the right one's prefix), which is associative, so ranges can be
joined in any tree.

A text of at most ``RANGE`` bytes is one range that starts and ends with a cut, and a
task works on many of them at once (numpy over all tokens of a block).  A longer
text is dealt out by ranges of ``RANGE`` bytes: where a range ends inside something, its
extent runs on to the next single blank between two words, where both tokenizers
split whatever follows (no piece of B holds a blank after another character); the
extents are tokenised in different tasks, tokens go to the range in which they end,
and the ranges' fragments are joined ``FAN`` to one in Spark rounds.  Closed groups
leave as rows at once; only open ends and counters travel up the tree.

Counts.  A block's distinct pairs go through Spark aggregations to corpus-wide counts
and each A id's highest count; a block gets back the counts of its own pairs only, in
a few rows before its own.  No table of all pairs is collected or broadcast.

A text has no tokens (zeros, empty digest) when it is null or empty or when the joined
bytes of A or B differ from the blank and the text.  Null ids and repeated rows are
documents like any other.  An empty table gives no rows; extra columns are ignored.
The vocabulary files must be readable on every executor.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrank.llm.common import saved

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
RANGE, FAN, BLOCK, SLICES = 1 << 16, 8, 1_000_000, 16
BLANK = "▁"
# A blank between two characters that are no white space: both tokenizers split before it.
BETWEEN = re.compile(rf"(?<=[^\s{BLANK}]) (?=[^\s{BLANK}])")


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the tokens' decimal ids with
    the separators of a written alignment."""

    def __init__(self, a_path: str, b_path: str):
        with open(a_path, "rb") as f:
            ranks = {base64.b64decode(x): int(i) for x, i in (line.split() for line in f if line.strip())}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.n_a, self.n_b = max(ranks.values()) + 1, self.b.get_piece_size()
        a_bytes = [b""] * self.n_a
        for x, i in ranks.items():
            a_bytes[i] = x
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece holds a blank after another character: long texts can't be cut at blanks")
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.a_table, self.b_table = _table(a_bytes), _table(b_bytes)
        # first in its list, later in its list
        self.written = [f";{i}" for i in range(self.n_a)] + [f",{i}" for i in range(self.n_a)]
        self.written += [f"|{i}" for i in range(self.n_b)] + [f",{i}" for i in range(self.n_b)]


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(length, start, bytes)`` of tokens by id."""
    length = np.array([len(t) for t in tokens], dtype=np.int64)
    return length, np.cumsum(length) - length, np.frombuffer(b"".join(tokens), dtype=np.uint8)


def _spell(ids: np.ndarray, table) -> np.ndarray:
    length, start, data = table
    n = length[ids]
    return data[np.arange(int(n.sum())) + np.repeat(start[ids] - (np.cumsum(n) - n), n)]


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def default_paths() -> tuple[str, str]:
    return public_tokenizers.path(A_VOCABULARY), public_tokenizers.path(B_VOCABULARY)


def tokenise(texts: list[str], tok: Tokenizers):
    """``(a, a_end, b, b_end, size)``: ids and byte ends of all texts laid end to end,
    and the bytes of every text with its blank; a text that either tokenizer does not
    spell has no tokens and no bytes."""
    a = [tok.a.encode_to_numpy(" " + t).astype(np.int64) if t else np.empty(0, dtype=np.int64) for t in texts]
    b = [np.array(x, dtype=np.int64) for x in tok.b.encode(texts, num_threads=1)]
    data = [(" " + t).encode() if t else b"" for t in texts]
    size = np.array([len(x) for x in data], dtype=np.int64)

    def spells(ids, table):
        got = [int(table[0][x].sum()) for x in ids]
        ok = np.array([g == s for g, s in zip(got, size)])
        same = _spell(np.concatenate([x for x, k in zip(ids, ok) if k] or [a[0][:0]]), table)
        want = np.frombuffer(b"".join(x for x, k in zip(data, ok) if k), dtype=np.uint8)
        wrong = np.flatnonzero(same != want)
        if len(wrong):
            upto = np.cumsum(size[ok])
            ok[np.flatnonzero(ok)[np.unique(np.searchsorted(upto, wrong, side="right"))]] = False
        return ok

    ok = spells(a, tok.a_table) & spells(b, tok.b_table)
    size[~ok] = 0
    none = np.empty(0, dtype=np.int64)
    a_all = np.concatenate([none] + [x for x, k in zip(a, ok) if k])
    b_all = np.concatenate([none] + [x for x, k in zip(b, ok) if k])
    return a_all, np.cumsum(tok.a_table[0][a_all]), b_all, np.cumsum(tok.b_table[0][b_all]), size


class Groups:
    """Closed groups in order: their A ids, their B ids, and how many each has."""

    def __init__(self, a, b, n_a, n_b):
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b

    def links(self) -> np.ndarray:
        return self.n_a * self.n_b

    def written(self, tok: Tokenizers) -> tuple[list[str], np.ndarray]:
        """Every token with the separator before it, in order of writing, and the
        place after each group."""
        ga, gb = np.repeat(np.arange(len(self.n_a)), self.n_a), np.repeat(np.arange(len(self.n_b)), self.n_b)
        upto_a, upto_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        code = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        first = np.ones(len(ga), dtype=bool)
        first[1:] = ga[1:] != ga[:-1]
        code[np.arange(len(ga)) + (upto_b - self.n_b)[ga]] = self.a + np.where(first, 0, tok.n_a)
        first = np.ones(len(gb), dtype=bool)
        first[1:] = gb[1:] != gb[:-1]
        code[np.arange(len(gb)) + upto_a[gb]] = self.b + 2 * tok.n_a + np.where(first, 0, tok.n_b)
        return list(map(tok.written.__getitem__, code.tolist())), upto_a + upto_b

    def pairs(self, owner: np.ndarray, n_b_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(owner, pair, times)``: the distinct id pairs linked in the groups of
        each owner.  Small groups list their links; a large group's distinct ids are
        paired, with the product of their numbers."""
        links = self.links()
        large = np.flatnonzero(links > 1024)
        n = np.where(links > 1024, 0, links)
        g = np.repeat(np.arange(len(n)), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        a0, b0 = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        pair = self.a[a0[g] + at // self.n_b[g]] * n_b_ids + self.b[b0[g] + at % self.n_b[g]]
        who, times = [owner[g]], [np.ones(len(g), dtype=np.int64)]
        pair = [pair]
        for k in large:
            a, ka = np.unique(self.a[a0[k]: a0[k] + self.n_a[k]], return_counts=True)
            b, kb = np.unique(self.b[b0[k]: b0[k] + self.n_b[k]], return_counts=True)
            pair.append((a[:, None] * n_b_ids + b).ravel())
            times.append((ka[:, None] * kb).ravel())
            who.append(np.full(len(a) * len(b), owner[k]))
        return _summed(np.concatenate(who), np.concatenate(pair), np.concatenate(times))


def _summed(who: np.ndarray, pair: np.ndarray, times: np.ndarray):
    by = np.argsort((who << 32) | pair, kind="stable")
    who, pair, times = who[by], pair[by], times[by]
    first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (pair[1:] != pair[:-1])])[: len(who)])
    return who[first], pair[first], np.add.reduceat(times, first) if len(first) else times


def cut(a, a_end, b, b_end) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(cuts, upto_a, upto_b)``: the common ends, and how many tokens end up to each."""
    both = np.isin(a_end, b_end, assume_unique=True) if len(a_end) else np.empty(0, dtype=bool)
    cuts = a_end[both]
    return cuts, np.flatnonzero(both) + 1, np.searchsorted(b_end, cuts) + 1


# ---- texts of one range -----------------------------------------------------

BLOCKS = ("block long, id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
          "groups_sha256 array<string>, n_pairs array<long>, pair array<int>, times array<int>, "
          "block_pair array<int>, block_docs array<int>")


def _block(ids: list, texts: list[str], tok: Tokenizers) -> dict:
    a, a_end, b, b_end, size = tokenise(texts, tok)
    cuts, upto_a, upto_b = cut(a, a_end, b, b_end)
    groups = Groups(a, b, np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0))
    upto = np.cumsum(size)
    owner = np.searchsorted(upto, cuts - 1, side="right")
    tokens, after = groups.written(tok)
    last = np.searchsorted(owner, np.arange(len(texts) + 1))             # groups of the texts
    place = np.concatenate([[0], after])[last]
    text = ["".join(tokens[x:y])[1:] for x, y in zip(place, place[1:])]
    who, pair, times = groups.pairs(owner, tok.n_b)
    block_pair, block_docs = np.unique(pair, return_counts=True)

    def per_text(x):
        return np.diff(np.concatenate([[0], np.cumsum(x)])[last])
    return {"id": ids, "n_a": per_text(groups.n_a), "n_b": per_text(groups.n_b), "n_groups": np.diff(last),
            "n_links": per_text(groups.links()),
            "groups_sha256": [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in text],
            "n_pairs": np.bincount(who, minlength=len(texts)), "pair": pair.astype(np.int32), "times": times.astype(np.int32),
            "block_pair": block_pair.astype(np.int32), "block_docs": block_docs.astype(np.int32)}


def blocks(texts: DataFrame, paths: tuple[str, str], size: int = BLOCK) -> DataFrame:
    """One row per block of texts ``(id, text)``: their numbers, their distinct linked
    pairs, and the pairs of the block with the number of its texts that hold them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizers(*paths)
        number = TaskContext.get().partitionId() << 32
        ids, some, n = [], [], 0

        def flush():
            return pd.DataFrame([{"block": number, **_block(ids, some, tok)}])
        for pdf in batches:
            for i, t in zip(pdf["id"].astype("Int64"), pdf["text"]):
                ids.append(None if i is pd.NA else int(i))
                some.append(t)
                n += len(t)
                if n >= size or len(ids) >= 100_000:
                    yield flush()
                    number, ids, some, n = number + 1, [], [], 0
        if ids:
            yield flush()

    return texts.mapInPandas(run, BLOCKS)


# ---- texts of several ranges ------------------------------------------------

FRAGMENT = ("doc long, no long, ok boolean, n_a long, n_b long, n_groups long, n_links long, first long, "
            "head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>, "
            "closed array<struct<at: bigint, groups: string, pair: array<int>, times: array<int>>>")
NONE = np.empty(0, dtype=np.int64)


def fragment(no: int, a, a_end, b, b_end, tok: Tokenizers) -> dict:
    """The fragment of the tokens that end in range ``no``; its closed groups stand at
    ``2 no + 1``."""
    cuts, upto_a, upto_b = cut(a, a_end, b, b_end)
    f = {"no": no, "ok": True, "n_a": len(a), "n_b": len(b), "n_groups": 0, "n_links": 0, "first": None,
         "head_a": a, "head_b": b, "tail_a": NONE, "tail_b": NONE, "closed": []}
    if len(cuts):
        groups = Groups(a[upto_a[0]: upto_a[-1]], b[upto_b[0]: upto_b[-1]], np.diff(upto_a), np.diff(upto_b))
        f |= {"first": no, "head_a": a[: upto_a[0]], "head_b": b[: upto_b[0]], "tail_a": a[upto_a[-1]:], "tail_b": b[upto_b[-1]:]}
        _close(f, 2 * no + 1, groups, tok)
    return f


def _close(f: dict, at: int, groups: Groups, tok: Tokenizers) -> None:
    if not len(groups.n_a):
        return
    _, pair, times = groups.pairs(np.zeros(len(groups.n_a), dtype=np.int64), tok.n_b)
    f["n_groups"] += len(groups.n_a)
    f["n_links"] += int(groups.links().sum())
    f["closed"] = f["closed"] + [{"at": at, "groups": "".join(groups.written(tok)[0])[1:],
                                  "pair": pair.astype(np.int32), "times": times.astype(np.int32)}]


def start() -> dict:
    """The cut before the first token."""
    return {"no": -1, "ok": True, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "first": -1,
            "head_a": NONE, "head_b": NONE, "tail_a": NONE, "tail_b": NONE, "closed": []}


def join(f: dict, g: dict, tok: Tokenizers) -> dict:
    """The fragment of two neighbouring ranges; the group that a right one's prefix
    closes stands at twice its first range with a cut."""
    cat = lambda x, y: np.concatenate([x, y]).astype(np.int64)
    out = {"no": f["no"], "ok": f["ok"] and g["ok"], **{c: f[c] + g[c] for c in ("n_a", "n_b", "n_groups", "n_links", "closed")}}
    if f["first"] is None:
        return out | {"first": g["first"], "head_a": cat(f["head_a"], g["head_a"]), "head_b": cat(f["head_b"], g["head_b"]),
                      "tail_a": g["tail_a"], "tail_b": g["tail_b"]}
    middle = cat(f["tail_a"], g["head_a"]), cat(f["tail_b"], g["head_b"])
    out |= {"first": f["first"], "head_a": f["head_a"], "head_b": f["head_b"]}
    if g["first"] is None:
        return out | {"tail_a": middle[0], "tail_b": middle[1]}
    out |= {"tail_a": g["tail_a"], "tail_b": g["tail_b"]}
    _close(out, 2 * g["first"], Groups(*middle, np.array([len(middle[0])]), np.array([len(middle[1])])), tok)
    return out


def extents(text: str, size: int) -> list[tuple[int, int]]:
    """Code point ranges of about ``size`` that end before a single blank between
    words; the blank itself is left out, as both tokenizers add one."""
    out, at = [], 0
    while at < len(text):
        blank = BETWEEN.search(text, at + size) if at + size < len(text) else None
        stop = blank.start() if blank else len(text)
        out.append((at, stop))
        at = stop + 1 if blank else len(text)
    return out


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    out["first"] = out["first"].astype("Int64")
    return out


def fragments(texts: DataFrame, paths: tuple[str, str], size: int = RANGE) -> DataFrame:
    """Fragments of ``(doc, text)``, ``2 k`` and ``2 k + 1`` from extent k: what ends
    inside the k-th byte range, and the rest."""
    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, text in zip(pdf["doc"], pdf["text"]):
                byte = 0
                for a, z in extents(text, size):
                    part = text[a:z]
                    yield pd.DataFrame({"doc": [doc], "byte": [byte], "text": [part]})
                    byte += len(part.encode()) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizers(*paths)
        for pdf in batches:
            for doc, byte, text in zip(pdf["doc"], pdf["byte"], pdf["text"]):
                a, a_end, b, b_end, n = tokenise([text], tok)
                # the next byte range that ends inside this extent
                stop = (byte // size + 1) * size - byte
                i, j = np.searchsorted(a_end, stop, side="right"), np.searchsorted(b_end, stop, side="right")
                rows = [{**fragment(2 * byte, a[:i], a_end[:i], b[:j], b_end[:j], tok), "ok": bool(n[0])}]
                if i < len(a):
                    rows.append(fragment(2 * byte + 1, a[i:], a_end[i:], b[j:], b_end[j:], tok))
                yield _frame([{"doc": doc, **r} for r in rows])

    cuts = saved(texts.mapInPandas(cut_up, "doc long, byte long, text string"), "extents")
    return cuts.repartition("doc", "byte").mapInPandas(run, FRAGMENT)


def joined(frags: DataFrame, paths: tuple[str, str], fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """``(whole, closed)``: one fragment per document, and every group closed on the
    way as rows ``(doc, at, groups, pair, times)``."""
    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        tok = tokenizers(*paths)
        rows = pdf.sort_values("no").to_dict("records")
        for r in rows:
            r["first"] = None if pd.isna(r["first"]) else int(r["first"])
            r["closed"] = []                                  # they have left already
        last = bool(rows[0].pop("whole"))
        one = reduce(lambda f, g: join(f, g, tok), rows)
        if last:
            one = join(start(), one, tok)
        one.pop("whole", None)
        return _frame([{"doc": pdf["doc"].iloc[0], **one, "no": rows[0]["no"], "place": rows[0]["place"] // fan}])

    def leaving(level: DataFrame) -> DataFrame:
        return level.select("doc", F.explode("closed").alias("c")).select("doc", "c.*")

    level = saved(frags, "fragments", wide=True)
    out = [leaving(level)]
    # a document's fragments numbered without gaps, so that every round joins `fan`
    order = level.groupBy("doc").agg(F.array_sort(F.collect_list("no")).alias("nos"))
    order = order.select("doc", F.size("nos").alias("n"), F.posexplode("nos").alias("place", "no"))
    level = saved(level.drop("closed").join(order, ["doc", "no"]), "fragments")
    rounds, most = 0, level.agg(F.max("n")).first()[0] or 0
    while True:
        rounds += 1
        keyed = level.withColumn("_g", F.expr(f"place DIV {fan}")).withColumn("whole", F.lit(fan ** rounds >= most))
        level = saved(keyed.drop("n").groupBy("doc", "_g").applyInPandas(
            lambda pdf: compose(pdf.drop(columns="_g")), f"{FRAGMENT}, place long"), "fragments", wide=True)
        out.append(leaving(level))
        if fan ** rounds >= most:
            return level, reduce(DataFrame.unionByName, out)
        level = level.drop("closed").withColumn("n", F.lit(0))


# ---- whole corpus -----------------------------------------------------------

def _looked_up(pair: np.ndarray, known: np.ndarray, docs: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of pairs and whether each is its A id's best, from a block's answers."""
    by = np.argsort(known)
    at = by[np.searchsorted(known, pair, sorter=by)]
    return docs[at], best[at]


RESULT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _answer(r: pd.Series, known: np.ndarray, docs: np.ndarray, best: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame({c: r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")})
    out.insert(0, "id", pd.array([None if pd.isna(i) else int(i) for i in r["id"]], dtype="Int64"))
    who = np.repeat(np.arange(len(out)), r["n_pairs"])
    n_best, count_sum = np.zeros((2, len(out)), dtype=np.int64)
    if len(who):
        docs, best = _looked_up(r["pair"], known, docs, best)
        times = np.array(r["times"], dtype=np.int64)
        np.add.at(n_best, who, times * best)
        np.add.at(count_sum, who, times * docs)
    return out.assign(n_best=n_best, count_sum=count_sum)


def _answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows in the order of blocks, a block's answers before its texts (``texts``):
    one block is held at a time."""
    held = []
    for pdf in batches:
        for i, (texts, known, docs, best) in enumerate(zip(pdf["texts"], pdf["known"], pdf["docs"], pdf["best"])):
            if not texts:
                held.append((known, docs, best))
                continue
            known, docs, best = (np.concatenate(x) for x in zip(*held)) if held else (NONE, NONE, NONE)
            yield _answer(pdf.iloc[i], known, docs, best)
            held = []


def answers(asked: DataFrame, best: DataFrame) -> DataFrame:
    """``(block, known, docs, best)`` for ``asked(block, pair)``: the answers of a block in
    ``SLICES`` rows.  An aggregation by object holds many groups at once, so they are small."""
    rows = asked.join(best, "pair").withColumn("slice", F.expr(f"pmod(hash(pair), {SLICES})")).repartition("block")
    return rows.groupBy("block", "slice").agg(F.collect_list(F.struct("pair", "docs", "best")).alias("x")).select(
        "block", F.col("x.pair").alias("known"), F.col("x.docs").alias("docs"), F.col("x.best").alias("best"))


def pair_counts(blocks: DataFrame, long_pairs: DataFrame | None, n_b_ids: int) -> DataFrame:
    """``(pair, docs, best)``: how many documents hold each pair, and whether that is
    the highest count of its A id."""
    held = blocks.select(F.explode(F.arrays_zip("block_pair", "block_docs")).alias("x")).select(
        F.col("x.block_pair").alias("pair"), F.col("x.block_docs").cast("long").alias("docs"))
    if long_pairs is not None:
        held = held.unionByName(long_pairs.select("pair", F.lit(1).cast("long").alias("docs")))
    counts = saved(held.groupBy("pair").agg(F.sum("docs").alias("docs")), "pair-counts")
    of = F.expr(f"pair DIV {n_b_ids}")
    top = counts.groupBy(of.alias("a")).agg(F.max("docs").alias("top"))
    return saved(counts.withColumn("a", of).join(top, "a").select("pair", "docs", (F.col("docs") == F.col("top")).alias("best")), "pair-best")


def per_document(docs: DataFrame, paths: tuple[str, str] | None = None, size: int = RANGE, block: int = BLOCK,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row
    per document."""
    paths = paths or default_paths()
    n_b = sentencepiece.SentencePieceProcessor(model_file=paths[1]).get_piece_size()
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    is_long = F.octet_length("text") >= size
    short = saved(blocks(d.where(~is_long), paths, block), "blocks", wide=True)
    long = saved(d.where(is_long).select("id", F.monotonically_increasing_id().alias("doc"), "text"), "long-texts", wide=True)
    long_out, long_pairs = None, None
    if not long.isEmpty():
        whole, closed = joined(fragments(long.select("doc", "text"), paths, size), paths)
        some = whole.where("ok").select("doc")
        long_pairs = saved(closed.select("doc", F.explode(F.arrays_zip("pair", "times")).alias("x"))
                           .groupBy("doc", F.col("x.pair").alias("pair")).agg(F.sum(F.col("x.times").cast("long")).alias("times"))
                           .join(F.broadcast(some) if some.count() < 100_000 else some, "doc"), "long-pairs")
    best = pair_counts(short, long_pairs, n_b)
    if long_pairs is not None:
        sums = long_pairs.join(best, "pair").groupBy("doc").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
        written = closed.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", "groups"))).alias("g"))
        written = written.select("doc", F.sha2(F.array_join(F.col("g.groups"), ";").cast("binary"), 256).alias("groups_sha256"))
        numbers = ["n_a", "n_b", "n_groups", "n_links"]
        long_out = (long.select("id", "doc").join(whole.where("ok").select("doc", *numbers), "doc", "left")
                    .join(sums, "doc", "left").join(written.join(some, "doc"), "doc", "left")
                    .select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*numbers, "n_best", "count_sum")],
                            F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")))
    asked = short.select("block", F.explode("block_pair").alias("pair"))
    texts = short.drop("block_pair", "block_docs").withColumn("texts", F.lit(True))
    rows = texts.unionByName(answers(asked, best).withColumn("texts", F.lit(False)), allowMissingColumns=True)
    out = rows.repartition("block").sortWithinPartitions("block", "texts").mapInPandas(_answers, RESULT)
    if long_out is not None:
        out = out.unionByName(long_out.select(*out.columns))
    return out.withColumnRenamed("id", id_col)
