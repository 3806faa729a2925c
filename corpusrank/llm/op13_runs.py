"""Runs (maximal periodic stretches) of words, by Baier's grouping.

A run is a stretch of consecutive words with smallest period p (words p apart are
equal), at least ``max(min_length, 2 p)`` words long, that no neighbouring word
extends keeping period p.  `find_runs` returns every run of a text and the text
with each run collapsed to its first p words.

Method, inside a task and over all texts of a batch at once:

1. Words become numbers by their bytes (exact).  A run of 12 words or more contains
   a stretch of at least ``min_length / 2`` words that occurs again p words later, so
   only words inside a window of that many words that recurs in their own text can
   lie in a run; windows are compared by 64-bit hashes, which can only add words, not
   lose any.  The kept stretches are laid end to end, each closed by a sentinel below
   every word.
2. Phase one of Baier's suffix sorter: suffixes start in groups of equal first words;
   from the highest group down, every group with context w gives its members'
   previous-smaller positions l copies of w, and positions with equal l and equal
   group move to a new group right above their old one.  The context lengths at the
   end are the Lyndon array: how long the longest Lyndon word at every position is.
   This is done under the order of the words and under its reverse.
3. Every run has a Lyndon root that is the longest Lyndon word at some position under
   one of the two orders.  The longest common extensions of each position i with
   i + p, to the right and to the left, are found for all positions at once from
   tables of ranks of 2^k words (exact names, no hashing); roots that extend over
   at least 2 p words are the runs.

Work and memory are n log n in the kept words of a batch; a batch is at most ``chunk``
words of texts, or one longer text.

Null text has no words; its collapsed text is empty.  Null ids and repeated rows are
rows like any other.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusrank.llm.common import WORD
from corpusrank.llm.wordhash import U64, mix64

RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"
MIN_LENGTH, CHUNK = 12, 1_000_000


def lyndon_array(rank: list[int]) -> list[int]:
    """Length of the longest Lyndon word at every position of ``rank``; rank 0 is a
    sentinel below all others, each occurrence its own, and gets 0."""
    n = len(rank)
    order = sorted(range(n), key=rank.__getitem__)       # stable: positions ascend in a group
    place = [0] * n                                      # of a position in `order`
    group = [0] * n                                      # first place of a position's group
    end = [0] * (n + 1)                                  # by a group's first place: the place after its last
    context = [0] * n                                    # by a group's first place
    at = 0
    while at < n and rank[order[at]] == 0:
        i = order[at]
        place[i] = group[i] = at
        at += 1
        end[at - 1] = at
    words = at                                           # sentinels are below and never processed
    while at < n:
        first, r = at, rank[order[at]]
        while at < n and rank[order[at]] == r:
            i = order[at]
            place[i], group[i] = at, first
            at += 1
        end[first], context[first] = at, 1
    prev = [-1] * n
    at = n
    while at > words:
        g = group[order[at - 1]]
        w = context[g]
        members = order[g:at] if at - g == 1 else sorted(order[g:at])
        at = g
        if len(members) == 1:                            # one member moves one position alone
            i = members[0]
            j = i - 1
            while j >= 0 and group[j] > g:
                j = prev[j]
            prev[i] = j
            moves = {1: [j]} if j >= 0 and group[j] >= words else None
        else:
            count: dict[int, int] = {}
            for i in members:
                j = i - 1
                while j >= 0 and group[j] >= g:
                    j = prev[j]
                prev[i] = j
                if j >= 0 and group[j] >= words:
                    count[j] = count.get(j, 0) + 1
            moves = {}
            for j, copies in count.items():
                moves.setdefault(copies, []).append(j)
        if not moves:
            continue
        for copies in sorted(moves, reverse=True):
            by_group: dict[int, list[int]] = {}
            for j in moves[copies]:
                by_group.setdefault(group[j], []).append(j)
            for old, some in by_group.items():
                last = end[old]
                first = last - len(some)
                if first == old:                         # the whole group moves: it keeps its place
                    context[old] += copies * w
                    continue
                for j in some:                           # swap to the end of the old group
                    last -= 1
                    other, p = order[last], place[j]
                    order[p], order[last] = other, j
                    place[other], place[j] = p, last
                for j in some:
                    group[j] = first
                end[first], end[old] = end[old], first
                context[first] = context[old] + copies * w
    return [context[group[i]] if rank[i] else 0 for i in range(n)]


def rank_tables(x: np.ndarray) -> list[np.ndarray]:
    """Table k names the 2^k symbols from every position (shorter at the end)."""
    tables, k = [x.astype(np.int64)], 1
    while k < len(x):
        t = tables[-1]
        if len(np.unique(t)) == len(t):                  # all different: no longer match
            break
        pair = t[:-k] * (int(t.max()) + 1) + t[k:]
        tables.append(np.unique(pair, return_inverse=True)[1])
        k *= 2
    return tables


def extension(tables: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix from ``i`` and from ``j`` (i < j)."""
    i, j, out = i.copy(), j.copy(), np.zeros(len(i), dtype=np.int64)
    for k in range(len(tables) - 1, -1, -1):
        t = tables[k]
        inside = np.flatnonzero(j < len(t))
        same = inside[t[i[inside]] == t[j[inside]]]
        for c in (i, j, out):
            c[same] += 1 << k
    return out


def runs_of(x: np.ndarray) -> np.ndarray:
    """``(start, length, period)`` rows of the runs of ``x``, which holds words from
    1 on and ends every text with a 0, ordered by start, then period."""
    n = len(x)
    texts = np.flatnonzero(x == 0)
    apart = x.astype(np.int64)
    apart[texts] = int(x.max()) + 1 + np.arange(len(texts))     # sentinels differ from each other
    forward, backward = rank_tables(apart), rank_tables(apart[::-1])
    found = []
    for rank in (x, np.where(x == 0, 0, int(x.max()) + 1 - x)):
        p = np.array(lyndon_array(rank.tolist()), dtype=np.int64)
        i = np.flatnonzero(p > 0)
        p = p[i]
        fits = i + p < n
        i, p = i[fits], p[fits]
        right = extension(forward, i, i + p)
        left = extension(backward, n - (i + p), n - i)           # ends just before i + p and i
        long = left + right >= p
        found.append(np.stack([(i - left)[long], (left + right + p)[long], p[long]], axis=1))
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def repeated_stretches(ids: np.ndarray, text: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a window of ``k`` words that occurs again in their text."""
    n = len(ids) - k + 1
    inside = np.zeros(len(ids), dtype=bool)
    if n < 2:
        return inside
    h = mix64(text[:n].astype(U64) + U64(1))
    for j in range(k):
        h = mix64(h * U64(0x9E3779B97F4A7C15) + ids[j: n + j].astype(U64))
    whole = np.flatnonzero(text[:n] == text[k - 1:])
    h = h[whole]
    by = np.argsort(h, kind="stable")
    same = h[by[1:]] == h[by[:-1]]
    again = np.zeros(len(h), dtype=bool)
    again[by[1:][same]] = True
    again[by[:-1][same]] = True
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(cover, whole[again], 1)
    np.add.at(cover, whole[again] + k, -1)
    return np.cumsum(cover)[:-1] > 0


def runs_of_texts(texts: list[list[bytes]], min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """The runs of every text of words, as ``(start, length, period)`` rows."""
    number: dict[bytes, int] = {}
    n = np.array([len(t) for t in texts], dtype=np.int64)
    ids = np.fromiter((number.setdefault(w, len(number) + 1) for t in texts for w in t), dtype=np.int64, count=int(n.sum()))
    text = np.repeat(np.arange(len(texts)), n)
    at = np.flatnonzero(repeated_stretches(ids, text, max(1, (min_length + 1) // 2)))
    if not len(at):
        return [np.empty((0, 3), dtype=np.int64)] * len(texts)
    last = np.ones(len(at), dtype=bool)                     # of a stretch of one text
    last[:-1] = (np.diff(at) > 1) | (np.diff(text[at]) > 0)
    place = np.arange(len(at)) + np.cumsum(last) - last     # with a sentinel after every stretch
    x = np.zeros(len(at) + int(last.sum()), dtype=np.int64)
    x[place] = np.unique(ids[at], return_inverse=True)[1] + 1
    rows = runs_of(x)
    rows = rows[rows[:, 1] >= min_length]
    back = np.full(len(x), -1, dtype=np.int64)
    back[place] = at
    rows[:, 0] = back[rows[:, 0]]
    owner = text[rows[:, 0]]
    rows[:, 0] -= (np.cumsum(n) - n)[owner]
    upto = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(upto, upto[1:])]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run repeats, joined by blanks."""
    if not len(runs):
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)])


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text",
              chunk: int = CHUNK) -> DataFrame:
    """``(id, runs, collapsed)``: the runs of each text by start, then period, and
    its collapsed words (UTF-8)."""
    def rows(ids: list, texts: list[list[bytes]]) -> pd.DataFrame:
        runs = runs_of_texts(texts, min_length)
        return pd.DataFrame({"id": pd.array(ids, dtype="Int64"),
                             "runs": [[dict(zip(("start", "length", "period"), r)) for r in some.tolist()] for some in runs],
                             "collapsed": [collapsed(t, r) for t, r in zip(texts, runs)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts, n = [], [], 0
            for i, t in zip(pdf["id"].astype("Int64"), pdf["text"]):
                ids.append(i)
                texts.append(t.split() if t else [])
                n += len(texts[-1])
                if n >= chunk:
                    yield rows(ids, texts)
                    ids, texts, n = [], [], 0
            if ids:
                yield rows(ids, texts)

    some = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return some.mapInPandas(run, f"id long, runs {RUN}, collapsed binary").withColumnRenamed("id", id_col)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text)`` where a tenth of the texts, chosen by the id's checksum, repeats
    its words from some word on with some period.  Null ids have no checksum and keep
    their text."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"),
                    F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")).alias("_h"))
    d = d.withColumn("_g", F.expr("_h DIV 10")).withColumn("_w", F.when(F.expr("_h % 10 = 0"), words))
    d = d.withColumn("_n", F.size("_w")).withColumn("_a", F.expr("IF(_n > 0, _g % _n, 0)"))
    d = d.withColumn("_p", F.expr("1 + (_n - _a) DIV (3 + _g % 8)"))
    planted = F.expr("""array_join(transform(sequence(0, _n - 1),
        i -> element_at(_w, int(1 + IF(i < _a, i, _a + (i - _a) % _p)))), ' ')""")
    return d.select(F.col("_id").alias(id_col), F.when(F.col("_n") > 0, planted).otherwise(F.col("text")).alias(text_col))


def _digest(c: Column) -> Column:
    return F.sha2(c, 256)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row of numbers per row of `find_runs`."""
    longest = F.expr("""get(array_sort(runs, (x, y) -> CASE WHEN x.length <> y.length THEN IF(x.length > y.length, -1, 1)
        WHEN x.start <> y.start THEN IF(x.start < y.start, -1, 1) WHEN x.period < y.period THEN -1 WHEN x.period > y.period THEN 1
        ELSE 0 END), 0)""")
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\\n'), '')")
    d = found.withColumn("_l", longest)
    return d.select(id_col, F.size("runs").cast("long").alias("n_runs"), F.col("_l.start").alias("start"),
                    F.col("_l.length").alias("length"), F.col("_l.period").alias("period"),
                    F.expr("bigint(1000 * _l.length DIV _l.period)").alias("exponent_milli"),
                    _digest(lines.cast("binary")).alias("runs_sha256"), _digest(F.col("collapsed")).alias("collapsed_sha256"))
