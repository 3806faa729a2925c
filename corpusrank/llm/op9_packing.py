"""Packing by non-negative least squares over the length histogram.

A document is its ids plus an end id.  Its full windows are sequences by
themselves; what remains, 1 to ``window - 1`` tokens, is its tail.  The
histogram of tail lengths (``window`` numbers, whatever the table's size) goes
to the driver, which enumerates the pairs and triples of lengths that fill a
window exactly and solves for their repeat counts by non-negative least squares
(accelerated projected gradient).  The counts are rounded down, a greedy pass
takes what the rounding left of exact fills, and the remaining tails are packed
greedily one after the other into windows, cut where a window ends.  So only
the very last sequence can need padding.

The plan says, for every length, which ranks of it go where; a row finds its
rank from per-bucket counts and a window inside a (length, bucket), so a length
that a third of all documents share is many small windows.

Null text is empty: its document is the end id alone.  Null ids are packed like
others; repeated rows are packed each.  An empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusrank.llm.common import saved
from corpusrank.llm.tokens import default_path, encode, encoder

PIECE = ("id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def combinations(hist: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c) with a >= b >= c >= 0 that fill a window from lengths that
    occur; c = 0 marks a pair."""
    has = hist > 0
    has[0] = True
    b, c = np.meshgrid(np.arange(1, window), np.arange(0, window), indexing="ij")
    a = window - b - c
    ok = (a >= b) & (b >= c) & (a < window)
    a, b, c = a[ok], b[ok], c[ok]
    ok = has[a] & has[b] & has[c]
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def repeat_counts(combos: np.ndarray, hist: np.ndarray, steps: int = 400) -> np.ndarray:
    """min |A x - hist| over x >= 0, A counting each length in a combination."""
    if not len(combos):
        return np.zeros(0)
    goal = hist.astype(float)
    goal[0] = 0
    real = combos > 0

    def use(x):
        u = np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=len(goal))
        u[0] = 0
        return u

    def back(r):
        return (r[combos] * real).sum(axis=1)

    v = np.ones(len(combos))
    for _ in range(30):
        v = back(use(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (1.05 * norm)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(use(y) - goal))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


@dataclass
class Plan:
    """Where the ranks of every tail length go."""
    window: int
    ranges: dict = field(default_factory=dict)   # length -> arrays (start, first sequence, per copy, offset)
    covered: np.ndarray = None                   # per length: ranks that combinations take
    left_at: np.ndarray = None                   # per length: where its other tails begin in the stream
    n_fill: int = 0
    n_left: int = 0

    def place(self, length: int, rank: int) -> tuple[int, int]:
        """(sequence, offset) of a tail."""
        if rank < self.covered[length]:
            start, first, per, offset = self.ranges[length]
            i = int(np.searchsorted(start, rank, side="right")) - 1
            q = rank - int(start[i])
            return int(first[i]) + q // int(per[i]), int(offset[i]) + q % int(per[i]) * length
        at = int(self.left_at[length]) + (rank - int(self.covered[length])) * length
        return self.n_fill + at // self.window, at % self.window


def make_plan(hist: np.ndarray, window: int) -> Plan:
    left = hist.astype(np.int64).copy()
    left[0] = 0
    combos = combinations(left, window)
    x = repeat_counts(combos, left)
    plan, ranges, sequence = Plan(window), {}, 0
    used = np.zeros(len(left), dtype=np.int64)
    order = np.lexsort((np.arange(len(x)), -x))
    for rounded in (True, False):
        for i in order:
            parts = {}
            for n in combos[i]:
                if n:
                    parts[int(n)] = parts.get(int(n), 0) + 1
            times = min(int(left[n]) // m for n, m in parts.items())
            if rounded:
                times = min(times, int(x[i]))
            if times <= 0:
                continue
            offset = 0
            for n, m in parts.items():
                ranges.setdefault(n, []).append((int(used[n]), sequence, m, offset))
                used[n] += m * times
                left[n] -= m * times
                offset += m * n
            sequence += times
    plan.ranges = {n: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for n, r in ranges.items()}
    plan.covered, plan.n_fill = used, sequence
    tokens = left * np.arange(len(left))
    plan.left_at = np.concatenate([[0], np.cumsum(tokens)[:-1]])
    plan.n_left = -(-int(tokens.sum()) // window)
    return plan


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def id_type(path: str) -> str:
    return "<u2" if encoder(path).n_vocab <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, window: int, end_id: int, path: str, id_col: str, text_col: str) -> DataFrame:
    """``(id, n_tokens, full_crc, tail, tail_crc)``: checksums of the full
    windows, and the ids of the tail."""
    narrow = id_type(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at: at + 500]
                n, full, tails, tcrc = [], [], [], []
                for t in part["text"]:
                    ids = np.append(encode(t, path), np.uint32(end_id))
                    cut = len(ids) // window * window
                    n.append(len(ids))
                    full.append([crc(ids[i: i + window]) for i in range(0, cut, window)])
                    tails.append(ids[cut:].astype(narrow).tobytes())
                    tcrc.append(crc(ids[cut:]))
                yield pd.DataFrame({"id": part["id"].to_numpy(), "n_tokens": n, "full_crc": full, "tail": tails, "tail_crc": tcrc})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(
        run, "id long, n_tokens long, full_crc array<long>, tail binary, tail_crc long")


def pack(docs: DataFrame, window: int = 1024, end_id: int = 0, n_buckets: int = 256, path: str | None = None,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``."""
    path = path or default_path()
    narrow = id_type(path)
    rows = saved(encoded(docs, window, end_id, path, id_col, text_col), "encoded")
    rows = (rows.withColumn("tail_tokens", F.expr(f"int(n_tokens % {window})"))
            .withColumn("bucket", F.pmod(F.xxhash64("id", "n_tokens", "tail_crc"), F.lit(n_buckets)).cast("int")))
    counts = rows.groupBy("tail_tokens", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(f"n_tokens div {window}")).alias("full"))
    totals = counts.groupBy("tail_tokens").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).orderBy("tail_tokens").collect()
    hist, full_at, full = np.zeros(window, dtype=np.int64), {}, 0
    for r in totals:   # at most `window` rows
        hist[r["tail_tokens"]], full_at[r["tail_tokens"]] = r["n"], full
        full += r["full"]
    plan = make_plan(hist, window)
    first_full = plan.n_fill + plan.n_left
    before = Window.partitionBy("tail_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tail_tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_at"),
                           F.coalesce(F.sum("full").over(before), F.lit(0)).alias("full_at"))
    order = Window.partitionBy("tail_tokens", "bucket").orderBy("id", "n_tokens", "tail_crc")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (rows.withColumn("rank", F.row_number().over(order) - 1)
              .withColumn("full", F.coalesce(F.sum(F.expr(f"n_tokens div {window}")).over(upto), F.lit(0)))
              .join(starts, ["tail_tokens", "bucket"])
              .select("id", "n_tokens", "tail_tokens", "full_crc", "tail", "tail_crc",
                      (F.col("rank") + F.col("rank_at")).alias("rank"), (F.col("full") + F.col("full_at")).alias("full")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for pdf in batches:
            out = []
            for i, n, k, crcs, tail, tcrc, rank, at in zip(*(pdf[c] for c in (
                    "id", "n_tokens", "tail_tokens", "full_crc", "tail", "tail_crc", "rank", "full"))):
                i = None if pd.isna(i) else int(i)
                first = first_full + full_at[k] + at
                for w, c in enumerate(crcs):
                    out.append((i, w * window, window, c, n, first + w, 0))
                if not k:
                    continue
                sequence, offset = plan.place(k, rank)
                fits = min(k, window - offset)
                if fits == k:
                    out.append((i, n - k, k, tcrc, n, sequence, offset))
                else:
                    ids = np.frombuffer(tail, dtype=narrow)
                    out.append((i, n - k, fits, crc(ids[:fits]), n, sequence, offset))
                    out.append((i, n - k + fits, k - fits, crc(ids[fits:]), n, sequence + 1, 0))
            cols = list(zip(*out)) if out else [[] for _ in names]
            yield pd.DataFrame({c: pd.array(v, dtype="Int64") for c, v in zip(names, cols)})

    return ranked.mapInPandas(run, PIECE).withColumnRenamed("id", id_col)
