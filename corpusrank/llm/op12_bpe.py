"""Byte-level BPE encoding and decoding without a regex.

Pre-tokenisation.  The split pattern of the vocabulary (`public_tokenizers.PATTERN`)
is a small automaton over classes of code points.  A text becomes an array of
classes (one table lookup per code point); every class is a transition function
from states to states.  Composing such functions is associative and the functions
that can arise are few (a finite monoid, closed once per process), so the state
before every code point is a scan over small integers: blocks of the array are
composed side by side, then the block totals, then every block gets its entry state.
The first code point of a text resets the automaton, so many texts are scanned as
one array.  A second table tells from the state before a code point and its class
whether a token starts there; three rules also look at the class after it.

Merging.  The slices between starts go through a cache of finished slices (at most
``CACHE`` of them, then emptied).  A slice that is no token itself is merged lowest
rank first, leftmost on ties; slices of ``LONG`` bytes or more with a heap, so a text
without blanks costs length times its logarithm.

Decoding.  Encoding keeps every token's end as a byte offset.  Decoding fills each
token's place from the table of token bytes, so any run of tokens can be decoded on
its own (`decode_tokens`).

Texts are processed in parts of at most ``PART`` code points in the scan; a longer
text carries its state from part to part.  Null text is the empty text (no ids).
Null ids and repeated rows are rows like any other.  An empty table gives no rows;
extra columns are ignored.  The vocabulary file must be readable on every executor.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PART, WIDTH, CACHE, LONG = 1 << 19, 256, 250_000, 128
U32 = np.dtype("<u4")

# Classes of code points: letters that the pattern's contractions name stand apart.
LETTER, NUMBER, OTHER, SPACE, WHITE, QUOTE, STMD, RV, E, ELL = range(10)
N_CLASSES = 10
# The letters of the pattern's contractions 's 't 'm 'd, 're 've, 'll.
NAMED = {"s": STMD, "t": STMD, "m": STMD, "d": STMD, "r": RV, "v": RV, "e": E, "l": ELL, " ": SPACE, "'": QUOTE}

# States: what the code points so far have opened.  OPEN: a token has just ended (or the text begins).
OPEN, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_WHITE, AFTER_QUOTE, QUOTE_RV, QUOTE_L = range(9)
N_STATES = 9

# Whether a token starts at a code point; the last three look at the next class.
NO, YES, UNLESS_E, UNLESS_ELL, BEFORE_WORD = range(5)


def step(state: int, cls: int) -> int:
    """The state after a code point of class ``cls``."""
    if cls == NUMBER:
        return IN_NUMBERS
    if cls == OTHER:
        return IN_OTHERS
    if cls == SPACE:
        return AFTER_SPACE
    if cls == WHITE:
        return AFTER_WHITE
    if cls == QUOTE:
        return IN_OTHERS if state in (IN_OTHERS, AFTER_SPACE, AFTER_QUOTE) else AFTER_QUOTE
    if state == AFTER_QUOTE:
        return {STMD: OPEN, RV: QUOTE_RV, ELL: QUOTE_L}.get(cls, IN_LETTERS)
    if (state, cls) in ((QUOTE_RV, E), (QUOTE_L, ELL)):
        return OPEN
    return IN_LETTERS


def starts_token(state: int, cls: int) -> int:
    """Whether a token starts at a code point of class ``cls`` in ``state``."""
    if state == OPEN:
        return YES
    if cls in (SPACE, WHITE):
        return BEFORE_WORD if state in (AFTER_SPACE, AFTER_WHITE) else YES
    if state == AFTER_SPACE:
        return NO
    if cls == NUMBER:
        return NO if state == IN_NUMBERS else YES
    if cls in (OTHER, QUOTE):
        return NO if state in (IN_OTHERS, AFTER_QUOTE) else YES
    if state == AFTER_QUOTE:
        return {STMD: NO, RV: UNLESS_E, ELL: UNLESS_ELL}.get(cls, YES)
    return NO if state in (IN_LETTERS, QUOTE_RV, QUOTE_L) else YES


@lru_cache(maxsize=1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``(element, times, apply, one)``: the element of every class (and, from
    ``N_CLASSES`` on, of the class as the first of its text), the table of
    compositions, the table of element x state, and the identity."""
    gens = [tuple(step(s, c) for s in range(N_STATES)) for c in range(N_CLASSES)]
    gens += [(step(OPEN, c),) * N_STATES for c in range(N_CLASSES)]
    number = {tuple(range(N_STATES)): 0}
    queue = list(number)
    for f in queue:
        for g in gens:
            h = tuple(g[s] for s in f)
            if h not in number:
                number[h] = len(number)
                queue.append(h)
    funcs = np.array(queue)
    times = np.empty((len(queue), len(queue)), dtype=np.uint16)
    for i, f in enumerate(queue):
        for j, g in enumerate(queue):
            times[i, j] = number[tuple(g[s] for s in f)]
    return (np.array([number[g] for g in gens], dtype=np.uint16), times, funcs.astype(np.uint8), 0)


def states(elements: np.ndarray, entry: int) -> np.ndarray:
    """The state after every element, from ``entry``, by an associative scan."""
    _, times, apply, one = monoid()
    m, flat = len(times), times.ravel()
    n = len(elements)
    if n <= WIDTH:
        out, s = np.empty(n, dtype=np.uint8), entry
        for i, e in enumerate(elements.tolist()):
            s = out[i] = apply[e, s]
        return out
    rows = -(-n // WIDTH)
    x = np.full(rows * WIDTH, one, dtype=np.uint16)
    x[:n] = elements
    x = np.ascontiguousarray(x.reshape(rows, WIDTH).T).astype(np.int64)
    for j in range(1, WIDTH):                      # all blocks at once
        x[j] = flat[x[j - 1] * m + x[j]]
    total = states(x[-1].astype(np.uint16), entry)
    before = np.concatenate([[entry], total[:-1]]).astype(np.uint8)
    return apply[x, before].T.reshape(-1)[:n]


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point.  Which code points are letters, numbers and white
    space depends on a library's Unicode version, so the tokenizer library that the
    ids must match is asked once: an encoding whose pattern is one class drops all
    other code points."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    for pattern, cls in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        only = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        members = bytes(only.encode_ordinary(every)).decode()
        table[np.frombuffer(members.encode("utf-32-le"), dtype=U32)] = cls
    for c, cls in NAMED.items():
        table[ord(c)] = cls
    return table


@lru_cache(maxsize=1)
def _rules() -> np.ndarray:
    return np.array([[starts_token(s, c) for c in range(N_CLASSES)] for s in range(N_STATES)], dtype=np.uint8)


def token_starts(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Which of ``codes`` (code points of texts laid end to end) start a slice;
    ``firsts`` are the places of the texts' first code points, ascending."""
    element, rules, table = monoid()[0], _rules(), class_table()
    out, entry = [], OPEN
    for at in range(0, len(codes), PART):
        cls = table[codes[at: at + PART + 1]]                # one more: the next class
        n = min(PART, len(codes) - at)
        first = firsts[np.searchsorted(firsts, at): np.searchsorted(firsts, at + n + 1)] - at
        following = np.full(n, N_CLASSES, dtype=np.uint8)    # no next code point in this text
        following[: len(cls) - 1] = cls[1: n + 1]
        ends = first[(first > 0) & (first <= n)] - 1
        following[ends] = N_CLASSES
        first, cls = first[first < n], cls[:n]
        gen = cls.copy()
        gen[first] += N_CLASSES
        after = states(element[gen], entry)
        before = np.concatenate([[entry], after[:-1]])
        before[first] = OPEN
        rule = rules[before, cls]
        starts = rule == YES
        starts |= (rule == UNLESS_E) & (following != E)
        starts |= (rule == UNLESS_ELL) & (following != ELL)
        starts |= (rule == BEFORE_WORD) & (following != N_CLASSES) & (following != SPACE) & (following != WHITE)
        out.append(starts)
        entry = int(after[-1])
    return np.concatenate(out) if out else np.empty(0, dtype=bool)


def _merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one slice: the pair of lowest rank merges first."""
    none = len(ranks)
    at = list(range(len(piece) + 1))
    rank = [ranks.get(piece[i: i + 2], none) for i in range(len(piece) - 1)]
    while rank:
        low = min(rank)
        if low == none:
            break
        i = rank.index(low)
        del at[i + 1], rank[i]
        if i < len(rank):
            rank[i] = ranks.get(piece[at[i]: at[i + 2]], none)
        if i:
            rank[i - 1] = ranks.get(piece[at[i - 1]: at[i + 1]], none)
    return tuple(ranks[piece[a:b]] for a, b in zip(at, at[1:]))


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same with a heap of pairs over linked parts."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))                  # 0: the part has been merged away
    heap = [(ranks[piece[i: i + 2]], i, i + 2) for i in range(n - 1) if piece[i: i + 2] in ranks]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            r = ranks.get(piece[i: end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[j]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not end[i] or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return tuple(ranks[piece[i: end[i]]] for i in range(n) if end[i])


class Slices(dict):
    """Slice -> ids, remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        rank = self.ranks.get(piece)
        if rank is not None:
            ids = (rank,)
        else:
            ids = _merge(piece, self.ranks) if len(piece) < LONG else _merge_long(piece, self.ranks)
        if len(self) >= CACHE:
            self.clear()
        if len(piece) < LONG:
            self[piece] = ids
        return ids


class Vocabulary:
    """The ranks of one file and the bytes of its tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.slices = Slices(self.ranks)
        self.length = np.zeros(max(self.ranks.values()) + 1, dtype=np.int64)
        for piece, i in self.ranks.items():
            self.length[i] = len(piece)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.zeros(int(self.length.sum()), dtype=np.uint8)
        for piece, i in self.ranks.items():
            self.bytes[self.start[i]: self.start[i] + len(piece)] = np.frombuffer(piece, dtype=np.uint8)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(texts: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(ids, ends, n)``: the ids of all texts end to end, every token's end as a
    byte offset in its text, and the number of ids of every text."""
    whole = "".join(texts)
    data = whole.encode("utf-8")
    codes = np.frombuffer(whole.encode("utf-32-le"), dtype=U32)
    chars = np.cumsum([len(t) for t in texts])
    firsts = np.unique(np.concatenate([[0], chars[:-1]]).astype(np.int64))
    at = np.flatnonzero(token_starts(codes, firsts[firsts < len(codes)]))
    byte_ends = chars
    if len(data) != len(codes):                       # code points of more than one byte
        width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        offset = np.concatenate([[0], np.cumsum(width)])
        at, byte_ends = offset[at], offset[chars]
    cut = at.tolist() + [len(data)]
    found = list(map(vocab.slices.__getitem__, [data[a:b] for a, b in zip(cut, cut[1:])]))
    ids = np.fromiter(chain.from_iterable(found), dtype=U32)
    ends = np.cumsum(vocab.length[ids])
    upto = np.searchsorted(ends, byte_ends, side="right")
    n = np.diff(upto, prepend=0)
    ends -= np.repeat(np.concatenate([[0], byte_ends[:-1]]), n)
    return ids, ends, n


def decode_tokens(ids: np.ndarray, ends: np.ndarray, vocab: Vocabulary) -> bytes:
    """The bytes of a run of tokens, each put at its own offset."""
    if not len(ids):
        return b""
    length = vocab.length[ids]
    first = int(ends[0]) - int(length[0])
    place = np.arange(int(ends[-1]) - first) + np.repeat(vocab.start[ids] - (ends.astype(np.int64) - length - first), length)
    return vocab.bytes[place].tobytes()


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
           chunk: int = PART) -> DataFrame:
    """``(id, ids, ends)``: the ids of each text and their byte ends, both packed as
    little-endian unsigned 32-bit integers."""
    path = path or public_tokenizers.path(VOCABULARY)

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, ends, n = encode_texts(pdf["text"].tolist(), vocabulary(path))
        upto = 4 * np.concatenate([[0], np.cumsum(n)])
        packed, places = ids.tobytes(), ends.astype(U32).tobytes()
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "ids": [packed[a:b] for a, b in zip(upto, upto[1:])],
                             "ends": [places[a:b] for a, b in zip(upto, upto[1:])]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.assign(id=pdf["id"].astype("Int64"))
            part = (pdf["text"].str.len().cumsum() // chunk).to_numpy()
            for _, some in pdf.groupby(part, sort=False):
                yield rows(some)

    some = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return some.mapInPandas(run, "id long, ids binary, ends binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``decoded``, the bytes of ``ids`` placed by ``ends``."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(path)
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                some = pdf.iloc[at: at + 500]
                yield some.drop(columns=["ids", "ends"]).assign(decoded=[
                    decode_tokens(np.frombuffer(i, dtype=U32), np.frombuffer(e, dtype=U32), vocab)
                    for i, e in zip(some["ids"], some["ends"])])

    some = encoded.select(*keep, "ids", "ends")
    schema = ", ".join(f"`{c}` {some.schema[c].dataType.simpleString()}" for c in keep)
    return some.mapInPandas(run, f"{schema}, decoded binary")


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` of the round trip."""
    enc = encode(docs, path, id_col, text_col).withColumn("n_tokens", F.expr("bigint(octet_length(ids) DIV 4)"))
    enc = enc.withColumn("ids_sha256", F.sha2("ids", 256))
    return decode(enc, path, (id_col, "n_tokens", "ids_sha256")).select(
        id_col, "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
