"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the sum of hashed embeddings: itself, its beginnings and its ending
(so a stem with an unseen ending is known).  Filters of several widths slide
over the whole text, each keeps its largest response, and a logistic layer
scores the result.

Training uses a bounded, documented sample of labelled documents, in hash order
(``max_per_class`` documents a class, ``max_bytes`` of text), whole texts, on
the driver.  A quarter of the sample is not learnt from.  All labelled documents
that were neither learnt from nor held out are then scored in Spark tasks; their
histogram by language, logit bin and label, each class weighted to its full
number, sets the scale of the score, puts the best cut at 0.7, and gives each
language with enough positives a threshold of its own.  Labels, language, source and id are never inputs of a
score; the language only picks the threshold of the separate ``rejected``
column.

Every document is scored in Spark tasks; a filter's response to a word at an
offset is one table row, so a text costs one gather per word.

Null and empty texts are scored as a text without words.  Null labels and null
ids are not learnt from; an id labelled twice counts once, toxic if any label
says so.  If a class has no labelled document the score is the smoothed share
of positives.  Repeated rows score alike.  An empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrank.llm.common import sized

FEATURES = 6          # the word, four beginnings, an ending
BINS = 64             # bins of one logit
EDGES = ".,;:!?\"'()[]{}<>|#$%&*_-"


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 15
    dim: int = 16
    widths: tuple = (1, 2, 3)
    filters: int = 12
    epochs: int = 8
    batch: int = 32
    rate: float = 0.01
    seed: int = 11
    max_per_class: int = 1500
    max_bytes: int = 48_000_000
    cut: float = 0.7
    min_positives: int = 10


def word_features(words: list[str], buckets: int) -> np.ndarray:
    """Bucket numbers of every word's parts, in UTF-8 bytes: the word, its
    beginnings of 3 to 6 and its ending of 4; 0 pads."""
    crc, flat = zlib.crc32, []
    for word in words:
        b = (word.strip(EDGES) or word).encode()
        n = len(b)
        three = crc(b[:3], 1)
        four = crc(b[3:4], three)
        five = crc(b[4:5], four)
        flat += (crc(b, 2), three if n >= 3 else -1, four if n >= 4 else -1, five if n >= 5 else -1,
                 crc(b[5:6], five) if n >= 6 else -1, crc(b[-4:], 3) if n >= 4 else -1)
    parts = np.array(flat, dtype=np.int64).reshape(-1, FEATURES)
    return np.where(parts < 0, 0, 1 + parts % (buckets - 1))


def split_words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


class Network:
    """Embedding, filters with max pooling, logistic layer."""

    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.s = s
        self.taps = [(w, j) for w in range(len(s.widths)) for j in range(s.widths[w])]
        self.p = {"E": rng.normal(0, 0.1, (s.buckets, s.dim)).astype(np.float32),
                  "W": rng.normal(0, 0.3, (s.dim, len(self.taps) * s.filters)).astype(np.float32),
                  "b": np.zeros(len(s.widths) * s.filters, dtype=np.float32),
                  "v": rng.normal(0, 0.3, len(s.widths) * s.filters).astype(np.float32),
                  "c": np.zeros(1, dtype=np.float32)}
        self.p["E"][0] = 0

    def word_vectors(self, feats: np.ndarray) -> np.ndarray:
        return self.p["E"][feats].sum(axis=1)

    def responses(self, feats: np.ndarray) -> np.ndarray:
        """Per word: its part in every filter, at every offset."""
        return self.word_vectors(feats) @ self.p["W"]

    def pooled(self, table: np.ndarray, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Largest response of every filter in each text.  ``words`` are rows of
        ``table``; each text is followed by padding words (row 0), enough for
        the widest filter, so that every text has a full window."""
        s, out = self.s, []
        for w, width in enumerate(s.widths):
            n, total = len(words) - width + 1, 0
            for j in range(width):
                col = self.taps.index((w, j)) * s.filters
                total = total + table[words[j: j + n], col: col + s.filters]
            # only windows that lie in one text and its padding
            ends = np.append(starts[1:], len(words)) - width + 1
            out.append(np.maximum.reduceat(total, np.column_stack([starts, ends]).ravel()[:-1], axis=0)[::2])
        return np.maximum(np.concatenate(out, axis=1) + self.p["b"], 0)

    def logits(self, table, words, starts) -> np.ndarray:
        return self.pooled(table, words, starts) @ self.p["v"] + self.p["c"]

    def gradients(self, feats: np.ndarray, words: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict:
        """Gradients of the logistic loss; only the winning windows matter."""
        s, p = self.s, self.p
        u, inv = np.unique(words, return_inverse=True)
        x = self.word_vectors(feats[u])
        table = x @ p["W"]
        ends, best, where = np.append(starts[1:], len(words)), [], []
        for w, width in enumerate(s.widths):
            n, total = len(words) - width + 1, 0
            for j in range(width):
                col = self.taps.index((w, j)) * s.filters
                total = total + table[inv[j: j + n], col: col + s.filters]
            at = np.stack([a + total[a: b - width + 1].argmax(axis=0) for a, b in zip(starts, ends)])
            best.append(np.take_along_axis(total, at, axis=0))
            where.append(at)
        h = np.concatenate(best, axis=1) + p["b"]
        act = np.maximum(h, 0)
        z = act @ p["v"] + p["c"]
        d = (1 / (1 + np.exp(-z)) - y) / len(y)
        g = {"v": act.T @ d, "c": d.sum(keepdims=True)}
        dh = np.outer(d, p["v"]) * (h > 0)
        g["b"] = dh.sum(axis=0)
        gw, gx = np.zeros_like(p["W"]), np.zeros_like(x)
        for w, width in enumerate(s.widths):
            part = dh[:, w * s.filters: (w + 1) * s.filters]
            for j in range(width):
                col = self.taps.index((w, j)) * s.filters
                rows = inv[where[w] + j]                       # (texts, filters)
                block = p["W"][:, col: col + s.filters]
                gw[:, col: col + s.filters] += np.einsum("tf,tfd->df", part, x[rows])
                np.add.at(gx, rows.ravel(), (part[:, :, None] * block.T[None]).reshape(-1, s.dim))
        ge = np.zeros_like(p["E"])
        np.add.at(ge, feats[u].ravel(), np.repeat(gx, FEATURES, axis=0))
        ge[0] = 0
        return {**g, "W": gw, "E": ge}

    def train(self, feats: np.ndarray, texts: list[np.ndarray], y: np.ndarray) -> None:
        """Adam over batches that hold both classes in equal parts."""
        s = self.s
        rng = np.random.default_rng(s.seed + 1)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        q = {k: np.zeros_like(v) for k, v in self.p.items()}
        pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        half, step = s.batch // 2, 0
        for _ in range(s.epochs * max(1, len(texts) // s.batch)):
            step += 1
            pick = np.concatenate([rng.choice(pos, half), rng.choice(neg, half)])
            words, starts = joined([texts[i] for i in pick], max(s.widths))
            for k, g in self.gradients(feats, words, starts, y[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                q[k] = 0.999 * q[k] + 0.001 * g * g
                self.p[k] -= s.rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(q[k] / (1 - 0.999 ** step)) + 1e-8)


def joined(texts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each followed by ``width`` padding words."""
    pad = np.zeros(width, dtype=np.int64)
    words = np.concatenate([x for t in texts for x in (t, pad)])
    starts = np.concatenate([[0], np.cumsum([len(t) + width for t in texts])[:-1]]).astype(np.int64)
    return words, starts


@dataclass
class Model:
    """What scoring needs; ``network`` is None if a class was missing."""
    network: Network | None
    scale: float
    shift: float
    thresholds: dict
    cut: float
    constant: float = 0.5

    def score(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def _cut(z: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> float:
    """The cut with the best F1 over distinct logits with their (weighted) numbers
    of positives and negatives, halfway to the next lower one."""
    u, inv = np.unique(-z, return_inverse=True)
    z, pos, neg = -u, np.bincount(inv, pos), np.bincount(inv, neg)
    f1 = 2 * np.cumsum(pos) / (np.cumsum(pos + neg) + pos.sum())
    i = int(f1.argmax())
    return float((z[i] + z[i + 1]) / 2) if i + 1 < len(z) else float(z[i] - 1)


def calibrate(network: Network, hist: pd.DataFrame, s: Settings) -> Model:
    """Scale from a smoothed logistic fit; the best cut becomes ``s.cut``.
    ``hist`` has ``(lang, z, y, n, w)``, ``n`` rows that stand for ``w``."""
    z, y, n, w8 = (hist[c].to_numpy(dtype=float) for c in ("z", "y", "n", "w"))
    n1, n0 = w8[y == 1].sum(), w8[y == 0].sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = w8 * np.maximum(p * (1 - p), 1e-6)
        d = w8 * (p - goal)
        g = np.array([(d * z).sum(), d.sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    a = min(max(float(a), 0.05), 5.0)
    shift = float(np.log(s.cut / (1 - s.cut)) - a * _cut(z, w8 * y, w8 * (1 - y)))
    model = Model(network, a, shift, {}, s.cut)
    for name, own in hist.groupby("lang").indices.items():
        yes = y[own] == 1
        if n[own][yes].sum() >= s.min_positives and n[own][~yes].sum() >= s.min_positives:
            cut = _cut(z[own], w8[own] * y[own], w8[own] * (1 - y[own]))
            model.thresholds[name] = float(model.score(np.array([cut]))[0])
    return model


def label_histogram(docs: DataFrame, truth: DataFrame, network: Network, s: Settings, id_col: str) -> pd.DataFrame:
    """``(lang, z, y, n)``: documents of ``truth(id, y)`` by language, logit bin
    and label; an id counts once."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(network, 1.0, 0.0, {}, s.cut))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for pdf in batches:
            z = np.clip(scorer.logits(list(pdf["text"])), -60, 60)
            yield pd.DataFrame({"id": pdf["id"], "lang": pdf["lang"], "y": pdf["y"], "bin": np.floor(z * BINS).astype(np.int64)})

    text = docs.select(F.col(id_col).cast("long").alias("id"), "text", "lang")
    scored = text.join(sized(truth), "id").select("id", "text", "lang", "y").mapInPandas(run, "id long, lang string, y int, bin long")
    one = scored.groupBy("id").agg(F.min(F.struct("bin", "lang", "y")).alias("d"))
    hist = one.groupBy("d.lang", "d.bin", "d.y").agg(F.count(F.lit(1)).alias("n")).toPandas()     # at most 7,681 bins a language and label
    hist["z"] = (hist.pop("bin") + 0.5) / BINS
    return hist.sort_values(["lang", "z", "y"], kind="stable").reset_index(drop=True)


def held_out(id_col: str = "doc_id"):
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def known_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``(id, y)`` of the labelled ids that may be learnt from."""
    return (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
            .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y")))


def training_sample(docs: DataFrame, labels: DataFrame, s: Settings, id_col: str, label_col: str) -> pd.DataFrame:
    """At most ``max_per_class`` labelled rows a class, in hash order, whose
    texts fit ``max_bytes``; a text that does not fit is skipped.  The first
    ``4 * max_per_class`` rows that fit alone are looked at.  Null labels and held-out ids are left out."""
    y = known_labels(labels, id_col, label_col)
    size = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.octet_length("text").alias("n"))
    place = F.md5(F.concat(F.lit(f"{s.seed}:"), F.col("id").cast("string")))
    pool = y.join(size.groupBy("id").agg(F.max("n").alias("n")), "id").withColumn("place", place)
    ids = []
    for value in (1, 0):
        fits = pool.where((F.col("y") == value) & (F.coalesce("n", F.lit(0)) <= s.max_bytes / 2))
        rows, taken, total = fits.orderBy("place").limit(4 * s.max_per_class).collect(), 0, 0
        for r in rows:
            n = r["n"] or 0
            if taken < s.max_per_class and total + n <= s.max_bytes / 2:
                taken, total = taken + 1, total + n
                ids.append((r["id"], value, r["place"]))
    if not ids:
        return pd.DataFrame({"id": [], "y": [], "lang": [], "text": [], "place": []})
    chosen = docs.sparkSession.createDataFrame(ids, "id long, y int, place string")
    text = docs.select(F.col(id_col).cast("long").alias("id"), "text", "lang")
    got = text.join(F.broadcast(chosen), "id").select("id", "y", "lang", "text", "place")   # 2 * max_per_class rows
    return got.toPandas().sort_values(["place", "y"], kind="stable").drop_duplicates("place").reset_index(drop=True)


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", label_col: str = "toxic") -> Model:
    sample = training_sample(docs, labels, s, id_col, label_col)
    y = sample["y"].to_numpy(dtype=float)
    share = (y.sum() + 1) / (len(y) + 2)
    if len(set(y)) < 2:
        return Model(None, 1.0, 0.0, {}, s.cut, float(share))
    known, texts = {}, []
    for t in sample["text"]:
        texts.append(np.array([known.setdefault(w, len(known) + 1) for w in split_words(t)], dtype=np.int64))
    feats = np.concatenate([np.zeros((1, FEATURES), dtype=np.int64), word_features(list(known), s.buckets)])
    learn = np.array([int(p[:8], 16) % 4 != 0 for p in sample["place"]])
    if min(y[~learn].sum(), (1 - y[~learn]).sum()) < 2 or min(y[learn].sum(), (1 - y[learn]).sum()) < 1:
        learn = np.ones(len(y), dtype=bool)
    net = Network(s)
    net.train(feats, [t for t, k in zip(texts, learn) if k], y[learn])
    learnt = docs.sparkSession.createDataFrame([(int(i),) for i in sample["id"][learn]], "id long")     # 2 * max_per_class rows
    rest = known_labels(labels, id_col, label_col).join(F.broadcast(learnt), "id", "left_anti")
    hist = label_histogram(docs, rest, net, s, id_col)
    unseen = [hist["n"][hist["y"] == c].sum() for c in (0, 1)]
    if min(unseen) < 2:                             # too few rows: calibrate on the rows learnt from
        words, starts = joined([t for t, k in zip(texts, learn) if k], max(s.widths))
        z = net.logits(net.responses(feats), words, starts)
        return calibrate(net, pd.DataFrame({"lang": sample["lang"][learn], "z": z, "y": y[learn], "n": 1, "w": 1.0}).reset_index(drop=True), s)
    # the rows learnt from are a hash sample of their class: the others stand for them
    whole = [(unseen[c] + (y[learn] == c).sum()) / unseen[c] for c in (0, 1)]
    return calibrate(net, hist.assign(w=hist["n"] * np.where(hist["y"] == 1, whole[1], whole[0])), s)


class Scorer:
    """Scores texts; remembers the responses of up to ``limit`` words."""

    def __init__(self, model: Model, limit: int = 200_000):
        self.m, self.limit = model, limit
        if model.network is not None:
            self.clear()

    def clear(self):
        self.known, self.table = {}, None
        self.extend([])

    def extend(self, new: list[str]):
        net = self.m.network
        feats = word_features(new, net.s.buckets)
        if self.table is None:
            self.table, self.used = net.responses(np.zeros((1, FEATURES), dtype=np.int64)), 1
        need = self.used + len(new)
        if need > len(self.table):
            grown = np.empty((max(need, 2 * len(self.table)), self.table.shape[1]), dtype=self.table.dtype)
            grown[: self.used] = self.table[: self.used]
            self.table = grown
        if len(new):
            self.table[self.used: need] = net.responses(feats)
            self.known.update(zip(new, range(self.used, need)))
            self.used = need

    def scores(self, texts: list, chunk_words: int = 200_000) -> np.ndarray:
        if self.m.network is None:
            return np.full(len(texts), self.m.constant)
        return self.m.score(self.logits(texts, chunk_words))

    def logits(self, texts: list, chunk_words: int = 200_000) -> np.ndarray:
        out, group, n = [], [], 0
        for t in texts:
            ws = split_words(t)
            group.append(ws)
            n += len(ws)
            if n >= chunk_words:
                out.append(self._chunk(group))
                group, n = [], 0
        if group:
            out.append(self._chunk(group))
        return np.concatenate(out) if out else np.empty(0)

    def _chunk(self, group: list[list[str]]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.clear()
        seen = set().union(*group)
        self.extend([w for w in seen if w not in self.known])
        get = self.known.__getitem__
        rows = [np.fromiter(map(get, ws), dtype=np.int64, count=len(ws)) for ws in group]
        words, starts = joined(rows, max(self.m.network.s.widths))
        return self.m.network.logits(self.table, words, starts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """``(id, held_out, score, predicted, threshold, rejected)`` per document.
    ``predicted`` cuts at the model's cut, ``rejected`` at its language's."""
    shared = docs.sparkSession.sparkContext.broadcast(model)     # a few megabytes by its settings

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "held_out": pdf["held_out"], "lang": pdf["lang"],
                                "score": scorer.scores(list(pdf["text"]))})

    scored = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), "lang", "text").mapInPandas(
        run, "id long, held_out boolean, lang string, score double")
    own = F.lit(model.cut)
    for name, value in model.thresholds.items():
        own = F.when(F.col("lang") == name, F.lit(value)).otherwise(own)
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= model.cut).cast("int").alias("predicted"),
                         own.alias("threshold"), (F.col("score") >= own).alias("rejected"))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without those their language's threshold rejects."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(scorer.scores(list(texts)))

    own = F.lit(model.cut)
    for name, value in model.thresholds.items():
        own = F.when(F.col("lang") == name, F.lit(value)).otherwise(own)
    return docs.where(scores(F.col("text")) < own)
