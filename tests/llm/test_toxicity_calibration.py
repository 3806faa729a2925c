"""Op4's cut and thresholds come from all labelled documents, at their class ratio."""

import zlib

import numpy as np
import pandas as pd

from corpusrank.llm import op4_toxicity as o4


def labelled_set(n=3000, seed=2):
    """One document of 15 toxic; the marking word also stands in some clean ones."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "ko", "li", "mu") for b in ("ra", "te", "si") for c in ("n", "l", "x", "da")]
    rows = []
    for i in range(n):
        w = list(rng.choice(vocabulary, rng.integers(5, 30)))
        toxic = i % 15 == 0
        if toxic or rng.random() < 0.05:
            w[rng.integers(len(w))] = "zlother"
        rows.append((i, " ".join(w), "en" if i // 15 % 2 else "de", int(toxic)))
    return rows


def test_languages_get_thresholds_beyond_the_sample(spark, monkeypatch):
    rows = labelled_set()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    seen = []
    plain = o4.calibrate
    monkeypatch.setattr(o4, "calibrate", lambda network, hist, s: seen.append(hist) or plain(network, hist, s))
    model = o4.fit(docs, labels, o4.Settings(max_per_class=40))
    assert set(model.thresholds) == {"de", "en"}      # about 10 positives in a quarter of the sample, 130 outside it
    hist = seen[0]
    truth = o4.known_labels(labels, "doc_id", "toxic").groupBy("y").count().toPandas().set_index("y")["count"]
    for y in (0, 1):                                  # every class counts in full, whatever the sample took
        assert abs(hist["w"][hist["y"] == y].sum() - truth[y]) < 1e-6
    assert hist["n"].sum() >= truth.sum() - 80
    assert isinstance(hist, pd.DataFrame)


def test_a_long_text_does_not_cut_the_sample(spark):
    rows = [(i, "word " * (400 if i % 4 == 0 else 2), "en", i % 2) for i in range(120)]     # the long ones are clean
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    sample = o4.training_sample(docs, labels, o4.Settings(max_bytes=3000), "doc_id", "toxic")
    short = {r[0] for r in rows if r[3] == 0 and len(r[1]) < 2000 and zlib.crc32(str(r[0]).encode()) % 3 != 1}
    assert set(sample["id"][sample["y"] == 0]) == short
