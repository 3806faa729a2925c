"""Operator 12 against the tokenizer library, and its exact round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from corpusrank.llm import op12_bpe as M

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocab():
    return M.vocabulary(public_tokenizers.path(M.VOCABULARY))


@pytest.fixture(scope="module")
def library(vocab):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def same(texts, vocab, library):
    ids, ends, n = M.encode_texts(texts, vocab)
    at = 0
    for t, k in zip(texts, n):
        assert ids[at: at + k].tolist() == library.encode_ordinary(t), t[:80]
        assert M.decode_tokens(ids[at: at + k], ends[at: at + k], vocab) == t.encode()
        at += k
    assert at == len(ids)


def random_texts(n, seed):
    rng = random.Random(seed)
    letters = "'srtvemdlxLL  \n\t 9٣é#._漢😀　"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_random_texts(vocab, library):
    same(random_texts(5000, 1), vocab, library)


def test_scan_in_small_parts(vocab, library, monkeypatch):
    """State and look-ahead pass from part to part."""
    monkeypatch.setattr(M, "PART", 7)
    monkeypatch.setattr(M, "WIDTH", 3)
    same(random_texts(200, 2), vocab, library)


def test_very_long_slices(vocab, library):
    same(["a" * 5000, "ab" * 3000 + "'ll", "x" * 60_000, " " * 1000, "'" * 300 + "s", "漢" * 2000, ""], vocab, library)


def test_cache_may_overflow(vocab, library, monkeypatch):
    monkeypatch.setattr(M, "CACHE", 5)
    same(["one two three four five six seven eight nine ten"] * 3, vocab, library)


def test_every_code_point(vocab, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same(["".join(points[i: i + 5000]) for i in range(0, len(points), 50_000)], vocab, library)
    same([f"a{c} 1{c}#{c} {c}'s" for c in points[:3000]], vocab, library)


def test_transitions_are_associative():
    element, times, apply, one = M.monoid()
    x, y, z = np.random.default_rng(0).choice(element, size=(3, 500))
    assert (times[times[x, y], z] == times[x, times[y, z]]).all() and (times[one, x] == x).all()
    s = np.arange(500) % M.N_STATES
    assert (apply[times[x, y], s] == apply[y, apply[x, s]]).all()


def test_any_run_of_tokens_decodes_alone(vocab):
    text = "Ein größeres Stück 漢字 text, 123 don't"
    ids, ends, _ = M.encode_texts([text], vocab)
    for i in range(len(ids)):
        for j in range(i, len(ids) + 1):
            first = int(ends[i - 1]) if i else 0
            last = int(ends[j - 1]) if j > i else first
            assert M.decode_tokens(ids[i:j], ends[i:j], vocab) == text.encode()[first:last]


def test_digests(spark, edge, empty, library):
    for df in (edge, spark.read.parquet(f"{SF}/documents.parquet")):
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = library.encode_ordinary(r.text or "")
            want.append((str(r.doc_id), len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                         hashlib.sha256((r.text or "").encode()).hexdigest()))
        got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in M.digests(df).collect()]
        assert sorted(got) == sorted(want)
    assert M.digests(empty).collect() == []
