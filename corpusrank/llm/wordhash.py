"""Hashing words and word shingles of whole texts, inside Spark tasks.

Words are runs of characters outside x20 and x09-x0D after lower-casing A-Z,
which is what ``bytes.lower().split()`` gives on UTF-8.
"""

from __future__ import annotations

import hashlib

import numpy as np

U64 = np.uint64
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                    0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=U64)


class WordIds(dict):
    """Word -> 64-bit hash, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        v = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return v


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def shingle_set(text: bytes | None, ids: WordIds, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; a shorter text is one
    shingle of all its words, a text without words has none."""
    ws = text.lower().split() if text else []
    if not ws:
        return np.empty(0, dtype=U64)
    h = np.fromiter(map(ids.__getitem__, ws), dtype=U64, count=len(ws))
    n = len(h)
    if n < k:
        return mix64(np.array([(h * _POWERS[:n]).sum(dtype=U64) + U64(n)], dtype=U64))
    s = h[: n - k + 1] * _POWERS[0]
    for j in range(1, k):
        s = s + h[j: n - k + 1 + j] * _POWERS[j]
    return np.unique(mix64(s))


def signed(x) -> np.ndarray:
    """64-bit values as Spark longs."""
    return np.asarray(x, dtype=U64).view(np.int64)
