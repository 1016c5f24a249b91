"""Word shingles and MinHash values of one text; small helpers for tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words in a shingle.
WORDS = 5
CACHE_ENTRIES = 150_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class _Words(dict):
    """64-bit hashes of words, kept for the words of late."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


_WORDS = _Words()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text: lower case, divided by white space."""
    words = text.lower().split() if text else []
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """One hash per run of ``size`` words, in order; none if there are fewer words."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for j in range(size):
        total += mixed(words[j:j + n] + np.uint64(j)) * _FACTORS[j]
    return mixed(total)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles; a text of fewer words than a shingle has one, of all its words."""
    return np.unique(shingle_hashes(words, min(WORDS, len(words)))) if len(words) else np.zeros(0, np.uint64)


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64)


class MinHash:
    """``n`` MinHash values of 32 bits from multiply-shift functions."""

    def __init__(self, n: int, seed: int = 11):
        self.factors = (_random(n, seed) << np.uint64(1) | np.uint64(1))[:, None]
        self.terms = _random(n, seed + 1)[:, None]

    def values(self, shingles: np.ndarray, block: int = 2048) -> np.ndarray:
        """Smallest value of each function; all ones for an empty set."""
        out = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(shingles), block):
            part = shingles[at:at + block] * self.factors + self.terms
            np.minimum(out, (part.min(axis=1) >> np.uint64(32)).astype(np.uint32), out=out)
        return out
