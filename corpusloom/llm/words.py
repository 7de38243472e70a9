"""Words and hashed word shingles of whole texts, with numpy, for functions that run in Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """64-bit hash of each word met so far; emptied beyond a bound, so that memory stays small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes, seen: WordHash) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of the text in UTF-8, A-Z lower-cased."""
    words = text.lower().split()
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words, in order; of fewer words (not none), one for all of them."""
    n = len(words)
    size = min(k, n)
    if not n:
        return words
    out = np.full(n - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = out * _MULTIPLIER + words[j : j + n - size + 1]
            out ^= out >> np.uint64(29)
        return mix64(out)
