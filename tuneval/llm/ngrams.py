"""Hashed n-grams of words and characters as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)

# Code points handled at once: a longer text is cut into pieces that overlap
# by n - 1 characters, so every n-gram is seen once and memory stays bounded.
PIECE = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise in place so that every bit depends on all input."""
    h ^= h >> np.uint64(29)
    h *= _Q
    h ^= h >> np.uint64(32)
    return h


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def char_grams(cp: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash per window of n code points."""
    m = len(cp) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    h = cp[:m].astype(np.uint64)
    for j in range(1, n):
        h *= _P
        h += cp[j:j + m]
    return mixed(h)


def pieces(cp: np.ndarray, n: int):
    """Views of at most PIECE + n - 1 code points that share no n-gram."""
    for a in range(0, max(len(cp) - n + 1, 0), PIECE):
        yield cp[a:a + PIECE + n - 1]


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered for a fixed number of words of
    at most KEY_BYTES bytes."""

    LIMIT = 300_000
    KEY_BYTES = 64

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= self.KEY_BYTES:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def word_grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence of word hashes (n = 1: as they are)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = h[:m].copy()
    for j in range(1, n):
        out *= _P
        out += h[j:j + m]
    return mixed(out) if n > 1 else out
