"""Hashed word n-grams of texts, in numpy."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

#: Odd multipliers of the words of an n-gram, by place, from a fixed seed.
PLACES = np.random.default_rng(20).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
WORDS_KEPT = 400_000


class WordHashes(dict):
    """Maps a word (text or UTF-8 bytes) to a 64-bit hash of it; starts anew when it holds ``kept`` words."""

    def __init__(self, kept: int = WORDS_KEPT):
        super().__init__()
        self.kept = kept

    def __missing__(self, word: str | bytes) -> int:
        raw = word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass")
        found = self[word] = xxh3_64_intdigest(raw)
        return found

    def of(self, words: list[str] | list[bytes]) -> np.ndarray:
        if len(self) > self.kept:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n word hashes. Fewer than n words are one n-gram, no words none."""
    if len(words) == 0:
        return np.empty(0, np.uint64)
    n = min(n, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * PLACES[k]
    return mix(total + np.uint64(n))
