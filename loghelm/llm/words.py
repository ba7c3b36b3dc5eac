"""Distinct words of a stretch of text as rows of a table, so that what depends on a word alone is computed once."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from zlib import crc32

import numpy as np

#: Words that a table holds before it starts anew.
TABLE_WORDS = 400_000

EDGES = " \t\r\n.,;:!?\"'()[]{}|*&%$#<>-"

# Frequent function words by language, for telling languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on are be this by at from or an have not but which".split(),
    "de": "der die und den von das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus".split(),
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


class WordTable(dict):
    """Maps a word to its row; ``features`` gives the ``width`` hash buckets of a word."""

    def __init__(self, features: Callable[[str], tuple[int, ...]], width: int):
        super().__init__()
        self.features, self.width, self.buckets, self.fresh = features, width, array("i"), 0

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.buckets.extend(self.features(word))
        return row

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def new_rows(self) -> np.ndarray:
        """Rows added since the last call."""
        rows = np.array(self.buckets[self.fresh * self.width :], dtype=np.int32).reshape(-1, self.width)
        self.fresh = len(self)
        return rows

    def full(self) -> bool:
        return len(self) > TABLE_WORDS


#: Bucket counts are powers of two; a bucket is a CRC with these low bits.
BUCKETS = 1 << 16
_LOW = BUCKETS - 1


def affixes(word: str) -> tuple[int, ...]:
    """Buckets of the bare lower-case word, its first three, four, five and six bytes, and its last four and five.

    For a shorter word some of these are the word itself."""
    raw = word.strip(EDGES).lower().encode("utf-8", "surrogatepass")
    return (
        crc32(raw) & _LOW, crc32(raw[:3], 1) & _LOW, crc32(raw[:4], 1) & _LOW, crc32(raw[:5], 1) & _LOW, crc32(raw[:6], 1) & _LOW,
        crc32(raw[-4:], 2) & _LOW, crc32(raw[-5:], 2) & _LOW,
    )


_RUNS = (
    (re.compile(r"[^\W\d_]+", re.U), lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "Aa" if m[0][0].isupper() else "a"),
    (re.compile(r"\d+"), lambda m: "9"),
)


def shape(word: str) -> str:
    """Letters as A, Aa or a, digits as 9, other characters as they are, runs of one character cut to three."""
    if word.isalpha():
        return "A" if len(word) > 1 and word.isupper() else "Aa" if word[0].isupper() else "a"
    out = re.sub(r"[^\W\d_]+|\d+", lambda m: "9" if m[0][0].isdigit() else _RUNS[0][1](m), word)
    return re.sub(r"(.)\1{2,}", r"\1\1\1", out)[:24]


def shapes(word: str) -> tuple[int, ...]:
    """Buckets of a word's shape, of what follows its letters, of its length class, and of the lower-case word."""
    bare = word.rstrip(EDGES)
    raw = word.lower().encode("utf-8", "surrogatepass")
    return (
        crc32(shape(word).encode("utf-8", "surrogatepass"), 3) & _LOW, crc32(word[len(bare):][:4].encode(), 4) & _LOW,
        crc32(b"%d" % (min(len(word), 40) // 4), 5) & _LOW, crc32(raw) & _LOW,
    )


def languages(texts_words: list[list[str]]) -> np.ndarray:
    """The index in LANGUAGES of the language whose function words a text has most of; "other" if it has none."""
    lists = [frozenset(FUNCTION_WORDS[name]) for name in FUNCTION_WORDS]
    union = frozenset().union(*lists)
    out = np.full(len(texts_words), len(LANGUAGES) - 1)
    for i, words in enumerate(texts_words):
        hits = [w for w in words if w in union]
        if hits:
            out[i] = int(np.argmax([sum(w in known for w in hits) for known in lists]))
    return out
