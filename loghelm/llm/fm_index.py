"""An FM-index over words: Burrows-Wheeler transform, wavelet matrix of plain packed bit vectors, backward search."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits in 64-bit words with one running count for each word; rank by population count."""

    def __init__(self, bits: np.ndarray):
        size = -(-len(bits) // 64) + 1
        padded = np.zeros(size * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8").astype(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Counts a symbol's occurrences before a place, one bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels, self.zeros = [], []
        for bit in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bits = ((symbols >> bit) & 1).astype(np.uint8)
            self.levels.append((bit, BitVector(bits)))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def ranks(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before ``low`` and before ``high``."""
        start = np.zeros_like(low)
        for (bit, vector), zeros in zip(self.levels, self.zeros, strict=True):
            one = ((symbol >> bit) & 1).astype(bool)
            start, low, high = (np.where(one, zeros + r, at - r) for at, r in ((x, vector.rank(x)) for x in (start, low, high)))
        return low - start, high - start


def sorted_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` words, and whether each shares ``depth`` - 1 of them with the one
    before. By doubling: ranks of the first 1, 2, 4, .. words."""
    n = len(text)

    def ranked(first: np.ndarray, second: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        key = first.astype(np.int64) * (n + 2)
        key[: n - shift] += second[shift:] + 1
        order = np.argsort(key)
        fresh = np.concatenate([[0], np.diff(key[order]) != 0])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        return rank, order

    _, rank = np.unique(text, return_inverse=True)
    ranks, length = {1: rank.astype(np.int64)}, 1
    while 2 * length < depth:
        ranks[2 * length], _ = ranked(ranks[length], ranks[length], length)
        length *= 2

    def of(count: int) -> tuple[np.ndarray, np.ndarray]:
        """Two overlapping stretches of ``length`` words make up ``count``."""
        return ranked(ranks[length], ranks[length], count - length)

    short, _ = of(depth - 1) if depth - 1 > length else (ranks[length], None)
    _, order = of(depth)
    inside = short[order]
    return order, np.concatenate([[False], inside[1:] == inside[:-1]])


class FMIndex:
    """Index of segments (arrays of word numbers from 1, each at least ``window`` long) with a weight each.

    ``weights_of_windows`` streams segments of the index against it from right to left. The match so far is kept at
    ``window`` - 1 words by widening its interval to all suffixes that share them, then a word is added in front by one
    backward step. As every streamed segment is in the index, that always succeeds, and the matching statistic reaches
    ``window`` at each start of a window; what counts is the weight of its interval.
    """

    def __init__(self, segments: list[np.ndarray], weights: np.ndarray, window: int):
        self.window = window
        separator = np.zeros(1, np.int64)
        text = np.concatenate([x for s in segments for x in (s, separator)])
        lengths = np.array([len(s) + 1 for s in segments])
        owner = np.repeat(np.arange(len(segments)), lengths)
        order, same = sorted_suffixes(text, window)
        size = int(text.max()) + 1
        self.wavelet = WaveletMatrix(text[order - 1], size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))]).astype(np.int64)
        self.weight = np.concatenate([[0], np.cumsum(weights[owner[order]])]).astype(np.int64)
        heads = np.flatnonzero(~same)
        run = np.cumsum(~same) - 1
        self.run = run
        self.run_begin, self.run_end = heads, np.append(heads[1:], len(text))
        self.size = len(text)

    def weights_of_windows(self, segments: list[np.ndarray]) -> list[np.ndarray]:
        """For each segment the weight of each of its windows: all occurrences in the index, its own included."""
        lengths = np.array([len(s) for s in segments])
        widest = int(lengths.max())
        # All segments in one matrix, flush right, and one column at a time.
        words = np.zeros((len(segments), widest), np.int64)
        for i, s in enumerate(segments):
            words[i, widest - len(s) :] = s
        out = np.zeros((len(segments), widest), np.int64)
        low, high = np.zeros(len(segments), np.int64), np.full(len(segments), self.size, np.int64)
        for step in range(widest):
            column = widest - 1 - step
            live = np.flatnonzero(lengths > step)
            symbol, a, b = words[live, column], low[live], high[live]
            if step >= self.window:
                a, b = self.run_begin[self.run[a]], self.run_end[self.run[b - 1]]
            before, upto = self.wavelet.ranks(symbol, a, b)
            low[live], high[live] = self.first[symbol] + before, self.first[symbol] + upto
            if step >= self.window - 1:
                out[live, column] = self.weight[high[live]] - self.weight[low[live]]
        return [out[i, widest - n : widest - self.window + 1] for i, n in enumerate(lengths)]
