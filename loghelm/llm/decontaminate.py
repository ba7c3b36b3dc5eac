"""Benchmark decontamination by the q-gram lemma.

Texts are folded: letters and digits in lower case, anything else one space. An item of n characters that occurs with at
most k edits shares n + 1 - q (k + 1) of its q-grams or more with the place, and all on diagonals (place in the text minus
place in the item) at most k apart. So shared q-grams are counted in bands of diagonals twice as wide, each overlapping the
next by half; a band with enough of them is a region, and a banded alignment decides. Nothing with k edits or fewer is
missed. An item too short for ``Q`` gets the largest q that leaves the lemma one q-gram.

Items may share long stems. Items that have a q-gram at the same place are a class, and hits are counted by class, so a
stem costs no more than one item. Of many items in a region those go on that share enough runs of three characters with
it, by the same lemma. They are aligned together, in the order of their text, and rows of
the alignment that belong to a common beginning are computed once; an item goes as soon as its edits exceed its budget.
The benchmark is taken in blocks of bounded size, and each block sees all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.llm.common import Columns, by_bytes, item_blocks
from loghelm.llm.shingles import mix

Q, ERRORS = 10, 0.08
#: Items and characters that one block of the benchmark has at most (an item alone may be longer); it is broadcast.
BLOCK_ITEMS, BLOCK_CHARS = 8192, 4 << 20
SPACE, BORDER = 32, 0x10FFFE
#: Items in one region from which their shorter runs are counted before they are aligned.
MANY_ITEMS = 16
#: Hits that are expanded at once.
STEP_HITS = 1 << 21
#: An alignment that also tells where it begins keeps edits above these bits of one number, and the beginning in them.
_START_BITS = 32
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BITS = 21


@cache
def _folding() -> np.ndarray:
    """Folded code point of each code point."""
    table = np.full(0x110000, SPACE, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalnum():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    table[BORDER] = BORDER
    return table


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points of all texts with a border after each; their places in the joined texts; each text's first
    place in the folded ones, and the end."""
    joined = chr(BORDER).join([*texts, ""])
    codes = _folding()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = codes == SPACE
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    place = np.flatnonzero(keep)
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.concatenate([[0], np.searchsorted(place, ends)]) if len(texts) else np.zeros(1, np.int64)
    return codes[keep], place, first


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of each run of q code points, by doubling."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    power, length, factor = codes.astype(np.uint64) + np.uint64(1), 1, _FACTOR
    out, have = None, 0
    while True:
        if q & length:
            if out is None:
                out, have, out_factor = power, length, factor
            else:
                n = len(codes) - have - length + 1
                out = out[:n] * factor + power[have : have + n]
                have += length
        if 2 * length > q:
            return mix(out[: len(codes) - q + 1])
        n = len(codes) - 2 * length + 1
        power = power[:n] * factor + power[length : length + n]
        length, factor = 2 * length, np.uint64(int(factor) ** 2 % (1 << 64))


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    many = end - begin
    return np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())


def _triples(codes: np.ndarray) -> np.ndarray:
    """A 16-bit hash of each three characters in a row, for rows of at least three."""
    codes = codes.astype(np.uint32) * np.uint32(0x9E3779B1)
    return (((codes[:, :-2] >> 3) ^ (codes[:, 1:-1] >> 9) * np.uint32(0x85EBCA6B) ^ codes[:, 2:] >> 1) * np.uint32(0xC2B2AE35) >> 16).astype(np.uint16)


def _summed(key: np.ndarray, count: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key once, in order, with the sum of its counts and the least and largest of the others."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    if not len(heads):
        return key, count, first, last
    return key[heads], np.add.reduceat(count[order], heads), np.minimum.reduceat(first[order], heads), np.maximum.reduceat(last[order], heads)


class Find(NamedTuple):
    item: int
    edits: int
    begin: int
    end: int


class Stratum:
    """Items with one q and budgets of edits under ``step``: sorted by text, with an index of their q-grams by class."""

    def __init__(self, items: np.ndarray, codes: list[np.ndarray], edits: np.ndarray, q: int, step: int):
        order = sorted(range(len(items)), key=lambda i: codes[i].astype(">u4").tobytes())
        self.q, self.step, self.items, self.edits = q, step, items[order], edits[order]
        codes = [codes[i] for i in order]
        self.lengths = np.array([len(c) for c in codes], np.int64)
        self.chars = np.zeros((len(codes), int(self.lengths.max())), np.uint32)
        for i, own in enumerate(codes):
            self.chars[i, : len(own)] = own
        #: How many characters an item begins with as the one before does.
        differs = self.chars[1:] != self.chars[:-1]
        self.common = np.concatenate([[0], np.where(differs.any(axis=1), differs.argmax(axis=1), self.chars.shape[1])])
        self.least = self.lengths + 1 - q * (self.edits + 1)
        self.triples = _triples(self.chars)

        hashes = [gram_hashes(c, q) for c in codes]
        gram = np.concatenate(hashes)
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        offset = np.concatenate([np.arange(len(h)) for h in hashes])
        order = np.lexsort((item, offset, gram))
        gram, item, offset = gram[order], item[order], offset[order]
        heads = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (offset[1:] != offset[:-1])]))
        many = np.diff(np.append(heads, len(gram)))
        # A class of one item has the item's number, larger ones follow.
        classes, members = item[heads].copy(), [np.arange(len(codes))]
        known: dict[bytes, int] = {}
        for entry in np.flatnonzero(many > 1):
            own = item[heads[entry] : heads[entry] + many[entry]]
            name = known.setdefault(own.tobytes(), len(codes) + len(known))
            if name == len(codes) + len(members) - 1:
                members.append(own)
            classes[entry] = name
        self.members = np.concatenate(members)
        self.member_begin = np.concatenate([np.arange(len(codes)), len(codes) + np.cumsum([0, *map(len, members[1:])])])
        self.classes, self.offset = classes, offset[heads]
        self.grams, self.begin = np.unique(gram[heads], return_index=True)
        self.begin = np.append(self.begin, len(heads))
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self.grams >> np.uint64(64 - _BITS)] = True

    def regions(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
        """(items, first diagonal, end of diagonals) of the hits in all bands with enough shared q-grams, joined where bands
        overlap. Texts lie one after the other in ``codes``; bands that reach over two of them are harmless."""
        hashes = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - _BITS)])
        gram = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        same = self.grams[gram] == hashes[at]
        at, gram = at[same], gram[same]
        if not len(at):
            return
        shift = 2 * self.step + self.chars.shape[1]  # diagonals begin above 0
        ends = len(codes) + 2 * shift
        hits = np.cumsum(self.begin[gram + 1] - self.begin[gram])
        keys, counts, start = [], [], 0
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(hits, (hits[start - 1] if start else 0) + STEP_HITS)))
            begin, end = self.begin[gram[start:stop]], self.begin[gram[start:stop] + 1]
            entry = _ranges(begin, end)
            diagonal = np.repeat(at[start:stop], end - begin) - self.offset[entry] + shift
            key, count = np.unique(self.classes[entry] * ends + diagonal, return_counts=True)
            keys.append(key)
            counts.append(count)
            start = stop
        key, count = np.concatenate(keys), np.concatenate(counts)
        own, diagonal = key // ends, key % ends
        # Each diagonal is in two bands.
        bands = ends // self.step + 1
        band = np.concatenate([diagonal // self.step, diagonal // self.step - 1])
        own, diagonal, count = np.tile(own, 2), np.tile(diagonal, 2), np.tile(count, 2)
        go = np.bincount(band, count, minlength=bands)[band] >= self.least.min()
        (key, count, first, last) = _summed(own[go] * bands + band[go], count[go], diagonal[go], diagonal[go])
        # From classes to items.
        own, band = key // bands, key % bands
        begin, end = self.member_begin[own], self.member_begin[own + 1]
        item = self.members[_ranges(begin, end)]
        key, count, first, last = _summed(item * bands + np.repeat(band, end - begin), *(np.repeat(x, end - begin) for x in (count, first, last)))
        enough = count >= self.least[key // bands]
        item, band, first, last = key[enough] // bands, key[enough] % bands, first[enough], last[enough]
        if not len(item):
            return
        heads = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (band[1:] > band[:-1] + 1)]))
        low, high = np.minimum.reduceat(first, heads) - shift, np.maximum.reduceat(last, heads) - shift
        item, band = item[heads], np.stack([band[heads], band[np.append(heads[1:], len(band)) - 1]])
        order = np.lexsort((item, *band))
        item, band, low, high = item[order], band[:, order], low[order], high[order]
        cuts = np.flatnonzero(np.concatenate([[True], (band[:, 1:] != band[:, :-1]).any(axis=0), [True]]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield item[a:b], int(low[a:b].min()), int(high[a:b].max()) + 1

    def search(self, codes: np.ndarray) -> Iterator[Find]:
        for rows, low, high in self.regions(codes):
            if len(rows) == 1 and (found := self.equal(int(rows[0]), codes, low, high)):
                yield found
                continue
            rows = self.plausible(rows, codes, low, high) if len(rows) >= MANY_ITEMS else rows
            ends = self.aligned(rows, codes, low, high, False) if len(rows) else {}
            if ends:
                for row, (edits, begin, end) in self.aligned(np.array(sorted(ends)), codes, low, high, True).items():
                    yield Find(int(self.items[row]), edits, begin, end)

    def plausible(self, rows: np.ndarray, codes: np.ndarray, low: int, high: int) -> np.ndarray:
        """Those of many items of which the region holds as many runs of three characters as the lemma asks for."""
        most, n = self.step - 1, int(self.lengths[rows].max())
        there = np.zeros(1 << 16, bool)
        there[_triples(codes[max(0, low - most) : max(0, high + most + n + 1)][None, :])] = True
        runs = self.lengths[rows] - 2
        held = there[self.triples[rows, : max(1, n - 2)]]
        held &= np.arange(held.shape[1])[None, :] < runs[:, None]
        return rows[held.sum(axis=1) >= runs - 3 * self.edits[rows]]

    def equal(self, row: int, codes: np.ndarray, low: int, high: int) -> Find | None:
        """The first place in the region that is equal to the item."""
        n = int(self.lengths[row])
        low, high = max(low, 0), min(high, len(codes) - n + 1)
        if low < high:
            for at in np.flatnonzero(codes[low:high] == self.chars[row, 0]) + low:
                if (codes[at : at + n] == self.chars[row, :n]).all():
                    return Find(int(self.items[row]), 0, int(at), int(at) + n)
        return None

    def aligned(self, rows: np.ndarray, codes: np.ndarray, low: int, high: int, starts: bool) -> dict[int, tuple[int, int, int]]:
        """row -> (fewest edits, begin, end) of the items that are in the region within their budget; begin is 0 without
        ``starts``. A state is a beginning that items share; its row of the alignment holds a number for each diagonal."""
        most = self.step - 1
        low, high = low - most, high + most
        width = high - low + 1
        one, kind = (1 << _START_BITS, np.int64) if starts else (1, np.uint8 if most < 100 else np.int32)
        far = kind((most + 1) * one)
        n = int(self.lengths[rows].max())
        inside = codes[max(0, low) : max(0, high + n + 1)]
        text = np.concatenate([np.full(max(0, -low), BORDER, codes.dtype), inside, np.full(width + n, BORDER, codes.dtype)])
        crossed = np.cumsum(text == BORDER)  # an alignment that passes the end of a text passes from one number to the next
        table = (np.arange(width, dtype=kind) if starts else np.zeros(width, kind))[None, :]
        between = np.stack([rows[:-1] + 1, rows[1:] + 1], axis=1).ravel()
        common = np.concatenate([[0], np.minimum.reduceat(np.append(self.common, 0), between)[::2] if len(rows) > 1 else []])
        state = np.zeros(len(rows), np.int64)
        found: dict[int, tuple[int, int, int]] = {}
        for i in range(1, n + 1):
            fresh = common < i
            fresh[0] = True
            heads = np.flatnonzero(fresh)
            before = table[state[heads]]
            here = text[i - 1 : i - 1 + width]
            new = before + (here != self.chars[rows[heads], i - 1][:, None]) * kind(one)
            new[:, here == BORDER] = far
            np.minimum(new[:, :-1], before[:, 1:] + kind(one), out=new[:, :-1])
            step, number = 1, crossed[i - 1 : i - 1 + width]
            while step <= most and step < width:
                cost = np.where(number[step:] == number[:-step], kind(step * one), far)
                new[:, step:] = np.minimum(new[:, step:], new[:, :-step] + cost)
                step *= 2
            table = np.minimum(new, far)
            state = np.cumsum(fresh) - 1
            best = table.min(axis=1)
            budget = (self.edits[rows] + 1) * one
            for j in np.flatnonzero((self.lengths[rows] == i) & (best[state] < budget)):
                value, at = int(best[state[j]]), int(table[state[j]].argmin())
                found[int(rows[j])] = (value // one, low + value % one if starts else 0, low + at + i)
            go = (self.lengths[rows] > i) & (best[state] < budget)
            if not go.any():
                break
            if not go.all():
                # What an item has in common with the last one that is left is the least of what lies between.
                left = np.flatnonzero(go)
                common = np.minimum.reduceat(common[: left[-1] + 1], np.concatenate([[0], left[:-1] + 1]))
                rows, state = rows[left], state[left]
        return found


class Items:
    """A block of the benchmark: folded items in strata of one q and similar budgets, and those that must occur exactly."""

    def __init__(self, ids: list, texts: list[str], q: int = Q, errors: float = ERRORS):
        self.ids, self.codes = [], []
        for item, text in zip(ids, texts, strict=True):
            codes = folded([text])[0][:-1]
            codes = codes[1:] if len(codes) and codes[0] == SPACE else codes
            codes = codes[:-1] if len(codes) and codes[-1] == SPACE else codes
            if len(codes):
                self.ids.append(item)
                self.codes.append(codes)
        lengths = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.floor(errors * lengths + 1e-9).astype(np.int64)
        self.short = [i for i in range(len(lengths)) if lengths[i] < q]
        own = np.minimum(q, lengths // (self.edits + 1))
        step = 1 << np.ceil(np.log2(self.edits + 1)).astype(np.int64)
        self.strata = []
        for pair in sorted({(int(a), int(b)) for a, b, n in zip(own, step, lengths) if n >= q}):
            these = np.flatnonzero((own == pair[0]) & (step == pair[1]) & (lengths >= q))
            self.strata.append(Stratum(these, [self.codes[i] for i in these], self.edits[these], *pair))

    def search(self, texts: list[str]) -> list[list[dict]]:
        """For each text the items in it: item_id, begin, end (code points of the text), edits. Of overlapping finds of
        one item the one with the fewest edits, then the first; where an item overlaps itself again and again one is told."""
        codes, place, first = folded(texts)
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for stratum in self.strata:
            for item, edits, begin, end in stratum.search(codes):
                text = int(np.searchsorted(first, end, side="left")) - 1
                found.setdefault((text, item), []).append((edits, begin, end))
        for item in self.short:
            whole = f" {_string(self.codes[item])} "
            for text in range(len(texts)):
                body = f" {_string(codes[first[text] : first[text + 1] - 1])} "
                at = body.find(whole)
                while at >= 0:
                    begin = int(first[text]) + at
                    found.setdefault((text, item), []).append((0, begin, begin + len(self.codes[item])))
                    at = body.find(whole, at + 1)
        out: list[list[dict]] = [[] for _ in texts]
        for (text, item), finds in sorted(found.items()):
            kept: list[tuple[int, int, int]] = []
            for edits, begin, end in sorted(set(finds)):
                if all(end <= b or begin >= e for _, b, e in kept):
                    kept.append((edits, begin, end))
            for edits, begin, end in sorted(kept, key=lambda f: f[1]):
                out[text].append({
                    "item_id": self.ids[item], "begin": int(place[begin] - offsets[text]),
                    "end": int(place[end - 1] - offsets[text]) + 1, "edits": edits,
                })
        return out


def _string(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _searched(sent: Broadcast, result: str):
    @F.pandas_udf(result)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = by_bytes([batch.rename("text").to_frame()], "text", 2 << 20)
            yield pd.Series([h for part in parts for h in sent.value.search(part["text"].fillna("").tolist())], dtype=object)

    # Else a filter on the result would be pushed below and search every text a second time.
    return hits.asNondeterministic()


def find_benchmark(docs: DataFrame, benchmark: DataFrame, q: int = Q, errors: float = ERRORS, name: str = "hits") -> DataFrame:
    """``docs`` with the array ``name`` of the benchmark items in each text: item_id, begin, end, edits.

    An item of n folded characters may differ in ``errors`` times n edits, rounded down; items under ``q`` characters must
    occur exactly and as whole words. Null and empty texts and items have no hits; repeated items are reported once for
    each row, and an empty benchmark gives empty arrays. A column called ``name`` in any case is replaced, others are
    passed on.
    """
    own, asked = Columns(docs, name), Columns(benchmark)
    items = asked.frame.select(asked["item_id"].alias("item_id"), asked["text"].alias("text"))
    result = f"array<struct<item_id:{items.schema['item_id'].dataType.simpleString()},begin:int,end:int,edits:int>>"
    parts = []
    for block in item_blocks(items, BLOCK_ITEMS, BLOCK_CHARS):
        sent = docs.sparkSession.sparkContext.broadcast(Items([r["item_id"] for r in block], [r["text"] for r in block], q, errors))
        parts.append(_searched(sent, result)(own["text"]))
    return own.restored(own.frame, (F.concat(*parts) if len(parts) > 1 else parts[0]).alias(name))


def decontaminate(docs: DataFrame, benchmark: DataFrame, q: int = Q, errors: float = ERRORS) -> DataFrame:
    """The rows of ``docs`` whose text holds no item of the benchmark, with all their columns.

    Null and empty texts hold none and stay, rows that repeat stay or go together, and an empty benchmark or table leaves
    ``docs`` as it is.
    """
    own = Columns(docs)
    marked = find_benchmark(own.frame.withColumn("text", own["text"]), benchmark, q, errors, "hits")
    return own.restored(marked.where("size(hits) = 0"))


def op2_decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every benchmark item found: doc_id, item_id, begin, end, edits."""
    found = find_benchmark(documents.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")
