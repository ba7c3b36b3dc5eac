"""Language-model scores from a log-frequency Bloom filter.

Counts of n-grams are quantised on a logarithmic scale: with base b a count c has the level 1 + floor(log_b c). An n-gram is
put in the filter once for each level up to its own, so its level is found by probing level 1, 2, .. until one is missing.
What a level stands for is the mean of its counts. Errors are one-sided: a level is never found too low, and too high by one
with the filter's rate of false finds. Probabilities are smoothed from the shortest n-gram up, each longer one adding its
count to a prior of ``PRIOR`` counts spread by the shorter one:

    P1(w) = (c(w) + 1) / (N + V + 1),  P(w | context) = (c(context w) + PRIOR P(w | shorter context)) / (c(context) + PRIOR)

Counting and building: tasks count the n-grams of their texts, cut by the leading bits of their hashes into parts. A part
adds up its counts and builds its own small filter, whose size is in proportion to what it holds, so the parts of one size
grow in number with the corpus. Its counts of single tokens are kept exactly besides, for the plain base score.

Scoring: the parts are broadcast in slices of at most ``SLICE_BYTES``. With one slice a single scan probes and scores. With more,
each slice fills in the levels of the n-grams that fall in its parts, which are stored with the rows between two slices.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.llm.common import Columns, materialize, pieces
from loghelm.llm.labelled import remainder
from loghelm.llm.shingles import PLACES, WordHashes, mix

ORDER, BASE, PRIOR = 2, 1.5, 64.0
#: Hash functions of the filter, which then finds 1 in 2^PROBES that isn't there.
PROBES = 6
#: Bytes of text for which there is one part, and bytes of parts that are broadcast at once.
PART_BYTES, SLICE_BYTES = 8 << 20, 256 << 20
#: Tokens that a task counts, and scores, at once (a text alone may have more).
COUNT_TOKENS = 500_000
STEP_TOKENS = 200_000
#: N-grams that are probed at once.
PROBED = 1 << 17
#: Words whose hashes a task keeps.
WORDS_KEPT = 100_000
#: Names of what isn't a word: texts end with one, and begin after the other.
_END, _BEGIN = b"\n", b"\n\n"

#: The least count of each level.
LEVELS = np.unique(np.ceil(BASE ** np.arange(150)).astype(np.float64))
LEVELS = LEVELS[LEVELS < 2**62].astype(np.int64)
#: What a level stands for; none stands for 0.
MEANS = np.concatenate([[0.0], (LEVELS[:-1] + LEVELS[1:] - 1) / 2, LEVELS[-1:]])


def utf8(texts: pa.Array) -> Iterator[bytes]:
    """The texts one by one, as they lie in the batch; no second copy of all of them is made. Null is empty."""
    for text in texts.cast(pa.binary()):
        yield text.as_py() or b""


def token_hashes(text: bytes, hashes: WordHashes, order: int) -> np.ndarray:
    """Hashes of ``order`` begin marks, the words in lower case (A to Z only) and the end. text: in UTF-8."""
    raw = text.lower()
    words = [hashes.of(piece.split()) for piece in pieces(raw)]
    return np.concatenate([hashes.of([_BEGIN] * order), *words, hashes.of([_END])])


def grams_of(tokens: np.ndarray, order: int, longest: int) -> np.ndarray:
    """Hash of the n-gram of ``order`` tokens that ends at the last of ``longest`` begin marks, at each word, and at the end."""
    total = np.zeros(len(tokens) - longest + 1, np.uint64)
    for back in range(order):
        total += tokens[longest - 1 - back : len(tokens) - back] * PLACES[back]
    return mix(total + np.uint64(order))


def count_grams(docs: DataFrame, order: int, bits: int) -> DataFrame:
    """part, n, grams, counts of (text): n-grams of each order with their counts, sorted, by the leading ``bits`` bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(WORDS_KEPT), [[] for _ in range(order)], 0

        def counted() -> pa.RecordBatch:
            rows = []
            for n, parts in enumerate(held, 1):
                grams, counts = np.unique(np.concatenate(parts), return_counts=True)
                cuts = np.searchsorted(grams, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, int)
                for part, (a, b) in enumerate(zip(cuts, np.append(cuts[1:], len(grams)))):
                    if b > a:
                        rows.append((part, n, grams[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()))
            columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["part", "n", "grams", "counts"])

        for batch in batches:
            for text in utf8(batch.column("text")):
                tokens = token_hashes(text, hashes, order)
                for n in range(order):
                    held[n].append(grams_of(tokens, n + 1, order))
                size += len(tokens)
                if size >= COUNT_TOKENS:
                    yield counted()
                    held, size = [[] for _ in range(order)], 0
        if size:
            yield counted()

    return docs.mapInArrow(count, "part int, n int, grams binary, counts binary")


def _summed(grams: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    every, many = np.frombuffer(b"".join(grams), np.uint64), np.frombuffer(b"".join(counts), np.uint32)
    order = np.argsort(every)
    every, many = every[order], many[order]
    heads = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, np.int64)
    return every[heads], np.add.reduceat(many, heads, dtype=np.int64) if len(heads) else np.empty(0, np.int64)


def _places(grams: np.ndarray, level: int, probe: int, size: np.ndarray | int) -> np.ndarray:
    """The bit of a filter of ``size`` bits (under 2^32) that one probe of one level looks at."""
    spread = mix(grams + np.uint64(level * int(PLACES[40]) % (1 << 64)))
    here = (spread + np.uint64(probe) * ((spread >> np.uint64(32)) | np.uint64(1))) & np.uint64(0xFFFFFFFF)
    return ((here * np.asarray(size, np.uint64)) >> np.uint64(32)).astype(np.int64)


def _filter(grams: np.ndarray, counts: np.ndarray, probes: int) -> np.ndarray:
    """The bits, packed, in which each n-gram is put for every level up to that of its count."""
    level = np.searchsorted(LEVELS, counts, side="right")
    size = max(64, int(np.ceil(level.sum() * probes / np.log(2))))
    bits = np.zeros(-(-size // 8) * 8, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        for probe in range(probes):
            bits[_places(grams[level >= j], j, probe, len(bits))] = True
    return np.packbits(bits)


def build_parts(counted: DataFrame, probes: int = PROBES) -> DataFrame:
    """part, words (hashes of single tokens), word_counts (exact, 8 bytes each), filter of each part of the model."""
    begin = grams_of(WordHashes().of([_BEGIN]), 1, 1)[0]

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        single = rows["n"] == 1
        words, counts = _summed(rows["grams"][single].tolist(), rows["counts"][single].tolist())
        longer, many = _summed(rows["grams"][~single].tolist(), rows["counts"][~single].tolist())
        bits = _filter(np.concatenate([words, longer]), np.concatenate([counts, many]), probes)
        real = words != begin
        return pd.DataFrame({
            "part": rows["part"].iloc[:1], "words": [words[real].tobytes()], "word_counts": [counts[real].tobytes()], "filter": [bits.tobytes()],
            "tokens": [int(counts[real].sum())], "distinct": [int(real.sum())],
        })

    return counted.groupBy("part").applyInPandas(
        build, "part int, words binary, word_counts binary, filter binary, tokens long, distinct long"
    )


class Slice:
    """Parts of the model: the sorted hashes of their tokens with counts, and their filters one after the other."""

    def __init__(self, rows: Iterable, bits: int, probes: int):
        """rows: by part. They are appended as they come, so that one of them is held beside the slice."""
        self.bits, self.probes = bits, probes
        self.begin = np.zeros(1 << bits, np.int64)
        self.size = np.zeros(1 << bits, np.int64)  # 0: not in this slice
        words, counts, filters = bytearray(), bytearray(), bytearray()
        for row in rows:
            self.begin[row["part"]], self.size[row["part"]] = len(filters), 8 * len(row["filter"])
            words += row["words"]
            counts += row["word_counts"]
            filters += row["filter"]
        self.words, self.counts = np.frombuffer(words, np.uint64), np.frombuffer(counts, np.int64)
        if self.counts.max(initial=0) < 1 << 32:
            self.counts = self.counts.astype(np.uint32)
        self.filter = np.frombuffer(filters, np.uint8)

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """The level of each n-gram of this slice's parts; 0 where it is not in the filter, or of another slice."""
        found = np.zeros(len(grams), np.uint8)
        for start in range(0, len(grams), PROBED):
            found[start : start + PROBED] = self._probed(grams[start : start + PROBED])
        return found

    def _probed(self, grams: np.ndarray) -> np.ndarray:
        part = (grams >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(grams), np.int64)
        size, begin, found = self.size[part], self.begin[part] * 8, np.zeros(len(grams), np.uint8)
        alive = np.flatnonzero(size)
        level = 0
        while len(alive):
            level += 1
            for probe in range(self.probes):
                bit = begin[alive] + _places(grams[alive], level, probe, size[alive])
                alive = alive[(self.filter[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1]
            found[alive] = level
            if level == len(LEVELS):
                break
        return found

    def exact(self, grams: np.ndarray) -> np.ndarray:
        """The count of each token of this slice's parts, else 0."""
        if not len(self.words):
            return np.zeros(len(grams), np.int64)
        at = np.minimum(np.searchsorted(self.words, grams), len(self.words) - 1)
        return np.where(self.words[at] == grams, self.counts[at], 0)


class Model(NamedTuple):
    """What scores depend on beside the parts."""

    order: int
    tokens: int
    distinct: int
    prior: float

    def floor(self) -> float:
        return self.tokens + self.distinct + 1


def probabilities(levels: list[np.ndarray], model: Model) -> np.ndarray:
    """Of one text: levels of the n-grams of each order at its begin mark and all tokens, to the tokens' probabilities."""
    counts = [MEANS[found] for found in levels]
    p = np.minimum((counts[0][1:] + 1) / model.floor(), 1.0)
    for shorter, longer in zip(counts, counts[1:]):
        context = shorter[:-1]
        p = (np.minimum(longer[1:], context) + model.prior * p) / (context + model.prior)
    return p


_STATE = "struct<levels:binary,n_known:long,base:double,n_tokens:long,score:double>"
_STATE_FIELDS = [
    pa.field("levels", pa.binary()), pa.field("n_known", pa.int64()), pa.field("base", pa.float64()),
    pa.field("n_tokens", pa.int64()), pa.field("score", pa.float64()),
]


def _step(docs: DataFrame, part: Slice, model: Model, state: Column | None, last: bool) -> Column:
    """The state of each text after this slice. Of the last one levels aren't kept."""
    sent = docs.sparkSession.sparkContext.broadcast((part, model))

    def texts(batch: pa.Array, states: pa.Array | None, hashes: WordHashes) -> pa.Array:
        here, known = sent.value
        out, held, size = [], [], 0

        def scored() -> None:
            ends = np.cumsum([0, *(len(t) - known.order + 1 for t, _ in held)])
            levels, single = [], None
            for n in range(1, known.order + 1):
                grams, back = np.unique(np.concatenate([grams_of(t, n, known.order) for t, _ in held]), return_inverse=True)
                single = here.exact(grams)[back] if n == 1 else single
                levels.append(here.levels(grams)[back])
            for i, (_, old) in enumerate(held):
                a, b = ends[i], ends[i + 1]
                own, count = [found[a:b] for found in levels], single[a + 1 : b]
                n_known, base = int((count > 0).sum()), float(np.log10(count + 1.0).sum())
                if old is not None:
                    own = [x + y for x, y in zip(own, np.frombuffer(old["levels"], np.uint8).reshape(known.order, -1))]
                    n_known, base = n_known + old["n_known"], base + old["base"]
                score = float(np.log10(probabilities(own, known)).sum()) if last else 0.0
                out.append((None if last else np.concatenate(own).tobytes(), n_known, base, int(b - a - 1), score))

        for i, text in enumerate(utf8(batch)):
            held.append((token_hashes(text, hashes, known.order), None if states is None else states[i].as_py()))
            size += len(held[-1][0])
            if size >= STEP_TOKENS:
                scored()
                held, size = [], 0
        if held:
            scored()
        columns = zip(*out) if out else [()] * len(_STATE_FIELDS)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _STATE_FIELDS)], fields=_STATE_FIELDS)

    if state is None:

        @F.arrow_udf(_STATE)
        def first(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            hashes = WordHashes(WORDS_KEPT)
            for batch in batches:
                yield texts(batch, None, hashes)

        return first.asNondeterministic()(F.col("text"))

    @F.arrow_udf(_STATE)
    def later(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        hashes = WordHashes(WORDS_KEPT)
        for batch, states in batches:
            yield texts(batch, states, hashes)

    return later.asNondeterministic()(F.col("text"), state)


def language_model_scores(
    docs: DataFrame, learn_from: Column, order: int = ORDER, probes: int = PROBES, prior: float = PRIOR
) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score of each row; no row is dropped.

    Tokens are the words that ASCII blanks separate, A to Z lower-cased, and one end for each text. The model of n-grams
    of up to ``order`` tokens is learnt from the rows for which ``learn_from`` (on doc_id) is true. n_known: tokens that
    occur in those; train_tokens: all of their tokens; base_score: log10 probability of the text by single tokens with one
    added to each count, exact but for tokens that share a 64-bit hash; score: log10 probability by the model. Null and
    empty texts have the end as their only token; rows that repeat count again, and are scored alike. Without rows to learn
    from every token has the probability 1. Columns called like a result are replaced. An empty table stays empty.
    """
    results = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    own = Columns(docs, *results, learnt=learn_from)
    frame = own.frame.select(*own.kept, "learnt", F.coalesce(own["text"], F.lit("")).alias("text"))
    learnt = frame.where("learnt")
    total = learnt.agg(F.sum(F.octet_length("text") + F.lit(1))).first()[0] or 0
    bits = max(0, (-(-total // PART_BYTES) - 1).bit_length())
    counted = count_grams(learnt.select("text"), order, bits)
    parts = materialize(build_parts(counted, probes), "lm-parts")
    sizes = parts.select(
        "part", "tokens", "distinct", (F.octet_length("words") + F.octet_length("word_counts") + F.octet_length("filter")).alias("bytes")
    ).orderBy("part").collect()
    model = Model(order, sum(r["tokens"] for r in sizes), sum(r["distinct"] for r in sizes), prior)

    slices, filled = [[]], 0
    for row in sizes:
        if slices[-1] and filled + row["bytes"] > SLICE_BYTES:
            slices.append([])
            filled = 0
        slices[-1].append(row["part"])
        filled += row["bytes"]
    state = None
    for i, chosen in enumerate(slices):
        rows = parts.where(F.col("part").between(chosen[0], chosen[-1])).orderBy("part") if chosen else parts.limit(0)
        step = _step(frame, Slice(rows.toLocalIterator(), bits, probes), model, state, last=i + 1 == len(slices))
        frame = frame.withColumn("state", step)
        if i + 1 < len(slices):
            frame, state = materialize(frame, "lm-levels"), F.col("state")
    plain = F.col("state.base") - F.col("state.n_tokens") * F.lit(float(np.log10(model.floor())))
    return own.restored(
        frame, F.col("state.n_tokens").alias("n_tokens"), F.col("state.n_known").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        plain.alias("base_score"), F.col("state.score").alias("score"),
    )


def op12_language_model(documents: DataFrame) -> DataFrame:
    held_out = F.coalesce(remainder(7) == 2, F.lit(False))
    out = language_model_scores(documents.select("doc_id", "text"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
