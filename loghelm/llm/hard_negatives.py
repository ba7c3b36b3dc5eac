"""Hard negatives by rotated one-bit codes.

A vector of integers is rotated by signs and Walsh-Hadamard transforms that a seed decides, which keeps inner products.
Stored of it are its norm, its code - the signs of the rotated components, a unit vector x - and the alignment a, the
inner product of x and the rotated unit vector. An anchor's rotated unit vector q is cut into bit planes, so popcounts of
a code against the planes estimate t = <x, q>, with the planes' rounding as the error. What is left of the vector beside
a x is orthogonal to x and sqrt(1 - a a) long, so by Cauchy and Schwarz the inner product lies within sqrt(1 - a a)
sqrt(1 - t t) of a t. Only pairs whose interval reaches what is wanted are scored in integers; nothing is missed.

Anchors are taken in blocks of bounded size, each broadcast and searched against all rows: first for positives, then for
the negatives in the band of each positive. Tasks return their best few rows for each anchor, and those are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loghelm.llm.common import Columns, materialize

SEED, PLANES = 11, 6
POSITIVES, NEGATIVES = 5, 3
#: Percent of a positive's score between which a negative's lies.
LOW, HIGH = 50, 95
#: Components of all anchors of a block at most, so a block is up to 64 MB; pairs in one step of a task.
BLOCK_COMPONENTS, STEP_ANCHORS, STEP_ROWS = 4 << 20, 256, 2048
#: What intervals are widened by against rounding, as a part of the norms.
SLACK = 1e-9
_NONE = np.iinfo(np.int64).min


def _rotated(vectors: np.ndarray, seed: int) -> np.ndarray:
    """Rows, whose length is a power of two, turned by three rounds of random signs and a Walsh-Hadamard transform."""
    rng, size = np.random.default_rng(seed), vectors.shape[1]
    out = vectors.astype(np.float64)
    for _ in range(3):
        out *= rng.choice([-1.0, 1.0], size)
        width = 1
        while width < size:
            pairs = out.reshape(len(out), size // (2 * width), 2, width)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), size)
            width *= 2
        out /= np.sqrt(size)
    return out


def _unit(vectors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotated unit vectors (of a zero vector zero) and norms."""
    norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    return _rotated(vectors, seed) / np.maximum(norm, 1e-300)[:, None], norm


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags, a multiple of 64 each, as 64-bit words."""
    return np.packbits(flags, axis=1).view(np.uint64)


def codes_of(vectors: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, alignments and norms of integer vectors with a power of two, 64 at least, of components."""
    unit, norm = _unit(vectors, seed)
    return _bits(unit >= 0), np.minimum(np.abs(unit).sum(axis=1) / np.sqrt(unit.shape[1]), 1.0), norm


class Anchors:
    """Integer vectors of anchors with what estimates need of them: bit planes, their scale, and the rounding left."""

    def __init__(self, vectors: np.ndarray, seed: int = SEED, planes: int = PLANES):
        unit, self.norm = _unit(vectors, seed)
        self.vectors, self.size = vectors, vectors.shape[1]
        self.low = unit.min(axis=1, initial=0)
        self.step = np.maximum((unit.max(axis=1, initial=0) - self.low) / ((1 << planes) - 1), 1e-300)
        level = np.rint((unit - self.low[:, None]) / self.step[:, None]).astype(np.uint8 if planes <= 8 else np.uint16)
        self.planes = [_bits((level >> j) & 1) for j in range(planes)]
        self.total = level.sum(axis=1, dtype=np.int64)
        self.error = np.sqrt(((unit - self.low[:, None] - self.step[:, None] * level) ** 2).sum(axis=1))

    def intervals(self, which: slice, codes: np.ndarray, alignment: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the inner products of anchors and rows."""
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        hits = np.zeros((len(self.total[which]), len(codes)), np.int64)
        for j, plane in enumerate(self.planes):
            shared = np.bitwise_count(plane[which][:, None, :] & codes[None, :, :]).sum(axis=2, dtype=np.int64)
            hits += shared << j
        low, step = self.low[which][:, None], self.step[which][:, None]
        estimate = (low * (2 * ones - self.size)[None, :] + step * (2 * hits - self.total[which][:, None])) / np.sqrt(self.size)
        error = self.error[which][:, None] + SLACK
        least, most = np.clip(estimate - error, -1, 1), np.clip(estimate + error, -1, 1)
        a, rest = alignment[None, :], np.sqrt(1 - alignment**2)[None, :]
        # a t + rest sqrt(1 - t t) is concave in t with its top at t = a; the lower bound is the mirror image.
        t = np.clip(a, least, most)
        upper = a * t + rest * np.sqrt(1 - t * t)
        t = np.clip(-a, least, most)
        lower = a * t - rest * np.sqrt(1 - t * t)
        scale = self.norm[which][:, None] * norm[None, :]
        return (lower - SLACK) * scale - 0.5, (upper + SLACK) * scale + 0.5


class Tops:
    """The best rows of each slot so far: scores and ids, by falling score, then ascending id."""

    def __init__(self, slots: int, k: int):
        self.k, self.scores, self.ids = k, np.full((slots, k), _NONE), np.full((slots, k), np.iinfo(np.int64).max)

    def add(self, slot: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(slot):
            return
        touched = np.unique(slot)
        slot = np.concatenate([np.repeat(touched, self.k), slot])
        ids = np.concatenate([self.ids[touched].ravel(), ids])
        scores = np.concatenate([self.scores[touched].ravel(), scores])
        order = np.lexsort((ids, -scores.astype(np.float64), slot)) if np.abs(scores[scores > _NONE]).max(initial=0) < 1 << 53 else _exact_order(slot, scores, ids)
        slot, ids, scores = slot[order], ids[order], scores[order]
        head = np.searchsorted(slot, touched)
        place = np.arange(len(slot)) - np.repeat(head, np.diff(np.append(head, len(slot))))
        best = place < self.k
        self.scores[slot[best], place[best]], self.ids[slot[best], place[best]] = scores[best], ids[best]


def _exact_order(slot: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    rank = np.unique(scores, return_inverse=True)[1]
    return np.lexsort((ids, -rank, slot))


def indexed(rows: DataFrame, size: int, seed: int = SEED) -> DataFrame:
    """id, label, vector, code, alignment, norm of (id, label, vector); vectors are filled up with zeros to ``size``."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                vectors = _padded(part.column("vector"), size)
                code, alignment, norm = codes_of(vectors, seed)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), part.column("label"), part.column("vector"),
                        pa.array([c.tobytes() for c in code], pa.binary()), pa.array(alignment), pa.array(norm),
                    ], ["id", "label", "vector", "code", "alignment", "norm"],
                )

    return rows.mapInArrow(index, "id long, label long, vector array<long>, code binary, alignment double, norm double")


def _padded(lists: pa.ListArray, size: int) -> np.ndarray:
    ends = lists.offsets.to_numpy()
    lengths, out = np.diff(ends), np.zeros((len(lists), size), np.int64)
    values = lists.flatten().to_numpy()
    out[np.repeat(np.arange(len(lists)), lengths), np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], lengths)] = values
    return out


class Search:
    """What a task needs: anchors with ids and labels, and for the second search the bands of each anchor's positives."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int, seed: int, bands: np.ndarray | None = None):
        self.ids, self.labels, self.anchors, self.k = ids, labels, Anchors(vectors, seed), k
        #: (anchor, slot, 2): scores between which negatives lie; an empty band has its low end above the high one.
        self.bands = bands

    def slots(self) -> int:
        return 1 if self.bands is None else self.bands.shape[1]

    def step(self, tops: Tops, which: slice, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, index: tuple) -> None:
        lower, upper = self.anchors.intervals(which, *index)
        same = self.labels[which][:, None] == labels[None, :]
        n, slots = len(same), self.slots()
        kth = tops.scores[which.start * slots : (which.start + n) * slots, -1].reshape(n, slots).astype(np.float64)
        if self.bands is None:
            wanted = same & (self.ids[which][:, None] != ids[None, :])
            if wanted.shape[1] >= self.k:  # k lower bounds are a bound of the k-th best
                sure = np.partition(np.where(wanted, lower, -np.inf), -self.k, axis=1)[:, -self.k]
                kth[:, 0] = np.maximum(kth[:, 0], np.floor(sure))
            wanted &= upper >= kth
        else:
            wanted = np.zeros_like(same)
            for slot in range(slots):
                low, high = self.bands[which, slot, 0].astype(np.float64), self.bands[which, slot, 1].astype(np.float64)
                wanted |= (upper >= np.maximum(low, kth[:, slot])[:, None]) & (lower <= high[:, None]) & (low <= high)[:, None]
            wanted &= ~same
        anchor, row = np.nonzero(wanted)
        for at in range(0, len(anchor), 1 << 17):  # survivors are scored in integers
            a, r = anchor[at : at + (1 << 17)] + which.start, row[at : at + (1 << 17)]
            scores = np.einsum("ij,ij->i", self.anchors.vectors[a], vectors[r])
            if self.bands is None:
                tops.add(a, ids[r], scores)
                continue
            for slot in range(slots):
                inside = (scores >= self.bands[a, slot, 0]) & (scores <= self.bands[a, slot, 1])
                tops.add(a[inside] * slots + slot, ids[r[inside]], scores[inside])


def _searched(index: DataFrame, search: Search, size: int) -> DataFrame:
    """slot, id, score: each task's best rows of each slot."""
    sent = index.sparkSession.sparkContext.broadcast(search)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job = sent.value
        tops = Tops(len(job.ids) * job.slots(), job.k)
        for batch in batches:
            for at in range(0, len(batch), STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
                vectors = _padded(part.column("vector"), size)
                codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint64).reshape(len(part), -1)
                stored = codes, part.column("alignment").to_numpy(), part.column("norm").to_numpy()
                for first in range(0, len(job.ids), STEP_ANCHORS):
                    job.step(tops, slice(first, first + STEP_ANCHORS), ids, labels, vectors, stored)
        slot, place = np.nonzero(tops.scores > _NONE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(slot.astype(np.int64)), pa.array(tops.ids[slot, place]), pa.array(tops.scores[slot, place])], ["slot", "id", "score"]
        )

    return index.mapInArrow(of, "slot long, id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine_hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, seed: int = SEED
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: id (long), label (long), vector (array of long). is_anchor: which of them are anchors, by a condition on these
    columns. An anchor's positives are its ``positives`` best other rows of the same label; its negatives for a positive the
    ``negatives`` best rows of other labels whose score is ``low`` to ``high`` percent of the positive's, scores being inner
    products and ties going to the smaller id. Rows with a null id, label, vector or component take no part. A shorter
    vector counts as one filled up with zeros, empty ones as zero. Rows with the id of the anchor are no positives of it;
    other rows that repeat take a place each, and an anchor that repeats is searched once for each row. Scores must fit in
    64 bits. Empty tables give no rows.
    """
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")
    longest = rows.agg(F.max(F.size("vector")).alias("n"), F.count(F.when(is_anchor, 1)).alias("anchors")).first()
    size = 1 << max(6, ((longest["n"] or 1) - 1).bit_length())
    index = materialize(indexed(rows.select("id", "label", "vector"), size, seed), "negatives-index")
    blocks = max(1, -(-longest["anchors"] * 2 * size // BLOCK_COMPONENTS))
    anchors = index.where(is_anchor).select("id", "label", "vector")
    if blocks > 1:
        anchors = materialize(anchors.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks))), "negatives-anchors")
    out = None
    for block in range(blocks):
        mined = _mined_block(index, anchors.where(F.col("block") == block) if blocks > 1 else anchors, size, positives, negatives, low, high, seed)
        # With more blocks than one, a block's result is stored before the next is broadcast.
        mined = materialize(mined, "negatives-mined") if blocks > 1 else mined
        out = mined if out is None else out.unionByName(mined)
    return out


def _mined_block(index: DataFrame, anchors: DataFrame, size: int, positives: int, negatives: int, low: int, high: int, seed: int) -> DataFrame:
    spark = index.sparkSession
    table = anchors.select("id", "label", "vector").orderBy("id").toArrow().combine_chunks()
    ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
    lists = table.column("vector").combine_chunks() if len(table) else pa.array([], pa.list_(pa.int64()))
    vectors = _padded(lists, size)

    best = _ranked(_searched(index, Search(ids, labels, vectors, positives, seed), size), positives).select("slot", "rank", "id", "score").toArrow()
    bands = np.empty((len(ids), positives, 2), np.int64)
    bands[..., 0], bands[..., 1] = 1, 0
    slot, place = best.column("slot").to_numpy(), best.column("rank").to_numpy() - 1
    score = best.column("score").to_numpy()
    # low * score <= 100 * negative <= high * score, in whole numbers.
    bands[slot, place, 0], bands[slot, place, 1] = -((-low * score) // 100), (high * score) // 100
    chosen = pa.table({
        "slot": pa.array(slot * positives + place), "anchor_id": pa.array(ids[slot]),
        "positive_id": best.column("id"), "positive_score": best.column("score"),
    })
    pairs = spark.createDataFrame(chosen, "slot long, anchor_id long, positive_id long, positive_score long")
    mined = _ranked(_searched(index, Search(ids, labels, vectors, negatives, seed, bands), size), negatives)
    return mined.join(F.broadcast(pairs), "slot").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op11_hard_negatives(embeddings: DataFrame) -> DataFrame:
    """The contract's labels, integer components and anchors."""
    own = Columns(embeddings)
    finite = F.forall(own["embedding"], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.when(own["vec_id"] % 7 == 0, (own["label"] + 1) % 10).otherwise(own["label"])
    rows = own.frame.where(own["label"].isNotNull() & own["embedding"].isNotNull() & finite).select(
        own["vec_id"].cast("long").alias("id"), label.cast("long").alias("label"),
        F.transform(own["embedding"], lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("vector"),
    )
    return mine_hard_negatives(rows, F.col("id") % 50 == 0)


OP11_SQL = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.id % 50 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id != anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
