"""Quality: attention-based multiple-instance learning over the passages of a document, trained in numpy.

A document is a bag of passages of ``PASSAGE`` words. A passage is encoded from the mean of its words' hashed vectors
(shape, what follows the letters, length, the word) and a few measures of its own. Gated attention learned from document
labels weighs the passages, and the weighted mean of their encodings is scored. All passages of the whole text count.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.llm.labelled import labelled_sample, remainder, score_texts
from loghelm.llm.words import BUCKETS, WordTable, shapes

#: Labelled rows of either label that training takes at most.
PER_CLASS = 3000
PASSAGE, DIMENSIONS, ENCODED, GATES, FEATURES, MEASURES = 48, 12, 16, 8, 4, 6


def word_measures(word: str) -> tuple[float, float, float]:
    """Share of letters, share of capitals, and the length over 10."""
    n = len(word)
    letters = sum(map(str.isalpha, word))
    return letters / n, sum(map(str.isupper, word)) / n, min(n, 60) / 10


class Passages:
    """Cuts texts into passages and describes them; the table of known words is kept between calls."""

    def __init__(self):
        self.table = WordTable(shapes, FEATURES)
        self.buckets, self.measures = np.empty((0, FEATURES), np.int32), np.empty((0, 3), np.float32)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all words, and the number of words of each text."""
        if self.table.full():
            self.__init__()
        known = len(self.table)
        ids = [self.table.ids(text.split()) for text in texts]
        fresh = self.table.new_rows()
        if len(fresh):
            new = list(self.table)[known:]
            self.buckets = np.concatenate([self.buckets, fresh])
            self.measures = np.concatenate([self.measures, np.array([word_measures(w) for w in new], np.float32)])
        lengths = np.array([len(i) for i in ids], np.int64)
        return (np.concatenate(ids) if ids else np.empty(0, np.int32)), lengths

    def cut(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the passages, and for each text how many it has. An empty text has none."""
        counts = -(-lengths // PASSAGE)
        first = np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), counts)
        inside = np.arange(counts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        return (first + inside * PASSAGE).astype(np.int64), counts

    def describe(self, ids: np.ndarray, starts: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Mean word vector and measures of each passage. vectors: of the table's words."""
        if not len(starts):
            return np.empty((0, vectors.shape[1] + MEASURES), np.float32)
        size = np.diff(np.append(starts, len(ids))).astype(np.float32)
        mean = np.add.reduceat(vectors[ids], starts, axis=0) / size[:, None]
        measures = np.add.reduceat(self.measures[ids], starts, axis=0) / size[:, None]
        same = np.zeros(len(ids), np.float32)
        same[1:] = ids[1:] == ids[:-1]
        same[starts] = 0
        passage = np.repeat(np.arange(len(starts)), size.astype(np.int64))
        order = np.lexsort((ids, passage))
        distinct = np.zeros(len(ids), np.float32)
        distinct[order] = np.concatenate([[1], (np.diff(ids[order]) != 0) | (np.diff(passage[order]) != 0)])
        repeated = np.add.reduceat(same, starts) / size
        return np.concatenate([
            mean, measures, repeated[:, None], (np.add.reduceat(distinct, starts) / size)[:, None], np.log1p(size)[:, None] / 4
        ], axis=1, dtype=np.float32)


class AttentionNet:
    """Encoder tanh(x W + b); attention softmax over passages of u . (tanh(h V) * sigmoid(h G)); score of the mean."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        normal = lambda *size: rng.standard_normal(size).astype(np.float32)
        inputs = DIMENSIONS + MEASURES
        self.p = {
            "E": normal(BUCKETS, DIMENSIONS) * 0.3, "W": normal(inputs, ENCODED) * 0.4, "b": np.zeros(ENCODED, np.float32),
            "V": normal(ENCODED, GATES) * 0.4, "G": normal(ENCODED, GATES) * 0.4, "u": normal(GATES) * 0.4,
            "c": normal(ENCODED) * 0.4, "o": np.zeros(1, np.float32), "n": np.zeros(1, np.float32),
        }

    def vectors(self, buckets: np.ndarray) -> np.ndarray:
        out = np.zeros((len(buckets), DIMENSIONS), np.float32)
        for column in buckets.T:
            out += self.p["E"][column]
        return out

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p, bags = self.p, np.flatnonzero(counts)
        starts = np.concatenate([[0], np.cumsum(counts[bags])[:-1]]).astype(np.int64)
        bag = np.repeat(np.arange(len(bags)), counts[bags])
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["G"]))
        e = (t * g) @ p["u"]
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag]) if len(bags) else e
        a = a / np.add.reduceat(a, starts)[bag] if len(bags) else a
        z = np.add.reduceat(a[:, None] * h, starts, axis=0) if len(bags) else np.empty((0, ENCODED), np.float32)
        logits = np.full(len(counts), p["n"][0], np.float32)  # of a bag without passages
        logits[bags] = z @ p["c"] + p["o"][0]
        return {"bags": bags, "starts": starts, "bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "logits": logits}

    def gradients(self, x: np.ndarray, f: dict[str, np.ndarray], error: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the loss, whose derivative by each logit is ``error``; the second is that by x."""
        p, mine = self.p, error[f["bags"]]
        dz = mine[:, None] * p["c"]
        dh = f["a"][:, None] * dz[f["bag"]]
        da = (f["h"] * dz[f["bag"]]).sum(axis=1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["starts"])[f["bag"]])
        dt, dg = de[:, None] * p["u"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["u"] * f["t"] * f["g"] * (1 - f["g"])
        dh = dh + dt @ p["V"].T + dg @ p["G"].T
        dw = dh * (1 - f["h"] ** 2)
        empty = np.ones(len(error), bool)
        empty[f["bags"]] = False
        return {
            "W": x.T @ dw, "b": dw.sum(axis=0), "V": f["h"].T @ dt, "G": f["h"].T @ dg, "u": (f["t"] * f["g"]).T @ de,
            "c": f["z"].T @ mine, "o": mine.sum(keepdims=True), "n": error[empty].sum(keepdims=True),
        }, dw @ p["W"].T


class Scorer:
    """Scores texts with a trained net."""

    def __init__(self, net: AttentionNet, shift: float = 0.0):
        self.net, self.shift, self.passages, self.vectors = net, shift, None, None

    def __getstate__(self):
        return {"net": self.net, "shift": self.shift, "passages": None, "vectors": None}

    def logits(self, texts: list[str]) -> np.ndarray:
        if self.passages is None:
            self.passages, self.vectors = Passages(), np.empty((0, DIMENSIONS), np.float32)
        ids, lengths = self.passages.words(texts)
        have = len(self.vectors) if len(self.vectors) <= len(self.passages.buckets) and not self._renewed() else 0
        self.vectors = np.concatenate([self.vectors[:have], self.net.vectors(self.passages.buckets[have:])])
        starts, counts = self.passages.cut(lengths)
        return self.net.forward(self.passages.describe(ids, starts, self.vectors), counts)["logits"]

    def _renewed(self) -> bool:
        """Whether the table of words began anew in the last call."""
        renewed = getattr(self, "seen", None) is not self.passages.table
        self.seen = self.passages.table
        return renewed

    def __call__(self, texts: list[str]) -> np.ndarray:
        return (1 / (1 + np.exp(-np.clip(self.logits(texts) - self.shift, -30, 30)))).astype(np.float64)


def train(
    texts: list[str], labels: np.ndarray, part: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.05, seed: int = 3
) -> Scorer:
    """Fit by Adagrad on the rows with ``part`` of 0.2 and more; the cut for 0.5 is set on the others.

    With no rows, or rows of one label only, every text gets that label.
    """
    net = AttentionNet(seed)
    if len(labels) == 0 or labels.min() == labels.max():
        constant = 0.0 if len(labels) == 0 else 4.0 if labels[0] else -4.0
        net.p["c"][:], net.p["o"][:], net.p["n"][:] = 0, constant, constant
        return Scorer(net)
    passages = Passages()
    ids, lengths = passages.words(texts)
    pieces = np.split(ids, np.cumsum(lengths)[:-1])
    learn = np.flatnonzero(part >= 0.2)
    if len(learn) < 2 or labels[learn].min() == labels[learn].max():
        learn = np.arange(len(labels))
    share = float(labels[learn].mean())
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    memory = {n: np.full_like(v, 1e-2) for n, v in net.p.items()}

    def step(name: str, gradient: np.ndarray, at=slice(None)) -> None:
        memory[name][at] += gradient * gradient
        net.p[name][at] -= rate * gradient / np.sqrt(memory[name][at])

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(learn)
        for begin in range(0, len(order), batch):
            chosen = order[begin : begin + batch]
            ids = np.concatenate([pieces[i] for i in chosen])
            starts, counts = passages.cut(np.array([len(pieces[i]) for i in chosen], np.int64))
            distinct, local = np.unique(ids, return_inverse=True)
            buckets = passages.buckets[distinct]
            described = _describe(passages, distinct, local, starts, net.vectors(buckets))
            f = net.forward(described, counts)
            error = (1 / (1 + np.exp(-np.clip(f["logits"], -30, 30))) - labels[chosen]) * weight[chosen] / len(chosen)
            gradients, back = net.gradients(described, f, error.astype(np.float32))
            for name, gradient in gradients.items():
                step(name, gradient)
            size = np.diff(np.append(starts, len(ids)))
            per_word = np.repeat(back[:, :DIMENSIONS] / size[:, None], size, axis=0)
            by_word = np.stack([np.bincount(local, per_word[:, d], len(distinct)) for d in range(DIMENSIONS)], 1)
            at, inverse = np.unique(buckets.ravel(), return_inverse=True)
            repeated = np.repeat(by_word, FEATURES, axis=0)
            summed = np.stack([np.bincount(inverse.ravel(), repeated[:, d], len(at)) for d in range(DIMENSIONS)], 1)
            step("E", summed.astype(np.float32), at)
    held = part < 0.2
    if held.sum() < 2 or labels[held].min() == labels[held].max():
        held = np.ones(len(labels), bool)
    scorer = Scorer(net)
    logits = scorer.logits([t for t, h in zip(texts, held, strict=True) if h])
    scorer.shift = _cut(logits, labels[held])
    return scorer


def _describe(passages: Passages, distinct: np.ndarray, local: np.ndarray, starts: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    view = Passages.__new__(Passages)
    view.measures = passages.measures[distinct]
    return view.describe(local, starts, vectors)


def _cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the best mean of both labels' recalls; of the best ones the middle."""
    order = np.argsort(logits, kind="stable")
    low = np.cumsum(labels[order] == 0) / max(1, (labels == 0).sum())
    high = 1 - np.cumsum(labels[order] == 1) / max(1, (labels == 1).sum())
    value = low + high
    best = np.flatnonzero(value >= value.max() - 1e-9)
    at = int(best[len(best) // 2])
    above = logits[order[at + 1]] if at + 1 < len(order) else logits[order[at]] + 1
    return float((logits[order[at]] + above) / 2)


def quality_scores(docs: DataFrame, texts: list[str], labels: np.ndarray, part: np.ndarray, name: str = "score") -> DataFrame:
    """``docs`` with a quality score from 0 to 1 for each whole text, by a net fitted to the given labelled texts.

    A null text counts as empty, and empty texts share one score that is learned as well. Rows with equal texts get equal
    scores. A column called ``name`` is replaced; an empty table stays empty.
    """
    return score_texts(docs, train(texts, labels, part), name)


#: Remainder of crc32(doc_id) by 3 that training leaves out.
HELD_OUT = 1


def fitted_scores(documents: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    sample = labelled_sample(documents, labels, "quality", remainder(3) != HELD_OUT, PER_CLASS)
    return quality_scores(documents, *sample, name=name)


def op8_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = fitted_scores(documents.select("doc_id", "text"), labels)
    return scored.select(
        "doc_id", F.coalesce(remainder(3) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
