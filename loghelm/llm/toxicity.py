"""Toxicity: a convolutional classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of the vectors of its hash buckets (the word, its beginnings and endings). Filters of several
widths slide over the words; of each filter the largest response in the text counts, and a dense layer weighs these. As a
filter is linear before the maximum, its part for each distinct word is computed once and the parts of neighbours added.
The logit is moved and scaled by language, on rows that training doesn't see, so that 0.5 separates best in each; the
language is told from function words in the text.

Training takes all labelled rows: they are dealt to shards of bounded size, a task fits a net to each shard from a common
start (log odds of all rows), and the nets are averaged. The thresholds come from counts of all rows kept from training.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.llm.common import by_bytes, materialize
from loghelm.llm.labelled import labelled_texts, part_of, remainder, score_texts
from loghelm.llm.words import BUCKETS, LANGUAGES, WordTable, affixes, languages

#: Rows and words of a shard, on average: what one task fits a net to, and holds.
SHARD_ROWS, SHARD_WORDS = 4096, 4_000_000
#: Passes over the rows: of one shard alone, and of each of several.
EPOCHS, SHARED_EPOCHS = 6, 3
#: Buckets of a piece of a net, and steps of a logit between which thresholds lie.
PIECE, STEPS = 1024, 256
DIMENSIONS, WIDTHS, FILTERS, AFFIXES = 16, (1, 2, 3), 12, 7
#: Rows of a language and label that its own threshold needs; with fewer the common one holds.
LEAST_ROWS = 8


@dataclass
class ConvolutionalNet:
    embedding: np.ndarray
    filters: np.ndarray  # (dimensions, parts * FILTERS); a filter of width n has n parts
    bias: np.ndarray
    dense: np.ndarray
    offset: float
    shift: np.ndarray
    scale: float

    @classmethod
    def new(cls, seed: int) -> ConvolutionalNet:
        rng = np.random.default_rng(seed)
        normal = lambda *size: rng.standard_normal(size).astype(np.float32)
        parts = sum(WIDTHS)
        return cls(
            normal(BUCKETS, DIMENSIONS) * 0.02, normal(DIMENSIONS, parts * FILTERS) * 0.3,
            np.zeros(len(WIDTHS) * FILTERS, np.float32), np.abs(normal(len(WIDTHS) * FILTERS)) * 0.1, 0.0,
            np.zeros(len(LANGUAGES)), 1.0,
        )

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), DIMENSIONS), np.float32)
        for column in rows.T:
            out += self.embedding[column]
        return out

    def responses(self, parts: np.ndarray, ids: np.ndarray, lengths: np.ndarray, where: bool = False):
        """The largest response of every filter in every text; with ``where`` also the place. Texts shorter than a
        filter, and empty ones, get 0, as ReLU gives for no response."""
        texts = len(lengths)
        best = np.zeros((texts, len(WIDTHS) * FILTERS), np.float32)
        place = np.full((texts, len(WIDTHS) * FILTERS), -1, np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        part = 0
        for n, width in enumerate(WIDTHS):
            out = slice(n * FILTERS, (n + 1) * FILTERS)
            if len(ids) >= width:
                stop = len(ids) - width + 1
                total = parts[ids[:stop], part * FILTERS : (part + 1) * FILTERS]
                for k in range(1, width):
                    total = total + parts[ids[k : stop + k], (part + k) * FILTERS : (part + k + 1) * FILTERS]
                for i in np.flatnonzero(lengths >= width) if where else ():
                    inside = total[starts[i] : starts[i] + lengths[i] - width + 1]
                    top = inside.argmax(axis=0)
                    best[i, out], place[i, out] = inside[top, np.arange(FILTERS)], starts[i] + top
                if not where:
                    long = np.flatnonzero(lengths >= width)
                    if len(long):
                        # Stretches of windows inside a text alternate with windows across two texts, which are ignored.
                        edges = np.stack([starts[long], starts[long] + lengths[long] - width + 1], 1).ravel()
                        edges = edges[:-1] if edges[-1] >= stop else edges
                        best[long, out] = np.maximum.reduceat(total, edges, axis=0)[::2]
            part += width
        raw = best + self.bias
        missing = lengths[:, None] < np.repeat(WIDTHS, FILTERS)[None, :]
        raw[missing] = 0
        return (np.maximum(raw, 0), raw, place) if where else np.maximum(raw, 0)

    def logits(self, responses: np.ndarray) -> np.ndarray:
        return responses @ self.dense + self.offset


class Scorer:
    """Scores texts with a trained net; the table of known words is kept between calls and started anew when full."""

    def __init__(self, net: ConvolutionalNet):
        self.net, self.table, self.parts = net, None, None

    def __getstate__(self):
        return {"net": self.net, "table": None, "parts": None}

    def raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.table is None or self.table.full():
            self.table, self.parts = WordTable(affixes, AFFIXES), np.empty((0, sum(WIDTHS) * FILTERS), np.float32)
        words = [text.split() for text in texts]
        ids = [self.table.ids(w) for w in words]
        fresh = self.table.new_rows()
        if len(fresh):
            self.parts = np.concatenate([self.parts, self.net.vectors(fresh) @ self.net.filters])
        lengths = np.array([len(w) for w in words], np.int64)
        out = self.net.logits(self.net.responses(self.parts, np.concatenate(ids) if ids else np.empty(0, np.int32), lengths))
        return out, languages(words)

    def __call__(self, texts: list[str]) -> np.ndarray:
        logits, language = self.raw(texts)
        return 1 / (1 + np.exp(-np.clip(self.net.scale * (logits - self.net.shift[language]), -30, 30))).astype(np.float64)


def begin_from_odds(net: ConvolutionalNet, ids: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, learn: np.ndarray) -> None:
    """Start the first dimension of the embedding, which all filters read, from how much likelier a bucket is in texts
    with label 1: their smoothed log odds. The other dimensions start from small random numbers."""
    seen = np.zeros((2, BUCKETS))
    for i in learn:
        seen[int(labels[i]), np.unique(rows[np.unique(ids[i])])] += 1
    begin_from_counts(net, seen, np.array([(labels[learn] == 0).sum(), labels[learn].sum()]))


def begin_from_counts(net: ConvolutionalNet, seen: np.ndarray, texts: np.ndarray) -> None:
    """seen: for either label, how many texts have each bucket; texts: how many there are."""
    odds = np.log((seen[1] + 0.5) / (texts[1] + 1)) - np.log((seen[0] + 0.5) / (texts[0] + 1))
    net.embedding[:, 0] = odds * (1 - np.exp(-seen.sum(axis=0) / 4)) / AFFIXES
    net.filters[0] = np.abs(net.filters[0]) + 0.5


def train(
    texts: list[str], labels: np.ndarray, part: np.ndarray, epochs: int = EPOCHS, batch: int = 48, rate: float = 0.02, seed: int = 11,
    weights: tuple[float, float] = (1.0, 1.0),
) -> ConvolutionalNet:
    """Fit by Adagrad on the rows with ``part`` of 0.2 and more; the others set the thresholds. ``weights``: how many rows
    one with label 0, and one with label 1, stands for there; fitting balances the labels anyway.

    With no rows, or rows of one label only, every text gets that label's share as its score.
    """
    net = ConvolutionalNet.new(seed)
    if len(labels) == 0 or labels.min() == labels.max():
        net.dense[:] = 0
        net.offset = 0.0 if len(labels) == 0 else 4.0 if labels[0] else -4.0
        return net
    table = WordTable(affixes, AFFIXES)
    ids = [table.ids(text.split()) for text in texts]
    rows = table.new_rows()
    learn = np.flatnonzero(part >= 0.2)
    if len(learn) < 2 or labels[learn].min() == labels[learn].max():
        learn = np.arange(len(labels))
    begin_from_odds(net, ids, rows, labels, learn)
    descend(net, ids, rows, labels, learn, float(labels[learn].mean()), epochs, batch, rate, seed)
    return calibrate(net, texts, labels, part, weights)


def descend(
    net: ConvolutionalNet, ids: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, learn: np.ndarray, share: float, epochs: int,
    batch: int = 48, rate: float = 0.02, seed: int = 11,
) -> np.ndarray:
    """Adagrad from ``net`` on the texts ``learn``, whose words are ``ids`` of ``rows``, buckets of words. share: of label 1
    in all rows; the labels are balanced by it. Returns which buckets have moved."""
    rng = np.random.default_rng(seed)
    weight = np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)).astype(np.float32)
    memory = {n: np.full_like(getattr(net, n), 1e-2) for n in ("embedding", "filters", "bias", "dense")}
    memory_offset = 1e-2

    def step(name: str, gradient: np.ndarray, at=slice(None)) -> None:
        memory[name][at] += gradient * gradient
        getattr(net, name)[at] -= rate * gradient / np.sqrt(memory[name][at])

    offsets = np.concatenate([[0], np.cumsum(WIDTHS)[:-1]])
    for _ in range(epochs):
        order = rng.permutation(learn)
        for begin in range(0, len(order), batch):
            chosen = order[begin : begin + batch]
            lengths = np.array([len(ids[i]) for i in chosen], np.int64)
            flat = np.concatenate([ids[i] for i in chosen])
            distinct, local = np.unique(flat, return_inverse=True)
            vectors = net.vectors(rows[distinct])
            out, raw, place = net.responses(vectors @ net.filters, local, lengths, where=True)
            error = (1 / (1 + np.exp(-np.clip(net.logits(out), -30, 30))) - labels[chosen]) * weight[chosen] / len(chosen)
            error = error.astype(np.float32)
            back = error[:, None] * net.dense[None, :] * ((raw > 0) & (place >= 0))
            step("dense", out.T @ error + 1e-4 * net.dense)
            memory_offset += float(error.sum()) ** 2
            net.offset -= rate * float(error.sum()) / memory_offset**0.5
            grad_vectors, grad_filters = np.zeros_like(vectors), np.zeros_like(net.filters)
            for n, width in enumerate(WIDTHS):
                columns = slice(n * FILTERS, (n + 1) * FILTERS)
                text, which = np.nonzero(back[:, columns])
                if not len(text):
                    continue
                pushed = back[text, n * FILTERS + which]
                for k in range(width):
                    word = local[place[text, n * FILTERS + which] + k]
                    column = (offsets[n] + k) * FILTERS + which
                    np.add.at(grad_vectors, word, pushed[:, None] * net.filters[:, column].T)
                    np.add.at(grad_filters.T, column, pushed[:, None] * vectors[word])
            step("bias", back.sum(axis=0))
            touched = np.flatnonzero(np.abs(grad_vectors).sum(axis=1))
            if len(touched):
                buckets = rows[distinct[touched]]
                at, inverse = np.unique(buckets.ravel(), return_inverse=True)
                summed = np.zeros((len(at), DIMENSIONS), np.float32)
                np.add.at(summed, inverse.ravel(), np.repeat(grad_vectors[touched], AFFIXES, axis=0))
                step("embedding", summed, at)
            step("filters", grad_filters)
    return (memory["embedding"] > 1e-2 + 1e-12).any(axis=1)


def _threshold(logits: np.ndarray, labels: np.ndarray, weights: tuple[float, float]) -> float:
    """The cut with the best F1 for label 1 over weighted rows, in the middle of the gap it lies in."""
    order = np.argsort(-logits, kind="stable")
    weight = np.where(labels[order] == 1, weights[1], weights[0])
    sorted_logits, hits = logits[order], np.cumsum(weight * labels[order])
    f1 = 2 * hits / (np.cumsum(weight) + hits[-1])
    f1[:-1][sorted_logits[:-1] == sorted_logits[1:]] = -1
    best = int(np.argmax(f1))
    below = sorted_logits[best + 1] if best + 1 < len(order) else sorted_logits[best] - 1
    return float((sorted_logits[best] + below) / 2)


def calibrate(
    net: ConvolutionalNet, texts: list[str], labels: np.ndarray, part: np.ndarray, weights: tuple[float, float] = (1.0, 1.0)
) -> ConvolutionalNet:
    """Thresholds by language on the rows kept from training, or on all rows where those lack a label. F1 depends on the
    ratio of the labels, so rows count with ``weights``."""
    held = part < 0.2
    if held.sum() < 2 or labels[held].min() == labels[held].max():
        held = np.ones(len(labels), bool)
    logits, language = Scorer(net).raw([t for t, h in zip(texts, held, strict=True) if h])
    truth = labels[held]
    net.shift[:] = _threshold(logits, truth, weights)
    for i in range(len(LANGUAGES)):
        mine = language == i
        if min((truth[mine] == 1).sum(), (truth[mine] == 0).sum()) >= LEAST_ROWS:
            net.shift[i] = _threshold(logits[mine], truth[mine], weights)
    return net


def toxicity_scores(
    docs: DataFrame, texts: list[str], labels: np.ndarray, part: np.ndarray, name: str = "score",
    weights: tuple[float, float] = (1.0, 1.0),
) -> DataFrame:
    """``docs`` with a toxicity score from 0 to 1 for each whole text, by a net fitted to the given labelled texts.

    A null text counts as empty; empty texts get the score of a text without any response. Rows with equal texts get
    equal scores. A column called ``name`` is replaced; an empty table stays empty.
    """
    return score_texts(docs, Scorer(train(texts, labels, part, weights=weights)), name)


def _bucketed(frame: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """The words of the texts as rows of an array of buckets."""
    table = WordTable(affixes, AFFIXES)
    return [table.ids(text.split()) for text in frame["text"]], table.new_rows()


def _seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For either label, how many texts of a task have each bucket; how many texts there are comes as bucket -1."""
    seen, texts = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    table, rows = None, None
    for batch in by_bytes(batches, "text"):
        if table is None or table.full():
            table, rows = WordTable(affixes, AFFIXES), np.empty((0, AFFIXES), np.int32)
        ids = [table.ids(text.split()) for text in batch["text"]]
        rows = np.concatenate([rows, table.new_rows()])
        for label, words in zip(batch["label"], ids, strict=True):
            seen[label, rows[words].ravel()] += 1  # numpy adds once for a bucket, however often it is listed
            texts[label] += 1
    some = np.flatnonzero(seen.any(axis=0))
    yield pd.DataFrame({"bucket": [-1, *some], "seen0": [texts[0], *seen[0, some]], "seen1": [texts[1], *seen[1, some]]})


def _fitted(start: ConvolutionalNet, share: float, epochs: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Nets fitted to the shards of a task, in pieces: those embeddings that have moved, and all the rest as the last piece."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches, ignore_index=True)
        for _, shard in rows.sort_values(["shard", "place", "text"], kind="stable").groupby("shard"):
            net, (ids, buckets) = deepcopy(start), _bucketed(shard)
            moved = descend(net, ids, buckets, shard["label"].to_numpy(np.float32), np.arange(len(shard)), share, epochs)
            pieces = [(p, np.flatnonzero(moved[p * PIECE : (p + 1) * PIECE])) for p in range(BUCKETS // PIECE)]
            out = [(p, at.astype(np.int32).tobytes(), net.embedding[p * PIECE + at].tobytes()) for p, at in pieces if len(at)]
            rest = np.concatenate([net.filters.ravel(), net.bias, net.dense, [net.offset]]).astype(np.float64)
            yield pd.DataFrame([*out, (-1, b"", rest.tobytes())], columns=["piece", "at", "numbers"])

    return fit


def _averaged(pieces: pd.DataFrame) -> pd.DataFrame:
    """The mean of a piece over the shards; of an embedding over those in which it has moved."""
    if pieces["piece"].iloc[0] == -1:
        rest = np.mean([np.frombuffer(raw) for raw in sorted(pieces["numbers"])], axis=0)
        return pd.DataFrame([(-1, b"", rest.tobytes())], columns=["piece", "at", "numbers"])
    total, times = np.zeros((PIECE, DIMENSIONS)), np.zeros(PIECE)
    for at, raw in sorted(zip(pieces["at"], pieces["numbers"], strict=True)):  # sums must not depend on the order of arrival
        where = np.frombuffer(at, np.int32)
        total[where] += np.frombuffer(raw, np.float32).reshape(-1, DIMENSIONS)
        times[where] += 1
    at = np.flatnonzero(times)
    mean = (total[at] / times[at, None]).astype(np.float32)
    return pd.DataFrame([(pieces["piece"].iloc[0], at.astype(np.int32).tobytes(), mean.tobytes())], columns=["piece", "at", "numbers"])


def _counted(net: ConvolutionalNet) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows of either label by language and step of the logit, with the least and the largest logit."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(net)
        for batch in by_bytes(batches, "text"):
            logits, language = scorer.raw(batch["text"].tolist())
            logits = logits.astype(float)
            step = np.floor(np.clip(logits, -32, 32) * STEPS).astype(np.int64)
            found = pd.DataFrame({"language": language, "step": step, "label": batch["label"].to_numpy(), "logit": logits})
            groups = found.groupby(["language", "step"])
            yield groups.agg(rows=("label", "size"), hits=("label", "sum"), low=("logit", "min"), high=("logit", "max")).reset_index()

    return count


def _threshold_of_steps(steps: pd.DataFrame) -> float:
    """As ``_threshold``, from the counts of steps of the logit."""
    steps = steps.groupby("step").agg({"rows": "sum", "hits": "sum", "low": "min", "high": "max"}).sort_index(ascending=False)
    rows, hits, low, high = (steps[name].to_numpy(float) for name in ("rows", "hits", "low", "high"))
    f1 = 2 * hits.cumsum() / (rows.cumsum() + hits.sum())
    best = int(np.argmax(f1))
    return float((low[best] + (high[best + 1] if best + 1 < len(low) else low[best] - 2)) / 2)


def fit_all(rows: DataFrame) -> ConvolutionalNet:
    """A net fitted to all rows (place, label, text). What reaches the driver is bounded: counts by bucket, one net, counts
    by language and step of the logit."""
    rows = materialize(rows.withColumn("part", part_of("place")), "toxicity-rows")
    size = F.sum(F.length("text") / 6)  # about the number of words
    counts = rows.groupBy("label", (F.col("part") >= 0.2).alias("learn")).agg(F.count(F.lit(1)).alias("rows"), size.alias("words")).collect()
    if len({c["label"] for c in counts}) < 2:
        return train([], np.array([float(c["label"]) for c in counts][:1]), np.empty(0))

    def side(learn: bool) -> tuple[list, Column]:
        """Rows that training takes, or those kept from it; all rows where these lack a label."""
        mine = [c for c in counts if c["learn"] == learn]
        return (mine, (F.col("part") >= 0.2) == learn) if len({c["label"] for c in mine}) == 2 else (counts, F.lit(True))

    (used, learn), (_, held) = side(True), side(False)
    n_rows = sum(c["rows"] for c in used)
    start, seen = ConvolutionalNet.new(11), np.zeros((2, BUCKETS))
    by_bucket = rows.where(learn).select("label", "text").mapInPandas(_seen, "bucket int, seen0 long, seen1 long")
    by_bucket = by_bucket.groupBy("bucket").agg(F.sum("seen0").alias("seen0"), F.sum("seen1").alias("seen1")).toPandas().set_index("bucket")
    texts = by_bucket.loc[-1].to_numpy()
    by_bucket = by_bucket.drop(-1)
    seen[:, by_bucket.index] = by_bucket.to_numpy().T
    begin_from_counts(start, seen, texts)
    shards = max(-(-n_rows // SHARD_ROWS), int(sum(c["words"] for c in used) // SHARD_WORDS) + 1)
    dealt = rows.where(learn).withColumn("shard", F.pmod(F.xxhash64("place", F.lit("shard")), F.lit(shards)).cast("int"))
    dealt = dealt.select("shard", "place", "label", "text").repartitionById(shards, "shard")
    schema = "piece int, at binary, numbers binary"
    fitted = dealt.mapInPandas(_fitted(start, texts[1] / texts.sum(), EPOCHS if shards == 1 else SHARED_EPOCHS), schema)
    net = start
    for piece, at, numbers in fitted.groupBy("piece").applyInPandas(_averaged, schema).collect():
        if piece >= 0:
            net.embedding[piece * PIECE + np.frombuffer(at, np.int32)] = np.frombuffer(numbers, np.float32).reshape(-1, DIMENSIONS)
            continue
        filters, bias, dense, offset = np.split(np.frombuffer(numbers), np.cumsum([net.filters.size, net.bias.size, net.dense.size]))
        net.filters, net.bias = filters.astype(np.float32).reshape(net.filters.shape), bias.astype(np.float32)
        net.dense, net.offset = dense.astype(np.float32), float(offset[0])
    steps = rows.where(held).select("label", "text").mapInPandas(
        _counted(net), "language int, step long, rows long, hits long, low double, high double"
    ).groupBy("language", "step").agg(
        F.sum("rows").alias("rows"), F.sum("hits").alias("hits"), F.min("low").alias("low"), F.max("high").alias("high")
    ).toPandas()
    net.shift[:] = _threshold_of_steps(steps)
    for language, mine in steps.groupby("language"):
        if min(mine["hits"].sum(), (mine["rows"] - mine["hits"]).sum()) >= LEAST_ROWS:
            net.shift[language] = _threshold_of_steps(mine)
    return net


def op1_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    net = fit_all(labelled_texts(documents, labels, "toxic", remainder(5) != 0))
    scored = score_texts(documents.select("doc_id", "text"), Scorer(net))
    return scored.select(
        "doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
