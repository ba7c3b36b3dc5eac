"""Substring de-duplication with an FM-index per shard.

Every window of ``WINDOW`` words has a minimizer, the first of the smallest hashes of its word n-grams. Equal windows have
equal minimizers. Consecutive windows with one minimizer in one place are a segment, and all segments with an equal
minimizer belong to one shard; two equal windows are never in one segment.
Only minimizers that occur again anywhere go on. Equal segments are one row with a weight. A shard's index holds its
segments, each segment is streamed against it, and windows whose interval weighs two or more are repeated.

Minimizers with very many different segments (what surrounds a passage that countless documents share) are taken apart
into windows, each a key of its own, so no shard grows with the most frequent passage.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.llm.common import Columns, by_bytes, materialize, parallelism
from loghelm.llm.fm_index import FMIndex
from loghelm.llm.shingles import mix
from loghelm.session import scratch_dir

WINDOW, GRAM = 35, 8
#: Windows in a segment at most.
RUN = 28
#: Words that a shard's index should hold.
SHARD_WORDS = 1_000_000
#: Different segments of a minimizer from which it is taken apart.
MANY_SEGMENTS = 2_000


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than space, tab and the four line ends after it, which is what bytes are split at."""
    return text.encode("utf-8", "surrogatepass").split()


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Which bytes separate words, and a random number for each byte.
_SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_NUMBERS = np.random.default_rng(31).integers(1, 1 << 63, 256, dtype=np.uint64)


class Segmenter:
    """Cuts texts into segments: (text, first word, windows, minimizer, content hash), as arrays.

    Hashes of words, of n-grams and of whole segments are differences of running sums, so no word becomes an object.
    """

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        self.power = self.back = np.empty(0, np.uint64)

    def _reach(self, n: int) -> None:
        if n >= len(self.power):
            self.power, self.back = _powers(_BASE, n + 1), _powers(_BACK, n + 1)

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and how many each text has."""
        raw = [text.encode("utf-8", "surrogatepass") for text in texts]
        codes = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        space = _SPACES[codes]
        before = np.concatenate([[True], space[:-1]])
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        self._reach(len(codes))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_NUMBERS[codes] * self.power[: len(codes)], dtype=np.uint64)])
        hashes = mix((total[ends] - total[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))
        stops = np.cumsum([len(r) + 1 for r in raw])
        return hashes, np.diff(np.searchsorted(starts, np.concatenate([[0], stops])))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        every, lengths = self._words(texts)
        n = len(every)
        if n < self.window:
            return tuple(np.empty(0, kind) for kind in (np.int64, np.int64, np.int64, np.int64, np.int64))
        self._reach(n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(every * self.power[:n], dtype=np.uint64)])
        sums = lambda begin, end: (total[end] - total[begin]) * self.back[begin]
        at = np.arange(n - self.gram + 1)
        low = mix(sums(at, at + self.gram))
        # The first place of the smallest hash of the n-grams of each window, by doubling.
        grams, have, source = self.window - self.gram + 1, 1, at
        while have < grams:
            step = min(have, grams - have)
            later = low[step:] < low[: len(low) - step]
            source = np.where(later, source[step:], source[: len(source) - step])
            low = np.where(later, low[step:], low[: len(low) - step])
            have += step
        ends = np.cumsum(lengths)
        text = np.repeat(np.arange(len(texts)), lengths)[: len(low)]
        place = np.arange(len(low)) - np.repeat(ends - lengths, lengths)[: len(low)]
        whole = place + self.window <= lengths[text]
        fresh = np.ones(len(low), bool)
        fresh[1:] = (source[1:] != source[:-1]) | (text[1:] != text[:-1])
        fresh &= whole
        heads = np.flatnonzero(fresh)
        if not len(heads):
            return tuple(np.empty(0, np.int64) for _ in range(5))
        # Runs of more than RUN windows are cut.
        run = np.arange(len(low)) - heads[np.maximum(np.cumsum(fresh) - 1, 0)]
        fresh |= whole & (run % RUN == 0)
        heads = np.flatnonzero(fresh)
        windows = np.add.reduceat(whole.astype(np.int64), heads)
        content = mix(sums(heads, heads + windows + self.window - 1) + windows.astype(np.uint64))
        return text[heads], place[heads], windows, low[heads].view(np.int64), content.view(np.int64)


def _segments(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """id1, id2, copies, place (first word * 256 + windows), mini, content of (id1, id2, copies, text)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = Segmenter(window, gram)
        for batch in by_bytes(batches, "text", 2 << 20):
            text, first, windows, mini, content = cut(batch["text"].tolist())
            yield pd.DataFrame({
                "id1": batch["id1"].to_numpy()[text], "id2": batch["id2"].to_numpy()[text], "copies": batch["copies"].to_numpy()[text],
                "place": first * 256 + windows, "mini": mini, "content": content,
            })

    return texts.mapInPandas(of, "id1 long, id2 long, copies long, place long, mini long, content long")


def _minimizers(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """mini, n: the segments with a minimizer, counted in stretches of the table; copies of a text count."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = Segmenter(window, gram)
        for batch in by_bytes(batches, "text", 2 << 20):
            text, _, _, mini, _ = cut(batch["text"].tolist())
            values, back = np.unique(mini, return_inverse=True)
            n = np.bincount(back, np.minimum(batch["copies"].to_numpy()[text], 2), len(values)).astype(np.int64)
            yield pd.DataFrame({"mini": values, "n": n})

    return texts.mapInPandas(of, "mini long, n long")


def _spelled(rows: DataFrame, window: int) -> DataFrame:
    """mini, content, weight, words (joined by spaces) of each wanted segment: text, wanted (array)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in by_bytes(batches, "text", 2 << 20):
            out = []
            for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
                words = words_of(text)
                for w in wanted:
                    first, windows = divmod(w["place"], 256)
                    out.append((w["mini"], w["content"], w["weight"], b" ".join(words[first : first + windows + window - 1]).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["mini", "content", "weight", "words"])

    return rows.select("text", "wanted").mapInPandas(of, "mini long, content long, weight long, words string")


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """One row per window of a segment, with the window's own hashes as its mini and content."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in by_bytes(batches, "words", 256 << 10):
            out = []
            for mini, content, weight, text in batch[["mini", "content", "weight", "words"]].itertuples(index=False):
                words = text.split(" ")
                for i in range(len(words) - window + 1):
                    part = " ".join(words[i : i + window])
                    key = hashlib.blake2b(part.encode(), digest_size=16).digest()
                    out.append((mini, content, i, int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True), weight, part))
            yield pd.DataFrame(out, columns=["from_mini", "from_content", "offset", "mini", "content", "weight", "words"])

    return rows.mapInPandas(of, "from_mini long, from_content long, offset int, mini long, content long, weight long, words string")


def _repeated(rows: DataFrame, window: int) -> DataFrame:
    """mini, content, mask (bit i: window i is repeated) of (shard, mini, content, weight, words), shards together."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def result(parts: list[pd.DataFrame]) -> pd.DataFrame:
            shard = pd.concat(parts)
            known: dict[str, int] = {}
            segments = [np.array([known.setdefault(w, len(known) + 1) for w in text.split(" ")], np.int64) for text in shard["words"]]
            index = FMIndex(segments, shard["weight"].to_numpy(), window)
            masks = [int(((weights >= 2) << np.arange(len(weights))).sum()) for weights in index.weights_of_windows(segments)]
            out = pd.DataFrame({"mini": shard["mini"].to_numpy(), "content": shard["content"].to_numpy(), "mask": masks})
            return out[out["mask"] > 0]

        held: list[pd.DataFrame] = []
        for batch in batches:
            shard = batch["shard"].to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1), len(batch)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                part = batch.iloc[begin:end]
                if held and held[0]["shard"].iat[0] != part["shard"].iat[0]:
                    yield result(held)
                    held = []
                if len(part):
                    held.append(part)
        if held:
            yield result(held)

    return rows.mapInPandas(of, "mini long, content long, mask long")


def _covered(rows: DataFrame, window: int) -> DataFrame:
    """id1, id2, n_words, n_removed, removed (array of begin, end in words), kept_sha256, text of (id1, id2, text, masks)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in by_bytes(batches, "text", 2 << 20):
            out = []
            for id1, id2, text, masks in batch[["id1", "id2", "text", "masks"]].itertuples(index=False):
                words = words_of(text)
                change = np.zeros(len(words) + 1, np.int64)
                for m in masks if masks is not None else ():
                    first, mask = m["place"] // 256, m["mask"]
                    for i in range(mask.bit_length()):
                        if mask >> i & 1:
                            change[first + i] += 1
                            change[first + i + window] -= 1
                covered = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]])))
                kept = [w for w, c in zip(words, covered, strict=True) if not c] if len(edges) else words
                out.append((
                    id1, id2, len(words), len(words) - len(kept), edges.tolist(),
                    hashlib.sha256(b" ".join(kept)).hexdigest(),
                ))
            yield pd.DataFrame(out, columns=["id1", "id2", "n_words", "n_removed", "edges", "kept_sha256"])

    return rows.select("id1", "id2", "text", "masks").mapInPandas(of, "id1 long, id2 long, n_words long, n_removed long, edges array<long>, kept_sha256 string")


def repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 and edges: begins and ends (in words, in turn) of the passages that
    windows of ``window`` words starting elsewhere too cover, own document included.

    Words are runs of characters other than space, tab and line ends. Null texts count as empty; a text shorter than a
    window keeps all its words, an empty table stays empty, and repeated rows are each other's repetition. Result columns
    replace those with their names, in any case. The stored texts are a table of the catalog while the operator runs.
    """
    spark = docs.sparkSession
    results = ["n_words", "n_removed", "edges", "kept_sha256"]
    own = Columns(docs, *results)
    docs = own.frame
    text: Column = F.coalesce(own["text"], F.lit(""))
    # 128 bits that name a text.
    digest = F.md5(text)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    ids = [half(1).alias("id1"), half(17).alias("id2")]

    # Different texts, stored in buckets by id, so that they are shuffled once and later joins move the other side.
    table = f"texts_{uuid.uuid4().hex}"
    buckets = parallelism(spark)
    (
        docs.select(*ids, text.alias("text")).groupBy("id1", "id2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
        .write.bucketBy(buckets, "id1", "id2").option("path", scratch_dir(spark, "texts")).option("compression", "zstd").saveAsTable(table)
    )
    try:
        done = _passages(spark.table(table), window, gram, buckets)
    finally:
        spark.sql(f"DROP TABLE {table}")
    return own.restored(docs.select(*own.kept, *ids).join(done, ["id1", "id2"]), *results)


def _passages(texts: DataFrame, window: int, gram: int, buckets: int) -> DataFrame:
    """The results for each text by id1 and id2, stored. texts: id1, id2, text, copies."""
    again = _minimizers(texts.select("text", "copies"), window, gram).groupBy("mini").agg(F.sum("n").alias("n")).where("n > 1")
    again = materialize(again.select("mini"), "repeated-minimizers")
    segments = _segments(texts.select("id1", "id2", "copies", "text"), window, gram)
    found = materialize(segments.join(again, "mini"), "repeated-segments")
    different = found.groupBy("mini", "content").agg(F.min(F.struct("id1", "id2", "place")).alias("at"), F.sum("copies").alias("weight"))
    wanted = different.groupBy("at.id1", "at.id2").agg(F.collect_list(F.struct("mini", "content", "at.place", "weight")).alias("wanted"))
    spelled = materialize(_spelled(texts.join(wanted, ["id1", "id2"]), window), "segments")

    many = materialize(
        spelled.groupBy("mini").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY_SEGMENTS).select("mini"), "frequent-minimizers"
    )
    plain, parts = spelled, None
    if not many.isEmpty():
        plain = spelled.join(many, "mini", "left_anti")
        parts = materialize(_windows(spelled.join(many, "mini", "left_semi"), window), "windows")
        single = parts.groupBy("mini", "content").agg(F.sum("weight").alias("weight"), F.first("words").alias("words"))
        plain = plain.select("mini", "content", "weight", "words").unionByName(single)
    n_words = spelled.agg(F.sum(F.length("words"))).first()[0] or 0
    shards = max(buckets, int(n_words // 6 // SHARD_WORDS) + 1)
    sharded = plain.withColumn("shard", F.pmod(F.xxhash64("mini"), F.lit(shards)))
    masks = _repeated(sharded.repartition(shards, "shard").sortWithinPartitions("shard"), window)
    masks = materialize(masks, "masks")
    if parts is not None:
        whole = parts.select("from_mini", "from_content", "offset", "mini", "content").join(masks, ["mini", "content"]).groupBy(
            F.col("from_mini").alias("mini"), F.col("from_content").alias("content")
        ).agg(F.bit_or(F.expr("shiftleft(1L, offset)")).alias("mask"))
        masks = masks.unionByName(whole)

    places = found.join(masks, ["mini", "content"]).groupBy("id1", "id2").agg(F.collect_list(F.struct("place", "mask")).alias("masks"))
    return materialize(_covered(texts.select("id1", "id2", "text").join(places, ["id1", "id2"], "left"), window), "covered")


def op4_substring_dedup(documents: DataFrame) -> DataFrame:
    out = repeated_passages(documents.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS passage
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM d)
), r AS (
  SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY passage) > 1
), c AS (
  SELECT DISTINCT doc_id, i + k AS place FROM r, range(35) t(k)
), u AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM d
), k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n FROM u ANTI JOIN c USING (doc_id, place) GROUP BY doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
