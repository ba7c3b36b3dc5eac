"""Ranked lexical search over a length-stratified index.

The weight that length has in a score is the normaliser m, an integer. Documents of equal m are a stratum; inside it a
term's postings lie by term frequency, so what a posting adds is computed once for each frequency in the stratum, and the
largest frequency of each term bounds what any document of the stratum can score. An item visits strata by falling bound
and stops where the bound falls under its k-th best score.

One scan of the texts counts each document's terms and those that items ask for. Rows of these counts are dealt out by
ranges of m, so a task holds whole strata but for those at its ends, and a stratum with a third of all documents lies in
many tasks. Every task returns its k best for each item, and the best of those are the result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loghelm.llm.common import Columns, item_blocks, materialize, parallelism, pieces

#: Items and characters that one block of the query set has at most (an item alone may be longer); its terms are broadcast.
BLOCK_ITEMS, BLOCK_CHARS = 8192, 1 << 20
#: Postings that a task indexes at once.
GROUP_POSTINGS = 2_000_000
#: Fixed values of the ranking: in percent how much length counts, and the scales of weights and of impacts.
LENGTH_SHARE, WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, NORM_SCALE = 75, 1000, 1_000_000_000, 1000, 8
#: Bytes that are no part of a term become blanks, A to Z lower-case letters.
_TERM_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in stretches of bounded length."""
    for piece in pieces(raw.translate(_TERM_BYTES)):
        yield piece.split()


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, row (a number of its own), n, terms, tfs of (doc_id, row, text): all terms are counted, those of the
    vocabulary are listed by number."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            lengths, terms, tfs, ends = [], [], [], [0]
            for text in batch.column("text"):
                n, own = 0, Counter()
                for words in terms_of(text.as_buffer().to_pybytes() if text.is_valid else b""):
                    n += len(words)
                    own.update(filter(known.__contains__, words))
                lengths.append(n)
                terms.extend(map(known.__getitem__, own))
                tfs.extend(own.values())
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32())) for values in (terms, tfs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(lengths, pa.int64()), *lists], ["doc_id", "row", "n", "terms", "tfs"]
            )

    return docs.mapInArrow(count, f"doc_id {kind}, row long, n long, terms array<int>, tfs array<int>")


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    many = end - begin
    return np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())


class Strata:
    """The index of some documents: postings by stratum, term and frequency, with their impacts."""

    def __init__(self, norms: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, vocabulary: int):
        self.norms, stratum = np.unique(norms, return_inverse=True)
        doc = np.repeat(np.arange(len(norms)), np.diff(ends))
        order = np.lexsort((tfs, terms, stratum[doc]))
        self.doc, terms, tfs = doc[order], terms[order].astype(np.int64), tfs[order].astype(np.int64)
        here = stratum[self.doc]
        # What a frequency is worth in a stratum is computed once.
        levels, level = np.unique(np.stack([here, tfs]), axis=1, return_inverse=True)
        worth = (IMPACT_SCALE * levels[1]) // (TF_SCALE * levels[1] + NORM_SCALE * self.norms[levels[0]])
        self.impact = worth[level.ravel()]
        # Runs of one term in one stratum. The last posting of a run has the term's largest impact there.
        fresh = np.ones(len(here), bool)
        fresh[1:] = (here[1:] != here[:-1]) | (terms[1:] != terms[:-1])
        begin = np.flatnonzero(fresh)
        by_term = np.argsort(terms[begin], kind="stable")
        self.begin, self.end = begin[by_term], np.append(begin[1:], len(here))[by_term]
        self.stratum, self.most = here[self.begin], self.impact[self.end - 1]
        self.of_term = np.searchsorted(terms[self.begin], np.arange(vocabulary + 1))
        self.scores = np.zeros(len(norms), np.int64)

    def search(self, terms: np.ndarray, weights: np.ndarray, least: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(documents, scores) of each visit, of scores that may be among the k best. ``least``: a score under which none
        is wanted. Strata are visited by falling bound, twice as many each time."""
        runs = _ranges(self.of_term[terms], self.of_term[terms + 1])
        weight = np.repeat(weights, self.of_term[terms + 1] - self.of_term[terms])
        bounds = np.zeros(len(self.norms), np.int64)
        np.add.at(bounds, self.stratum[runs], weight * self.most[runs])
        order = np.argsort(-bounds, kind="stable")
        best, start, many = np.empty(0, np.int64), 0, 1
        while start < len(order) and bounds[order[start]] >= least:
            visited = np.zeros(len(bounds), bool)
            visited[order[start : start + many]] = True
            visited &= bounds >= least
            go = visited[self.stratum[runs]]
            begin, end = self.begin[runs[go]], self.end[runs[go]]
            places = _ranges(begin, end)
            docs = self.doc[places]
            np.add.at(self.scores, docs, np.repeat(weight[go], end - begin) * self.impact[places])
            docs = np.unique(docs)
            scores = self.scores[docs]
            self.scores[docs] = 0
            wanted = scores >= least
            if wanted.any():
                yield docs[wanted], scores[wanted]
                best = np.sort(np.concatenate([best, scores[wanted]]))[-k:]
                least = max(least, int(best[0])) if len(best) == k else least
            start, many = start + many, 2 * many


def _order(hit: tuple[int, object]) -> tuple:
    return -hit[0], hit[1] is None, hit[1]


def _best(counted: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], vocabulary: int, k: int) -> DataFrame:
    """item, doc_id, score: the k best of each task for each query. counted: doc_id, m, terms, tfs, by m in each task."""
    sent = counted.sparkSession.sparkContext.broadcast(queries)
    kind = counted.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, object]]] = [[] for _ in sent.value]
        ids_type = None

        def visit(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            terms, tfs = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
            ends = terms.offsets.to_numpy()
            strata = Strata(
                table.column("m").to_numpy(), ends - ends[0], terms.flatten().to_numpy(), tfs.flatten().to_numpy(), vocabulary
            )
            ids = table.column("doc_id")
            for item, (asked, weights) in enumerate(sent.value):
                least = best[item][-1][0] if len(best[item]) == k else 1
                for docs, scores in strata.search(asked, weights, least, k):
                    if len(scores) > k:  # of those that tie with the k-th all stay, since ids decide
                        go = scores >= np.partition(scores, -k)[-k]
                        docs, scores = docs[go], scores[go]
                    best[item] = sorted([*best[item], *zip(scores.tolist(), ids.take(docs).to_pylist())], key=_order)[:k]

        held, size = [], 0
        for batch in batches:
            ids_type = batch.schema.field("doc_id").type
            held.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= GROUP_POSTINGS:
                visit(held)
                held, size = [], 0
        if size:
            visit(held)
        found = [(item, doc, score) for item, hits in enumerate(best) for score, doc in hits]
        if found:
            item, doc, score = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), pa.array(doc, ids_type), pa.array(score, pa.int64())], ["item", "doc_id", "score"]
            )

    return counted.mapInArrow(search, f"item int, doc_id {kind}, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k highest-scoring rows of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text) as item_id, rank,
    doc_id, score, where the score is above 0; equal scores by ascending doc_id, null ids last.

    Null and empty texts have no terms: such documents are not found, and such items find none. Rows that repeat are
    ranked one by one, repeated items get their results once for each row. Empty tables give no rows. Further columns
    are not looked at. Very long texts are counted in pieces, whole.
    """
    spark = docs.sparkSession
    own, asked = Columns(docs), Columns(items)
    texts = own.frame.select(own["doc_id"].alias("doc_id"), F.monotonically_increasing_id().alias("row"), own["text"].alias("text"))
    out = []
    for block in item_blocks(asked.frame.select(asked["item_id"].alias("item_id"), asked["text"].alias("text")), BLOCK_ITEMS, BLOCK_CHARS):
        vocabulary: dict[bytes, int] = {}
        asked_for = []
        for row in block:
            words = Counter(w for part in terms_of(row["text"].encode("utf-8", "surrogatepass")) for w in part)
            asked_for.append({vocabulary.setdefault(word, len(vocabulary)): n for word, n in words.items()})
        counted = materialize(_counted(texts, vocabulary), "search-counts")
        size = counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        # At most one row for each term of the block.
        holding = {r["term"]: r["df"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
        weight = {t: math.floor(WEIGHT_SCALE * math.log((2 * size["docs"] + 2) / (2 * df + 1))) for t, df in holding.items()}
        queries = []
        for terms in asked_for:
            terms = {t: n * weight[t] for t, n in terms.items() if weight.get(t)}
            queries.append((np.array(list(terms), np.int64), np.array(list(terms.values()), np.int64)))
        share = F.lit(LENGTH_SHARE).cast("long")
        norm = F.lit(100) - share + F.call_function("div", share * F.col("n") * F.lit(size["docs"]), F.lit(max(1, size["terms"])))
        strata = (
            counted.where(F.size("terms") > 0).select("doc_id", "row", norm.cast("long").alias("m"), "terms", "tfs")
            .repartitionByRange(parallelism(spark), "m", "row").sortWithinPartitions("m")
        )
        found = _best(strata.select("doc_id", "m", "terms", "tfs"), queries, len(vocabulary), k)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        kind = asked.frame.select(asked["item_id"].alias("item_id")).schema["item_id"]
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item int, item_id {kind.dataType.simpleString()}")
        found = found.withColumn("rank", rank).where(F.col("rank") <= k)
        out.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def op13_lexical(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents ranked for each item of the benchmark."""
    return ranked_search(documents, benchmark)


OP13_SQL = r"""
WITH term_lists AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), docs AS (
  SELECT doc_id, terms, len(terms)::BIGINT AS n FROM term_lists WHERE len(terms) > 0
), total AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM docs
), postings AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM docs) GROUP BY doc_id, n, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(total.docs) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, total GROUP BY term
), impacts AS (
  SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * total.docs) // total.terms)) AS impact FROM postings, total
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(w * impact)::BIGINT AS score FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
