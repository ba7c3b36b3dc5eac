"""N-gram Jaccard join by MinHash banding.

Equal texts are one node. Each node's n-grams give ``bands`` hashes of ``rows`` minima; texts that share one are
candidates, and all candidates are verified on their full n-gram sets. What is compared at once is a unit. The members of
a bucket are tied to its smallest one, and a component of these ties is one unit where that takes no more comparisons
than its buckets would, as in a group of near copies that share most of their bands. Otherwise - texts of one template,
which chains of accidental ties connect - each bucket is a unit of its own, and a pair counts in the first band it shares.
A unit of any size is cut into blocks bounded in texts and bytes, and a task compares two blocks by matrix products; it
reports degrees and local classes, never pairs. Components of what was verified are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.llm.common import Columns, by_bytes, materialize, parallelism
from loghelm.llm.graph import connected_components
from loghelm.llm.shingles import WordHashes, ngrams

WORDS, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.99, 8
#: Texts in a block, and bytes on average (a text alone may have more). A task holds two blocks.
BLOCK, BLOCK_BYTES = 256, 24 << 20
RESULTS = ["class_id", "n_links", "n_copies", "class_key"]
#: n-grams in one step of the signature and in one matrix product.
STEP, COLUMNS = 1 << 15, 1 << 13


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """How many bands of ``rows`` minima make a pair at the threshold a candidate with the given probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def signatures(texts: DataFrame, words: int, bands: int, rows: int, seed: int = 7) -> DataFrame:
    """node, bands (array of long) of (node, text); texts without words are left out."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 32, (2, bands * rows), dtype=np.uint32) | np.uint32(1)
    spread = rng.integers(1 << 62, 1 << 63, (bands, rows), dtype=np.uint64) | np.uint64(1)

    def minima(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        low, high = grams.astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
        out = np.empty((bands * rows, len(starts)), np.uint32)
        a, b = np.empty_like(low), np.empty_like(low)
        for i in range(bands * rows):
            np.multiply(low, factors[0, i], out=a)
            np.multiply(high, factors[1, i], out=b)
            np.add(a, b, out=a)
            out[i] = np.minimum.reduceat(a, starts)
        return out

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in by_bytes(batches, "text"):
            nodes, found = [], []
            waiting, size = [], 0

            def done() -> None:
                starts = np.concatenate([[0], np.cumsum([len(g) for g in waiting])[:-1]]).astype(np.int64)
                found.append(minima(np.concatenate(waiting), starts))

            for node, text in zip(batch["node"], batch["text"], strict=True):
                grams = ngrams(hashes.of(text.split()), words)
                if len(grams):
                    nodes.append(node)
                    waiting.append(grams)
                    size += len(grams)
                    if size >= STEP:
                        done()
                        waiting, size = [], 0
            if waiting:
                done()
            if nodes:
                low = np.concatenate(found, axis=1).astype(np.uint64).reshape(bands, rows, len(nodes))
                keys = (low * spread[:, :, None]).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)[:, None]
                yield pd.DataFrame({"node": nodes, "bands": list(keys.view(np.int64).T)})

    return texts.mapInPandas(of, "node string, bands array<bigint>")


def _local_classes(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first row it is connected with."""
    label = np.arange(len(linked))
    while True:
        heard = np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, heard)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verified(
    texts: list[str], block: np.ndarray, words: int, threshold: float, hashes: WordHashes, bands: np.ndarray | None = None
) -> np.ndarray:
    """Symmetric matrix of the pairs with a similarity of ``threshold`` or more. Where there are two blocks, only of pairs
    across them. bands: hashes of the bands before the unit's own; pairs that share one of them are left out."""
    sets = [np.unique(ngrams(hashes.of(text.split()), words)) for text in texts]
    sizes = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(shared.sum()), COLUMNS):
        here = slice(*np.searchsorted(column, [first, first + COLUMNS]))
        part = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - first)), np.float32)
        part[row[here], column[here] - first] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    # Counts are exact in single precision up to 2^24 n-grams; the threshold is compared on integers times 10^6.
    linked = common.astype(np.int64) * 1_000_000 >= np.int64(round(threshold * 1e6)) * union.astype(np.int64)
    linked &= union > 0
    np.fill_diagonal(linked, False)
    if (block != block[0]).any():
        linked &= block[:, None] != block[None, :]
    for earlier in bands.T if bands is not None else ():
        linked &= earlier[:, None] != earlier[None, :]
    return linked


def _links(tasks: DataFrame, words: int, threshold: float) -> DataFrame:
    """node, links, root for each pair of blocks. tasks: task, block, node, earlier, text, sorted by task in each partition."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()

        def result(rows: pd.DataFrame) -> pd.DataFrame:
            bands = np.stack(rows["earlier"].to_list()) if rows["earlier"].iat[0] is not None else None
            linked = verified(rows["text"].tolist(), rows["block"].to_numpy(), words, threshold, hashes, bands)
            root = _local_classes(linked)
            nodes = rows["node"].to_numpy()
            out = pd.DataFrame({"node": nodes, "links": linked.sum(axis=1), "root": nodes[root]})
            return out[out["links"] > 0]

        held: list[pd.DataFrame] = []
        for batch in by_bytes(batches, "text"):
            task = batch["task"].to_numpy()
            cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1), len(batch)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                part = batch.iloc[begin:end]
                if held and held[0]["task"].iat[0] != part["task"].iat[0]:
                    yield result(pd.concat(held))
                    held = []
                held.append(part)
        if held:
            yield result(pd.concat(held))

    return tasks.mapInPandas(of, "node string, links long, root string")


def candidate_units(signed: DataFrame, sizes: DataFrame) -> DataFrame:
    """unit, node, earlier, n, bytes: which texts are compared with which, one row for each text of a unit. signed: node,
    bands; sizes: node, bytes. Of a unit that is a bucket ``earlier`` holds the node's bands before it; n and bytes are the unit's."""
    banded = signed.select("node", F.explode("bands").alias("band"))
    buckets = materialize(
        banded.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"), "near-buckets"
    )
    members = materialize(banded.join(buckets, "band"), "near-members")
    ties = members.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    # A component's pairs against those of its buckets.
    groups = connected_components(ties).join(members.groupBy("node").agg(F.sum("n").alias("tied")), "node").join(sizes, "node")
    groups = materialize(groups, "near-groups")
    whole = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sum("tied").alias("tied"))
    whole = materialize(whole.withColumn("dense", (F.col("n") <= BLOCK) | (F.col("n") * F.col("n") <= F.col("tied"))), "near-components")
    placed = materialize(groups.drop("tied").withColumnRenamed("bytes", "own").join(whole, "component"), "near-placed")
    dense = placed.where("dense").select(F.col("component").alias("unit"), "node", F.lit(None).cast("array<bigint>").alias("earlier"), "n", "bytes")
    loose = placed.where("not dense").select("node", "own").join(signed, "node")
    earlier = F.slice("bands", F.lit(1), F.col("place"))
    loose = loose.select("node", "own", "bands", F.posexplode("bands").alias("place", "band")).select("node", "own", "band", earlier.alias("earlier"))
    per_bucket = loose.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("bytes")).where("n > 1")
    loose = loose.join(materialize(per_bucket, "near-loose"), "band").select(F.concat(F.lit("band "), "band").alias("unit"), "node", "earlier", "n", "bytes")
    return dense.unionByName(loose)


def near_duplicate_classes(
    docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS
) -> DataFrame:
    """``docs`` with class_id, n_links, n_copies and class_key for each row; no row is dropped.

    Words are what white space separates, unchanged; the similarity of two texts is the Jaccard similarity of their sets
    of ``words`` consecutive words. class_id: smallest doc_id of the texts connected by links; n_links: how many other
    different texts a text is linked with; n_copies: rows with the same text, itself included; class_key: names the class
    also where ids are null. Texts with fewer words than ``words`` are one n-gram; texts without words are linked with none
    but their copies. Null texts count as empty, rows with a null doc_id take part (class_id is null if all ids of a class
    are), an empty table stays empty. Columns called like a result, in any case, are replaced.
    """
    own = Columns(docs, *RESULTS)
    known, node = _classes(own, words, threshold, recall, rows)
    return own.restored(own.frame.withColumn("node", node).join(known, "node"), *RESULTS)


def _classes(own: Columns, words: int, threshold: float, recall: float, rows: int) -> tuple[DataFrame, Column]:
    """The results for each text, stored, by node; and the expression of a row's node."""
    docs, spark = own.frame, own.frame.sparkSession
    text = F.coalesce(own["text"], F.lit(""))
    node, text = F.md5(text).alias("node"), text.alias("text")
    nodes = materialize(
        docs.select(own["doc_id"].alias("doc_id"), node, F.octet_length(text).cast("long").alias("bytes")).groupBy("node")
        .agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_copies"), F.max("bytes").alias("bytes")), "near-nodes",
    )
    bands = bands_for(threshold, recall, rows)
    signed = signatures(docs.select(node, text), words, bands, rows).groupBy("node").agg(F.first("bands").alias("bands"))
    signed = materialize(signed, "near-signatures")

    # Pairs of blocks of every unit.
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    cut = candidate_units(signed, nodes.select("node", "bytes")).withColumn("blocks", blocks)
    cut = materialize(cut.select("unit", "node", "earlier", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "near-blocks")
    whole = docs.select(node, text).groupBy("node").agg(F.first("text").alias("text"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("block", other).alias("i"), F.greatest("block", other).alias("j")))
    tasks = (
        cut.join(whole, "node").select("unit", "block", "node", "earlier", "text", F.explode(pairs).alias("pair"))
        .select(F.concat_ws(":", "unit", "pair.i", "pair.j").alias("task"), "block", "node", "earlier", "text")
        .repartition(parallelism(spark), "task").sortWithinPartitions("task")
    )
    links = materialize(_links(tasks, words, threshold), "near-links")
    degrees = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.join(degrees, "node", "left").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named, "near-named")
    ids = named.groupBy("component").agg(F.min("first").alias("class_id"))
    named = named.join(materialize(ids, "near-ids"), "component")
    return materialize(
        named.select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", F.col("component").alias("class_key")), "near-known"
    ), node


def keep_one_of_each_class(
    docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS
) -> DataFrame:
    """The row of each class whose id is the class's, with all its columns; of several such rows (repeated ids, or none but
    null ids) any one. Null texts count as empty, and all empty ones are one class; an empty table stays empty."""
    own = Columns(docs)
    known, node = _classes(own, words, threshold, recall, rows)
    named = lambda frame: frame.join(known.select("node", "class_id", "class_key"), "node").where(own["doc_id"].eqNullSafe(F.col("class_id")))
    rows_of = own.frame.withColumn("node", node)
    several = named(rows_of).groupBy("class_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class_key")
    several = materialize(several, "near-several")
    kept = named(rows_of)
    if several.isEmpty():
        return own.restored(kept)
    one = kept.join(several, "class_key", "left_semi").dropDuplicates(["class_key"])
    return own.restored(kept.join(several, "class_key", "left_anti").select(*own.kept).unionByName(one.select(*own.kept)))


def op6_near_duplicates(documents: DataFrame) -> DataFrame:
    out = near_duplicate_classes(documents.select("doc_id", "text"))
    return out.select("doc_id", "class_id", "n_links", "n_copies")
