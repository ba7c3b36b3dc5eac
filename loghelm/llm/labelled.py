"""Labelled training rows, all of them or a bounded number, and the scoring of whole tables, for the text classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.llm.common import by_bytes


def learnable(labels: DataFrame, label: str, learn_from: Column) -> DataFrame:
    """doc_id and its 0/1 ``label``, one row for each id that training may use. A doc_id with several labels counts as 1
    if any is 1; null ids and labels are left out."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn_from)
        .groupBy("doc_id").agg(F.max(label).alias("label"))
    )


def label_weights(labels: DataFrame, label: str, learn_from: Column, per_class: int) -> tuple[float, float]:
    """How many learnable rows one row of ``labelled_sample`` stands for, with label 0 and with label 1.

    The sample bounds each label on its own, so its ratio of labels depends on the size of the table; with these weights
    the ratio is that of all learnable rows again. A label under the bound weighs 1.
    """
    counts = {r["label"]: r["count"] for r in learnable(labels, label, learn_from).where("label IN (0, 1)").groupBy("label").count().collect()}
    return tuple(max(1.0, counts.get(which, 0) / per_class) for which in (0, 1))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column) -> DataFrame:
    """``place, label, text`` of every id that training may use: the whole text, the 0/1 label and a hash of the id.

    Of an id's rows the smallest text counts. Nothing is broadcast by hint, as labels grow with the documents.
    """
    rows = learnable(labels, label, learn_from).where("label IN (0, 1)").withColumn("place", F.xxhash64("doc_id", F.lit(label)))
    texts = docs.where(learn_from).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(rows, "doc_id").groupBy("doc_id", "place", "label").agg(F.min("text").alias("text"))
    return found.select("place", F.col("label").cast("int").alias("label"), "text")


def part_of(place: str) -> Column:
    """A number in [0, 1) for each ``place``, the one ``labelled_sample`` gives."""
    return F.pmod(F.col(place), F.lit(1 << 20)) / F.lit(float(1 << 20))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, per_class: int
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Whole texts, their 0/1 labels and a number in [0, 1) for each, of at most ``per_class`` rows of either label.

    Which rows are taken depends on a hash of doc_id only. Of an id's rows the smallest text counts, found before the
    shuffle and the driver. The chosen ids (at most twice ``per_class``) are sent to all
    executors, so texts of other rows don't leave their task.
    """
    rows = learnable(labels, label, learn_from).withColumn("place", F.xxhash64("doc_id", F.lit(label)))
    chosen = rows.where("label = 1").orderBy("place", "doc_id").limit(per_class).unionByName(
        rows.where("label = 0").orderBy("place", "doc_id").limit(per_class)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id")
    found = joined.groupBy("doc_id", "place", "label").agg(F.min("text").alias("text")).drop("doc_id").toPandas()
    found = found.sort_values(["place", "text"], kind="stable")
    part = (found["place"].to_numpy().astype(np.int64).view(np.uint64) % np.uint64(1 << 20)).astype(float) / (1 << 20)
    return found["text"].tolist(), found["label"].to_numpy(dtype=np.float32), part


def score_texts(docs: DataFrame, score: Callable[[list[str]], np.ndarray], name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``: the score of each whole text. Null texts are scored as empty ones."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [score(part["text"].fillna("").tolist()) for part in by_bytes([batch.to_frame("text")], "text")]
            yield pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return docs.withColumn(name, scored(F.col("text")))


def remainder(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor
