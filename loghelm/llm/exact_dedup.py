"""Exact de-duplication by a 128-bit content hash, with the bytes compared inside each hash group.

A group keeps one row for its smallest and one for its largest text. Both are combined before the shuffle, so a group
that holds a third of all rows arrives as one row per task. Where both texts are equal, all texts of the group are;
where they differ, two contents share a hash, and only those rows are grouped again by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.llm.common import Columns, materialize


def exact_classes(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest",
    content_hash: Column | None = None,
) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256 of each row; no row is dropped.

    keep: which id of a group stays, "smallest" or "largest". content_hash: 128-bit hash of the text (MD5 by default).
    A null text counts as empty. Rows with a null id never stay unless their group has no other id; then keep_id is null
    and all of them stay. Rows that repeat the id that stays and its text are the same row and all stay. An empty table
    gives an empty result. Columns of ``docs`` are passed on unless a result column has their name, in any case.
    """
    names = ["keep_id", "group_size", "kept", "text_sha256"]
    own = Columns(docs, *names, **({} if content_hash is None else {"hash": content_hash}))
    text = F.coalesce(own[text_column], F.lit(""))
    pick = {"smallest": F.min, "largest": F.max}[keep]
    frame = own.frame.withColumn("hash", F.md5(text) if content_hash is None else F.col("hash"))
    hashed = frame.select(own[id_column].alias("id"), text.alias("text"), "hash")

    groups = hashed.groupBy("hash").agg(
        pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min("text").alias("low"), F.max("text").alias("high")
    )
    groups = materialize(
        groups.select("hash", "keep_id", "group_size", F.sha2("low", 256).alias("text_sha256"), (F.col("low") == F.col("high")).alias("same")),
        "exact-groups",
    )
    kept = own[id_column].eqNullSafe(F.col("keep_id")).alias("kept")
    shown = lambda joined: own.restored(joined, "keep_id", "group_size", kept, "text_sha256")
    clean = shown(frame.join(groups, "hash", "left").where("same"))
    if groups.where("not same").isEmpty():
        return clean

    # Two contents under one hash: those rows only, by the whole text.
    colliding = groups.where("not same").select("hash")
    exact = materialize(
        hashed.join(colliding, "hash", "left_semi").groupBy("hash", "text").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .withColumn("text_sha256", F.sha2("text", 256)), "exact-collisions",
    )
    return clean.union(shown(frame.withColumn("text", text).join(exact, ["hash", "text"])))


def op5_exact_dedup(documents: DataFrame) -> DataFrame:
    """The contract's columns: the largest doc_id of equal texts stays."""
    out = exact_classes(documents.select("doc_id", "text"), keep="largest")
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
