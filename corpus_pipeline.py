"""The corpus pipeline: quality, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of ``documents``;
the last adds shard and slot. Between stages the rows are written as Parquet to the shared folder and read again, so a
lost executor never costs more than one stage. Nulls, empty texts, repeated rows and empty tables have the results that
the operators state; columns that ``docs`` has besides are passed on under any name but shard, slot and text_hash, which
the last stage sets or uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loghelm.llm.common import Columns, materialize, read
from loghelm.llm.decontaminate import decontaminate
from loghelm.llm.mixing import mix_sources
from loghelm.llm.near_duplicates import keep_one_of_each_class
from loghelm.llm.quality import fitted_scores
from loghelm.llm.sharding import shard_documents

SHARDS = 8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5 go."""
    own = Columns(docs)
    named = own.frame.select(*own.kept, own["doc_id"].alias("doc_id"), own["text"].alias("text"))
    return own.restored(fitted_scores(named, read(spark, sf_dir, "labels"), "score").where("score >= 0.5"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are copies or near copies of each other the one with the smallest id stays."""
    return keep_one_of_each_class(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that sources get their target shares, and shuffled."""
    own = Columns(docs)
    named = own.frame.select(*own.kept, *[own[name].alias(name) for name in ("doc_id", "text", "source")])
    return own.restored(mix_sources(named))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard and its slot there."""
    return shard_documents(docs, SHARDS).drop("text_hash")


STAGES = [
    ("quality", quality), ("near duplicates", near_duplicates), ("decontamination", benchmark), ("mixing", mixing), ("sharding", sharding),
]

#: SQL can't express the classifier; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
