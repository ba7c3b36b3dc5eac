"""What the operators share: reading tables, shared scratch tables, row identity, and batches of bounded size."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loghelm.session import scratch_dir

__all__ = ["Columns", "StorageLevel", "by_bytes", "item_blocks", "materialize", "parallelism", "pieces", "read", "text_or_empty", "unit_interval"]


_BLANK = re.compile(rb"[\x20\t-\r]")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def materialize(frame: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the cluster's shared folder and read it back.

    The lineage ends there: a lost executor costs the tasks that read it, not what came before.
    """
    path = scratch_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


class Columns:
    """The caller's columns under numbered names while an operator works, so that none of its own names can clash.

    ``frame`` has the columns c0, c1, ..; ``c["text"]`` is the column that the caller calls so (case counts where two
    names differ in it alone), and ``kept`` names those that go on, all but the ones called like a result in any case.
    ``restored`` gives them their names back.
    """

    def __init__(self, docs: DataFrame, *results: str, **more: Column):
        """more: further columns of the frame, by conditions on the caller's."""
        self.names, taken = docs.columns, {name.lower() for name in results}
        self.frame = docs.select("*", *more.values()).toDF(*[f"c{i}" for i in range(len(self.names))], *more)
        self.places = [i for i, name in enumerate(self.names) if name.lower() not in taken]
        self.kept = [f"c{i}" for i in self.places]

    def __getitem__(self, name: str) -> Column:
        if name in self.names:
            return F.col(f"c{self.names.index(name)}")
        return F.col(f"c{[n.lower() for n in self.names].index(name.lower())}")

    def restored(self, frame: DataFrame, *results: str | Column) -> DataFrame:
        return frame.select(*[F.col(f"c{i}").alias(self.names[i]) for i in self.places], *results)


def item_blocks(items: DataFrame, rows: int, chars: int) -> Iterator[list]:
    """The rows (item_id, text) of a query set without null texts, in blocks of at most about ``rows`` rows and ``chars``
    characters (an item alone may be longer). One block at a time is on the driver."""
    items = items.where(F.col("text").isNotNull()).select("item_id", "text")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, -(-size["n"] // (rows // 2)), -(-(size["chars"] or 0) // (chars // 2)))
    if blocks > 1:
        items = materialize(items.withColumn("block", F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks))), "item-blocks")
    for block in range(blocks):
        yield (items.where(F.col("block") == block) if blocks > 1 else items).select("item_id", "text").collect()


def pieces(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Cut after about ``size`` bytes, but at ASCII blanks only, so that no word is cut. raw: words apart by such blanks."""
    start = 0
    while len(raw) - start > size:
        cut = next((m.start() for m in _BLANK.finditer(raw, start + size)), len(raw))
        yield raw[start:cut]
        start = cut
    yield raw[start:]


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unit_interval(*parts: Column) -> Column:
    """A number in [0, 1) that the parts decide: the first 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def by_bytes(batches: Iterator[pd.DataFrame], column: str, limit: int = 8 << 20) -> Iterator[pd.DataFrame]:
    """Cut batches into slices of about ``limit`` characters, one row at least, so that memory in a task is bounded."""
    for batch in batches:
        ends = batch[column].str.len().fillna(0).to_numpy().cumsum()
        start = 0
        while start < len(batch):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(ends.searchsorted(base + limit, side="right")))
            yield batch.iloc[start:stop]
            start = stop


def ceil_div(a: int, b: int) -> int:
    return math.ceil(a / b)
