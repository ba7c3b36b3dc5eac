"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for all nodes of ``edges`` (a, b; any direction, repeats allowed).

    Every round hands each node the smallest label among its neighbours' and then that label's own label, so a chain
    shortens by half or more. Labels are written after each round, and the driver learns only how many changed. A hub
    with many edges is one key of a join of two stored tables, which Spark splits; its labels are combined before they
    are shuffled. No edges give no rows; nulls are left out.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")), "labels")
    while True:
        heard = (
            both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("theirs")), "b")
            .groupBy("a").agg(F.min("theirs").alias("heard"))
        )
        told = materialize(
            labels.join(heard, labels["node"] == heard["a"], "left")
            .select("node", "component", F.least("component", F.coalesce("heard", "component")).alias("next")),
            "labels-told",
        )
        jump = told.select(F.col("node").alias("next"), F.col("next").alias("after"))
        labels = materialize(
            told.join(jump, "next", "left")
            .select("node", F.col("component").alias("was"), F.least("next", F.coalesce("after", "next")).alias("component")),
            "labels",
        )
        if labels.where("component != was").isEmpty():
            return labels.select("node", "component")
