"""Latency quantiles that can be merged: a KLL sketch for each report, of any grouping, summed up later.

Exact quantiles of a union need the rows of all its parts. A sketch has a size that hardly grows with its rows, and those of days,
datasets or stream windows merge into the sketch of all of them. Its quantiles are a value of the data whose rank
is off by at most ``RANK_ERROR`` of the rows, save with a chance well under one in a million; up to some ``SKETCH_SIZE`` values
they are exact. Rows without a latency take no part, and a group that has only those has no row.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.operators.filters import Filters, apply_filters
from loghelm.operators.reports import LATENCY_QUANTILES

SKETCH_SIZE = 800  # the sketch's k: a rank is within 0.35 % in 99 of 100 cases
RANK_ERROR = 0.01
SKETCH_COLUMNS = ["timed_requests", "total_time", "latencies"]


def sketch_measures(value: str = "response_time_ms") -> list[Column]:
    """The columns of a sketch report, as aggregates over rows: count, sum and sketch of the values there are."""
    return [
        F.count(value).alias("timed_requests"), F.sum(value).alias("total_time"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH_SIZE)).alias("latencies"),
    ]


def latency_sketches(log: DataFrame, by: list[str], filters: Filters | None = None) -> DataFrame:
    """One sketch report per group of ``by``. Sketches are combined on the map side; only they are shuffled."""
    timed = apply_filters(log, filters).where(F.col("response_time_ms").isNotNull())
    return timed.groupBy(*by).agg(*sketch_measures())


def merge_latencies(reports: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The sketch reports of the groups of ``by`` (all as one without it), out of reports of smaller parts."""
    return reports.groupBy(*(by or [])).agg(
        F.sum("timed_requests").alias("timed_requests"), F.sum("total_time").alias("total_time"),
        F.kll_merge_agg_double("latencies").alias("latencies"),
    )


def sketched_quantiles(reports: DataFrame) -> DataFrame:
    """Sketch reports with their mean and quantiles, under the names ``latency_percentiles`` uses, in place of the sketch."""
    rest = [c for c in reports.columns if c not in SKETCH_COLUMNS]
    quantiles = [F.kll_sketch_get_quantile_double("latencies", F.lit(p)).alias(name) for name, p in LATENCY_QUANTILES.items()]
    mean = (F.col("total_time") / F.col("timed_requests")).alias("avg_response_time")
    return reports.where("timed_requests > 0").select(*rest, "timed_requests", mean, *quantiles)


def within_rank_error(estimates: DataFrame, log: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and for each quantile whether the rank of its estimate is within ``RANK_ERROR`` of the wanted one.

    One pass over the rows counts how many lie below and at each estimate; ``by`` has no nulls.
    """
    shown = estimates.select(*by, *[F.col(name).alias(f"_{name}") for name in LATENCY_QUANTILES])
    rows = log.where(F.col("response_time_ms").isNotNull()).join(shown, by)
    value = F.col("response_time_ms").cast("double")

    def close(name: str, wanted: float) -> Column:
        below, upto = F.avg((value < F.col(f"_{name}")).cast("int")), F.avg((value <= F.col(f"_{name}")).cast("int"))
        return ((below <= wanted + RANK_ERROR) & (upto >= wanted - RANK_ERROR)).alias(f"{name}_close")

    return rows.groupBy(*by).agg(*[close(name, p) for name, p in LATENCY_QUANTILES.items()])
