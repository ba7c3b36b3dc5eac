"""Exact continuous quantiles without holding a group's values in one task.

The built-in ``percentile`` keeps a value-to-count map per group in one task. Here the
counts per distinct value stay distributed; a histogram with a bounded number of bins
locates the bins that hold the wanted ranks, and only those bins are ordered.
"""

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_E = 4096  # bins per factor e of magnitude; at most some 6 million over all doubles


def _bin(value: Column) -> Column:
    """An integer that never decreases as ``value`` grows."""
    # The logarithm of the smallest double is above -746, so tiny values are told apart like large ones.
    magnitude = F.floor((F.ln(F.abs(value)) + 746.0) * BINS_PER_E)
    # Never NULL (as the logarithm of 0 is), so that no NULL check is planned on one side of the
    # self-join below and both sides can read the same shuffle of the counts.
    return F.coalesce(F.when(value < 0, -magnitude).otherwise(magnitude), F.lit(0))


def exact_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], by: list[str] | None = None
) -> DataFrame:
    """Per group of ``by``: one interpolated quantile per entry of ``probabilities``.

    Rows with a NULL value are left out. Output columns: ``by``, then the keys of
    ``probabilities``, then ``n`` (values) and ``mean``. Without ``by`` there is one row.
    """
    by = by or []
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_bin", _bin(F.col("_v")))
    )
    ordered = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    bins = (
        counts.groupBy(*by, "_bin")
        .agg(F.sum("_c").alias("_in_bin"), F.sum(F.col("_v") * F.col("_c")).alias("_total"))
        .select(
            *by, "_bin", "_in_bin",
            F.coalesce(F.sum("_in_bin").over(ordered), F.lit(0)).alias("_before"),
            F.sum("_in_bin").over(group).alias("_n"),
            F.sum("_total").over(group).alias("_sum"),
        )
    )

    def rank(p: float, rounding) -> Column:
        return rounding(F.lit(p) * (F.col("_n") - 1))

    def holds(start: Column, size: Column, wanted: Column) -> Column:
        return (wanted >= start) & (wanted < start + size)

    ranks = [rank(p, r) for p in probabilities.values() for r in (F.floor, F.ceil)]
    wanted_bins = bins.where(
        reduce(or_, [holds(F.col("_before"), F.col("_in_bin"), r) for r in ranks])
    )
    within = Window.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("_c").over(within), F.lit(0))
    wanted_bins = wanted_bins.select(
        *[F.col(c).alias(f"_w_{c}") for c in [*by, "_bin"]], "_before", "_n", "_sum"
    )
    same = [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in [*by, "_bin"]]
    placed = counts.join(wanted_bins, reduce(and_, same)).withColumn("_start", start)

    def at(wanted: Column) -> Column:
        return F.max(F.when(holds(F.col("_start"), F.col("_c"), wanted), F.col("_v")))

    def aliased(p: float, name: str) -> list[Column]:
        return [at(rank(p, F.floor)).alias(f"_lo_{name}"), at(rank(p, F.ceil)).alias(f"_hi_{name}")]

    picked = placed.groupBy(*by).agg(
        F.max("_n").alias("n"), (F.max("_sum") / F.max("_n")).alias("mean"),
        *[c for name, p in probabilities.items() for c in aliased(p, name)],
    )

    def interpolate(name: str, p: float) -> Column:
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        position = F.lit(p) * (F.col("n") - 1)
        return (low + (high - low) * (position - F.floor(position))).alias(name)

    return picked.select(*by, *[interpolate(n, p) for n, p in probabilities.items()], "n", "mean")
