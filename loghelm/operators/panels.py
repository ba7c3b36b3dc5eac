"""Panel reports (days, hours, requests, hosts, status codes, browsers, systems, totals)
in one long table, and their merging.

A visitor is a distinct combination of address, user agent and day.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.functions.agents import browser_family, os_family
from loghelm.operators.filters import Filters, apply_filters

# Panel names, and the external report format of each log format.
PANELS = ["visitors", "hours", "requests", "hosts", "status_codes", "browsers", "os", "general"]
REPORT_FORMAT = {
    "apache_access": "COMBINED",
    "nginx_access": "COMBINED",
    "clf": "COMMON",
    "iis_w3c": "W3C",
}
TOTAL_KEY = "total"


VISITOR = ["ip", "user_agent", "day"]


def _facet_rows(log: DataFrame, by: list[str]) -> DataFrame:
    """Each row under the facets whose keys vary within a visitor: hour, URL and status,
    and once under the visitor alone, from which the other panels follow."""
    based = log.select(
        *by, "ip", "user_agent", "url", "status_code", "bytes_sent",
        F.date_format("timestamp", "yyyy-MM-dd").alias("day"), F.date_format("timestamp", "HH").alias("hour"),
    )
    facets = {
        "hours": F.col("hour"), "requests": F.col("url"),
        "status_codes": F.col("status_code").cast("string"), "visitor": F.lit(None).cast("string"),
    }
    keyed = F.array(*[F.struct(F.lit(n).alias("panel"), k.alias("key")) for n, k in facets.items()])
    return based.select(*by, *VISITOR, "bytes_sent", F.explode(keyed).alias("_p")).select(
        *by, *VISITOR, "bytes_sent", "_p.panel", "_p.key"
    )


def _panels_of_visitor() -> Column:
    agent = F.col("user_agent")
    keys = {
        "visitors": F.col("day"), "hosts": F.col("ip"), "browsers": browser_family(agent),
        "os": os_family(agent), "general": F.lit(TOTAL_KEY),
    }
    spread = F.array(*[F.struct(F.lit(n).alias("panel"), k.alias("key")) for n, k in keys.items()])
    own = F.array(F.struct(F.col("panel"), F.col("key")))
    return F.when(F.col("panel") == "visitor", spread).otherwise(own)


def _per_visitor(log: DataFrame, by: list[str]) -> DataFrame:
    """One row per panel, key and visitor with ``hits`` and ``bytes``."""
    counted = _facet_rows(log, by).groupBy(*by, "panel", "key", *VISITOR).agg(
        F.count(F.lit(1)).alias("hits"), F.sum("bytes_sent").alias("bytes")
    )
    return counted.select(
        *by, *VISITOR, "hits", "bytes", F.explode(_panels_of_visitor()).alias("_p")
    ).select(*by, *VISITOR, "hits", "bytes", "_p.panel", "_p.key")


def panel_report(log: DataFrame, filters: Filters | None = None, by: list[str] | None = None) -> DataFrame:
    """``panel, key, hits, visitors, bytes``, a separate report per group of ``by``.

    One scan. Rows are first counted per key and visitor, which combines on the map side
    and spreads even the totals over all visitors; visitors are then counted per key.
    """
    by = by or []
    return _per_visitor(apply_filters(log, filters), by).groupBy(*by, "panel", "key").agg(
        F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("visitors"), F.sum("bytes").alias("bytes")
    )


def _visitor_hash() -> Column:
    # xxhash64 skips NULLs; the marker keeps a missing agent apart from an empty one.
    return F.xxhash64("ip", F.coalesce(F.col("user_agent"), F.lit("\u0000")), "day")


def panel_sketches(log: DataFrame, filters: Filters | None = None, by: list[str] | None = None) -> DataFrame:
    """A panel report whose ``visitors`` is an HLL sketch, so that merging does not
    count a visitor of two reports twice.

    Sketches are built from the rows and combined on the map side; only they are shuffled.
    """
    by = by or []
    rows = _facet_rows(apply_filters(log, filters), by).select(
        *by, *VISITOR, "bytes_sent", F.explode(_panels_of_visitor()).alias("_p")
    ).select(*by, *VISITOR, F.col("bytes_sent").alias("bytes"), "_p.panel", "_p.key")
    return rows.groupBy(*by, "panel", "key").agg(
        F.count(F.lit(1)).alias("hits"),
        F.hll_sketch_agg(_visitor_hash(), 14).alias("visitors"),
        F.sum("bytes").alias("bytes"),
    )


def _by_key(rows: DataFrame, visitors: Column) -> DataFrame:
    return rows.where(F.col("key").isNotNull() & (F.col("key") != "")).groupBy("panel", "key").agg(
        F.sum("hits").alias("hits"), visitors.alias("visitors"), F.sum("bytes").alias("bytes")
    )


def sort_panels(report: DataFrame) -> DataFrame:
    return report.orderBy("panel", F.col("hits").desc(), "key")


def merge_rows(rows: DataFrame) -> DataFrame:
    """Add up the rows of several reports per panel and key; rows without a key drop out.

    Visitors are added as well, so one that is in two reports counts twice.
    """
    return _by_key(rows, F.sum("visitors"))


def merge_sketches(rows: DataFrame) -> DataFrame:
    """The same for sketch reports; visitors are estimated over the union."""
    return _by_key(rows, F.hll_sketch_estimate(F.hll_union_agg("visitors")))


def merge_reports(reports: list[DataFrame]) -> DataFrame | None:
    """None without a report; a single report stays as it is."""
    if len(reports) < 2:
        return reports[0] if reports else None
    return merge_rows(reduce(DataFrame.unionByName, reports))


def write_report(report: DataFrame, path: str) -> None:
    """One JSON file set per panel."""
    report.write.mode("overwrite").partitionBy("panel").json(path)


def files_by_format(datasets: DataFrame) -> DataFrame:
    """Per report format: files to process, or the reason files are skipped."""
    target = F.create_map(*[F.lit(x) for pair in REPORT_FORMAT.items() for x in pair])
    report = F.try_element_at(target, F.col("format"))
    return (
        datasets.withColumn("report_format", report)
        .withColumn("outcome", F.when(report.isNotNull(), "processed").otherwise("skipped"))
        .withColumn(
            "reason",
            F.when(report.isNull(), F.concat(F.lit("Unsupported format: "), F.coalesce("format", F.lit("")))),
        )
        .groupBy("report_format", "outcome", "reason")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("total_entries").alias("entries"))
        .orderBy(F.col("report_format").asc_nulls_last(), "reason")
    )
