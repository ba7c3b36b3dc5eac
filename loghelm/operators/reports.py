"""Traffic, latency, URL, visitor, status and trend reports."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loghelm.functions.agents import browser_family, os_family
from loghelm.operators.filters import Filters, apply_filters
from loghelm.operators.quantiles import exact_quantiles
from loghelm.schema import naive_time

RESOLUTIONS = ("minute", "hour", "day", "month")


def _bucket(unit: str) -> Column:
    return naive_time(F.date_trunc(unit, F.col("timestamp")))


def _hour_of_day() -> Column:
    return F.hour("timestamp").cast("bigint")


def _counted(df: DataFrame, **keys: Column) -> DataFrame:
    return df.groupBy(*[column.alias(name) for name, column in keys.items()]).agg(
        F.count("*").alias("count")
    )


def _largest(df: DataFrame, by: str, ties: list[str], n: int | None) -> DataFrame:
    """Descending by ``by``; equal values in ascending order of the keys."""
    ordered = df.orderBy(F.col(by).desc(), *[F.col(t).asc_nulls_last() for t in ties])
    return ordered if n is None else ordered.limit(n)


def _percent(hits: Column) -> Column:
    share = F.try_divide(F.sum(hits.cast("double")) * 100.0, F.count("*"))
    return F.coalesce(share, F.lit(0.0))


def traffic_summary(log: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Requests, hits (status exactly 200), distinct addresses, bytes."""
    return apply_filters(log, filters).agg(
        F.count("*").alias("total_requests"),
        F.count_if(F.col("status_code") == 200).alias("hits"),
        F.count_distinct("ip").alias("unique_visitors"),
        F.coalesce(F.sum("bytes_sent"), F.lit(0)).alias("total_bytes"),
    )


def traffic_over_time(
    log: DataFrame, resolution: str = "hour", filters: Filters | None = None
) -> DataFrame:
    """Requests, distinct addresses and bytes per bucket; an unknown resolution means hour."""
    unit = resolution if resolution in RESOLUTIONS else "hour"
    return (
        apply_filters(log, filters)
        .groupBy(_bucket(unit).alias("time_bucket"))
        .agg(
            F.count("*").alias("total_requests"),
            F.count_distinct("ip").alias("unique_visitors"),
            F.sum("bytes_sent").alias("total_bytes"),
        )
        .orderBy("time_bucket")
    )


# The reported latency quantiles.
LATENCY_QUANTILES = {
    "median_response_time": 0.50,
    "p90_response_time": 0.90,
    "p95_response_time": 0.95,
    "p99_response_time": 0.99,
}


def latency_percentiles(
    log: DataFrame, filters: Filters | None = None, approx: bool = False
) -> DataFrame:
    """Mean, median, P90, P95, P99 over the rows that carry a latency; 0 when none does.

    ``approx`` trades the exact, interpolated quantiles for one pass over the data.
    """
    timed = apply_filters(log, filters).where(F.col("response_time_ms").isNotNull())
    names = ["avg_response_time", *LATENCY_QUANTILES]
    if approx:
        found = timed.agg(
            F.avg("response_time_ms").alias("avg_response_time"),
            F.percentile_approx("response_time_ms", list(LATENCY_QUANTILES.values())).alias("q"),
        )
        found = found.select(
            "avg_response_time",
            *[F.col("q")[i].alias(name) for i, name in enumerate(LATENCY_QUANTILES)],
        )
    else:
        found = exact_quantiles(timed, "response_time_ms", LATENCY_QUANTILES)
        found = found.withColumnRenamed("mean", "avg_response_time")
    return found.select(*[F.coalesce(F.col(name), F.lit(0.0)).alias(name) for name in names])


def _endpoint_means(log: DataFrame, filters: Filters | None) -> DataFrame:
    return (
        apply_filters(log, filters)
        .where(F.col("response_time_ms").isNotNull())
        .groupBy(F.col("normalized_url").alias("url"))
        .agg(F.avg("response_time_ms").alias("avg_time"), F.count("*").alias("count"))
        .where(F.col("count") > 5)
    )


def slowest_endpoints(log: DataFrame, filters: Filters | None = None, n: int = 10) -> DataFrame:
    """Templates with more than five timed requests, slowest mean first."""
    return _largest(_endpoint_means(log, filters), "avg_time", ["url"], n)


# The quantiles shown per endpoint.
ENDPOINT_QUANTILES = {"median_time": 0.50, "p90_time": 0.90, "p95_time": 0.95, "p99_time": 0.99}


def fastest_endpoints(log: DataFrame, filters: Filters | None = None, n: int = 10) -> DataFrame:
    """Templates with more than five timed requests, fastest mean first, with quantiles.

    The top ``n`` are found from means alone; quantiles are then computed for those ``n``
    templates only. How they meet the rows is left to the planner, which sees the limit.
    """
    top = _endpoint_means(log, filters).orderBy("avg_time", F.col("url").asc_nulls_last()).limit(n)
    timed = apply_filters(log, filters).select(F.col("normalized_url").alias("url"), "response_time_ms")
    chosen = timed.join(top.select("url"), "url", "left_semi")
    spread = exact_quantiles(chosen, "response_time_ms", ENDPOINT_QUANTILES, by=["url"])
    return spread.select(
        "url", F.col("mean").alias("avg_time"), *ENDPOINT_QUANTILES, F.col("n").alias("count")
    ).orderBy("avg_time", F.col("url").asc_nulls_last())


def throughput_hourly(log: DataFrame, filters: Filters | None = None) -> DataFrame:
    total = F.sum("bytes_sent")
    return (
        apply_filters(log, filters)
        .groupBy(_bucket("hour").alias("hour_bucket"))
        .agg(total.alias("total_bytes"), (total / F.lit(3600.0)).alias("bytes_per_second"))
        .orderBy("hour_bucket")
    )


def top_urls(log: DataFrame, n: int | None = 10, normalized: bool = False,
             filters: Filters | None = None) -> DataFrame:
    column = F.col("normalized_url" if normalized else "url")
    return _largest(_counted(apply_filters(log, filters), url=column), "count", ["url"], n)


def top_ips(log: DataFrame, n: int | None = 10, filters: Filters | None = None) -> DataFrame:
    return _largest(_counted(apply_filters(log, filters), ip=F.col("ip")), "count", ["ip"], n)


def top_user_agents(log: DataFrame, n: int | None = 10, filters: Filters | None = None) -> DataFrame:
    """A missing user agent is a group of its own."""
    counted = _counted(apply_filters(log, filters), user_agent=F.col("user_agent"))
    return _largest(counted, "count", ["user_agent"], n)


def status_distribution(log: DataFrame, filters: Filters | None = None) -> DataFrame:
    counted = _counted(apply_filters(log, filters), status_code=F.col("status_code"))
    return _largest(counted, "count", ["status_code"], None)


def status_rates(log: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Percent of 200–399, 400–499 and from 500 on; 0 for an empty selection."""
    status = F.col("status_code")
    return apply_filters(log, filters).agg(
        _percent((status >= 200) & (status < 400)).alias("success_rate"),
        _percent((status >= 400) & (status < 500)).alias("client_error_rate"),
        _percent(status >= 500).alias("server_error_rate"),
    )


def error_rate(log: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Share of requests that are not status 200, in percent."""
    return apply_filters(log, filters).agg(
        F.count("*").alias("total_requests"),
        F.count_if(F.col("status_code") == 200).alias("hits"),
        _percent(~F.coalesce(F.col("status_code") == 200, F.lit(False))).alias("error_rate"),
    )


def peak_hours(log: DataFrame, n: int = 5, filters: Filters | None = None) -> DataFrame:
    counted = _counted(apply_filters(log, filters), hour=_hour_of_day())
    return _largest(counted, "count", ["hour"], n)


def peak_days(log: DataFrame, n: int = 5, filters: Filters | None = None) -> DataFrame:
    counted = _counted(apply_filters(log, filters), day=_bucket("day"))
    return _largest(counted, "count", ["day"], n)


def moving_average(log: DataFrame, filters: Filters | None = None, days: int = 7) -> DataFrame:
    """Daily requests with their trailing mean over ``days`` present days.

    The ordered window runs over one row per day.
    """
    daily = apply_filters(log, filters).groupBy(_bucket("day").alias("day")).agg(
        F.count("*").alias("daily_requests")
    )
    trailing = Window.orderBy("day").rowsBetween(-(days - 1), Window.currentRow)
    return daily.select(
        "day", "daily_requests", F.avg("daily_requests").over(trailing).alias(f"moving_avg_{days}d")
    ).orderBy("day")


def traffic_growth(log: DataFrame, as_of: str, filters: Filters | None = None) -> DataFrame:
    """Seven days up to the date ``as_of`` against the seven before; 0 if those are empty."""
    at = F.col("timestamp")
    week, fortnight = (
        F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp") for days in (7, 14)
    )
    counts = apply_filters(log, filters).where(at >= fortnight).agg(
        F.count_if(at >= week).alias("last_7d"), F.count_if(at < week).alias("prev_7d")
    )
    change = (F.col("last_7d") - F.col("prev_7d")).cast("double") * 100.0
    return counts.withColumn(
        "growth_percent", F.coalesce(F.try_divide(change, F.col("prev_7d")), F.lit(0.0))
    )


def status_by_endpoint(log: DataFrame, filters: Filters | None = None, n: int = 50) -> DataFrame:
    counted = _counted(
        apply_filters(log, filters),
        normalized_url=F.col("normalized_url"), status_code=F.col("status_code"),
    )
    return _largest(counted, "count", ["normalized_url", "status_code"], n)


def status_by_hour(log: DataFrame, filters: Filters | None = None) -> DataFrame:
    counted = _counted(apply_filters(log, filters), hour=_hour_of_day(), status_code=F.col("status_code"))
    return counted.orderBy("hour", "status_code")


def status_by_day(log: DataFrame, filters: Filters | None = None) -> DataFrame:
    counted = _counted(apply_filters(log, filters), day=_bucket("day"), status_code=F.col("status_code"))
    return counted.orderBy("day", "status_code")


def _by_agent(log: DataFrame, filters: Filters | None, name: str, family) -> DataFrame:
    # Classify each distinct user agent once instead of each request.
    agents = _counted(apply_filters(log, filters), user_agent=F.col("user_agent"))
    grouped = agents.groupBy(family(F.col("user_agent")).alias(name)).agg(F.sum("count").alias("count"))
    return _largest(grouped, "count", [name], None)


def browser_distribution(log: DataFrame, filters: Filters | None = None) -> DataFrame:
    return _by_agent(log, filters, "browser", browser_family)


def os_distribution(log: DataFrame, filters: Filters | None = None) -> DataFrame:
    return _by_agent(log, filters, "os", os_family)


# Explorer columns, and those it may be sorted by.
EXPLORER_COLUMNS = [
    "timestamp", "ip", "method", "status_code", "url", "response_time_ms", "user_agent",
]
EXPLORER_SORTS = {"timestamp", "ip", "method", "status_code", "url", "response_time_ms"}


def log_explorer(
    log: DataFrame, filters: Filters | None = None, sort_by: str = "timestamp",
    descending: bool = True, limit: int = 50, offset: int = 0, after: dict | None = None,
) -> DataFrame:
    """One page of raw rows. NULLs sort last; equal rows resolve by the other columns.

    ``after`` is the last row of the page before (its columns by name): the page starts behind
    it, and only ``limit`` rows pass a task however deep the page is. ``offset`` skips rows
    instead, all of which pass one task, so it is for the first pages.
    """
    if sort_by not in EXPLORER_SORTS:
        sort_by = "timestamp"
    order = [sort_by, *[c for c in EXPLORER_COLUMNS if c != sort_by]]
    rows = apply_filters(log, filters).select(*EXPLORER_COLUMNS)
    if after is not None:
        rows = rows.where(_behind(after, order, descending))
    first = F.col(sort_by).desc_nulls_last() if descending else F.col(sort_by).asc_nulls_last()
    return rows.orderBy(first, *[F.col(c).asc_nulls_last() for c in order[1:]]).offset(offset).limit(limit)


def _behind(row: dict, order: list[str], descending: bool) -> Column:
    """Rows that sort after ``row``: equal in the first columns, later in the next."""
    result, equal = F.lit(False), F.lit(True)
    for column in order:
        value = row[column]
        if value is not None:
            later = F.col(column) < F.lit(value) if descending and column == order[0] else F.col(column) > F.lit(value)
            result = result | (equal & F.coalesce(later, F.lit(True)))  # NULLs sort last
        equal = equal & F.col(column).eqNullSafe(F.lit(value))
    return result


def log_explorer_count(log: DataFrame, filters: Filters | None = None) -> DataFrame:
    return apply_filters(log, filters).agg(F.count("*").alias("total"))
