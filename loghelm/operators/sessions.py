"""Visitor sessions: a gap longer than the timeout starts a new one.

All rows of a visitor inside one time slot no wider than the timeout belong to the same
session, because no gap between them can exceed it. So rows are first folded to one row
per visitor and slot (which combines on the map side, however hot a visitor is), and the
window that numbers sessions only ever sees slots: at most time range / timeout rows per
visitor. Filters are applied to what a session contains, never to how it is numbered.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loghelm.operators.filters import Filters

DEFAULT_TIMEOUT = 1800  # seconds
MICROS = 1_000_000


def _micros(column: str = "timestamp") -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _visitor_key(per_dataset: bool) -> list[str]:
    return (["upload_id"] if per_dataset else []) + ["ip", "ua_fixed"]


def _with_slot(log: DataFrame, width: int) -> DataFrame:
    micros = _micros()
    return log.withColumn("ua_fixed", F.coalesce("user_agent", F.lit("unknown"))).withColumn(
        "_slot", micros - F.pmod(micros, F.lit(width))
    )


def _number_slots(
    slotted: DataFrame, key: list[str], timeout: int, measures: list[Column]
) -> DataFrame:
    """One row per visitor and slot with the number of the session it belongs to."""
    slots = slotted.groupBy(*key, "_slot").agg(
        F.min(_micros()).alias("_first"), F.max(_micros()).alias("_last"), *measures
    )
    in_order = Window.partitionBy(*key).orderBy("_slot")
    previous = F.lag("_last").over(in_order)
    starts = F.when(
        F.col("_previous").isNull() | (F.col("_first") - F.col("_previous") > timeout * MICROS), 1
    ).otherwise(0)
    running = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return slots.withColumn("_previous", previous).withColumn(
        "session_id_num", F.sum(starts).over(running)
    )


def session_label(per_dataset: bool = True) -> Column:
    dataset = [F.coalesce(F.col("upload_id"), F.lit(0)).cast("string")] if per_dataset else []
    return F.concat_ws("-", *dataset, "ip", "ua_fixed", F.col("session_id_num").cast("string"))


def sessionize(
    log: DataFrame, timeout: int = DEFAULT_TIMEOUT, slot_seconds: int | None = None
) -> DataFrame:
    """Every log row with ``ua_fixed, prev_time, is_new_session, session_id_num, session_id``.

    ``slot_seconds`` (at most ``timeout``, by default a thirtieth of it) spreads a visitor over
    more tasks, so that one address behind which many clients sit is no task of its own; the
    result does not depend on it.
    """
    width = max(1, min(slot_seconds or max(1, timeout // 30), timeout) * MICROS)
    key = _visitor_key(per_dataset=True)
    slotted = _with_slot(log, width)
    numbered = _number_slots(slotted, key, timeout, []).select(
        *[F.col(c).alias(f"_{c}") for c in key], F.col("_slot").alias("_number_slot"), "_previous", "session_id_num"
    )
    same = F.col("_slot") == F.col("_number_slot")
    for c in key:  # rows without a dataset or address are a visitor as well
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = Window.partitionBy(*key, "_slot").orderBy("timestamp")
    previous = F.coalesce(
        F.lag("timestamp").over(inside), F.timestamp_micros("_previous")
    )
    gap = _micros() - _micros("prev_time")
    return (
        slotted.join(numbered, same)
        .withColumn("prev_time", previous)
        .withColumn(
            "is_new_session",
            F.when(F.col("prev_time").isNull() | (gap > timeout * MICROS), 1).otherwise(0),
        )
        .withColumn("session_id", session_label())
        .select(*log.columns, "ua_fixed", "prev_time", "is_new_session", "session_id_num", "session_id")
    )


def session_table(
    log: DataFrame,
    timeout: int = DEFAULT_TIMEOUT,
    filters: Filters | None = None,
    per_dataset: bool = True,
    pages: bool = True,
) -> DataFrame:
    """One row per session that keeps at least one row under the filter.

    Columns: visitor key, ``session_id_num``, ``hits``, ``started``, ``ended`` (micros)
    and with ``pages`` also ``entry_url`` and ``exit_url``. Equal times resolve by URL.
    """
    width = max(1, timeout * MICROS)
    key = _visitor_key(per_dataset)
    condition = filters.condition() if filters else None

    def kept(column: Column) -> Column:
        return column if condition is None else F.when(condition, column)

    visit = F.struct(_micros().alias("at"), F.col("url").alias("url"))
    measures = [
        F.count(kept(F.lit(1))).alias("_hits"),
        F.min(kept(_micros())).alias("_from"),
        F.max(kept(_micros())).alias("_to"),
    ]
    totals = [
        F.sum("_hits").alias("hits"),
        F.min("_from").alias("started"),
        F.max("_to").alias("ended"),
    ]
    if pages:
        measures += [F.min(kept(visit)).alias("_entry"), F.max(kept(visit)).alias("_exit")]
        totals += [F.min("_entry").alias("_e"), F.max("_exit").alias("_x")]
    sessions = (
        _number_slots(_with_slot(log, width), key, timeout, measures)
        .groupBy(*key, "session_id_num")
        .agg(*totals)
        .where(F.col("hits") > 0)
    )
    if pages:
        sessions = sessions.select(
            *key, "session_id_num", "hits", "started", "ended",
            F.col("_e.url").alias("entry_url"), F.col("_x.url").alias("exit_url"),
        )
    return sessions


def _seconds() -> Column:
    return (F.col("ended") - F.col("started")) / float(MICROS)


def session_summary(
    log: DataFrame, timeout: int = DEFAULT_TIMEOUT, filters: Filters | None = None
) -> DataFrame:
    """Sessions, average pages, average seconds, and addresses with more than one session."""
    per_ip = (
        session_table(log, timeout, filters, pages=False)
        .groupBy("ip")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("hits").alias("hits"),
            F.sum(F.col("ended") - F.col("started")).alias("micros"),
        )
    )
    total = F.coalesce(F.sum("n"), F.lit(0))
    return per_ip.agg(
        total.alias("total_sessions"),
        F.coalesce(F.try_divide(F.sum("hits").cast("double"), total), F.lit(0.0)).alias("avg_pages_per_session"),
        F.coalesce(F.try_divide(F.sum("micros") / float(MICROS), total), F.lit(0.0)).alias("avg_session_duration_sec"),
        F.count_if(F.col("n") > 1).alias("returning_visitors"),
    )


def numbered_sessions(log: DataFrame, timeout: int = DEFAULT_TIMEOUT) -> DataFrame:
    """Sessions over all datasets named ``s_1, s_2, …`` in order of their start.

    The global number is the number of sessions in earlier minutes plus the rank inside
    the minute, so no task orders more than one minute of starts.
    """
    minute = F.col("started") - F.pmod(F.col("started"), F.lit(60 * MICROS))
    sessions = session_table(log, timeout, per_dataset=False).withColumn("_minute", minute)
    before = Window.orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sessions.groupBy("_minute").agg(F.count(F.lit(1)).alias("_n"))
        .select("_minute", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_minute").orderBy("started", "ip", "ua_fixed", "session_id_num")
    return (
        sessions.join(offsets, "_minute")
        .withColumn("session_no", F.col("_offset") + F.row_number().over(inside))
        .select(
            F.concat(F.lit("s_"), F.col("session_no").cast("string")).alias("session_id"),
            "ip", F.col("ua_fixed").alias("user_agent"),
            F.timestamp_micros("started").alias("start_time"),
            F.timestamp_micros("ended").alias("end_time"),
            F.col("hits").alias("pages"), _seconds().alias("duration_sec"),
            "entry_url", "exit_url",
        )
    )


def session_metrics(log: DataFrame, timeout: int = DEFAULT_TIMEOUT) -> DataFrame:
    """Session count, average seconds and average pages over all datasets."""
    total = F.count(F.lit(1))
    return session_table(log, timeout, per_dataset=False, pages=False).agg(
        total.alias("total_sessions"),
        F.coalesce(F.avg(_seconds()), F.lit(0.0)).alias("avg_duration_seconds"),
        F.coalesce(F.avg("hits"), F.lit(0.0)).alias("avg_pages_per_session"),
    )


def _top_pages(sessions: DataFrame, url: str, count: str, n: int | None) -> DataFrame:
    pages = sessions.groupBy(F.col(url).alias("url")).agg(F.count(F.lit(1)).alias(count))
    ordered = pages.orderBy(F.col(count).desc(), F.col("url").asc_nulls_last())
    return ordered if n is None else ordered.limit(n)


def entry_pages(log: DataFrame, n: int | None = 10, filters: Filters | None = None,
                timeout: int = DEFAULT_TIMEOUT, per_dataset: bool = True) -> DataFrame:
    """First page of each session, counted. ``n=None`` lists all pages."""
    return _top_pages(session_table(log, timeout, filters, per_dataset), "entry_url", "count", n)


def exit_pages(log: DataFrame, n: int | None = 10, filters: Filters | None = None,
               timeout: int = DEFAULT_TIMEOUT, per_dataset: bool = True) -> DataFrame:
    """Last page of each session, counted."""
    return _top_pages(session_table(log, timeout, filters, per_dataset), "exit_url", "count", n)


def landing_pages(log: DataFrame, n: int | None = 10, filters: Filters | None = None,
                  timeout: int = DEFAULT_TIMEOUT) -> DataFrame:
    """Landing pages are entry pages."""
    return entry_pages(log, n, filters, timeout)


def bounce_pages(log: DataFrame, n: int | None = 10, filters: Filters | None = None,
                 timeout: int = DEFAULT_TIMEOUT) -> DataFrame:
    """Pages of the sessions that hold exactly one row."""
    single = session_table(log, timeout, filters).where(F.col("hits") == 1)
    return _top_pages(single, "entry_url", "bounce_count", n)
