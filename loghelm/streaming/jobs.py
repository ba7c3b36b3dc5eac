"""Structured Streaming versions of ingest, traffic, sessions, detection and risk.

Sources are streaming frames; every stateful job takes a watermark, which bounds its
state. Sinks are files written with a checkpoint, or ``foreachBatch`` for updates.
"""

import datetime as dt
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from loghelm.operators.detectors import (
    COUNT_KEYS, COUNTING_DETECTORS, LOGIN_WORDS, PROBE_PATHS, RowRule, candidates, counts_of_candidates, findings_of_counts,
    match_rows, native_row_rules,
)
from loghelm.operators.latency_sketches import sketch_measures
from loghelm.operators.parse import entries, parse
from loghelm.operators.risk import MAX_SCORE, risk_class, severity_points
from loghelm.functions.text import contains_any
from loghelm.schema import REJECT_SCHEMA, conform
from loghelm.streaming.updates import latest_updates, write_updates  # noqa: F401

WATERMARK = "10 minutes"


def read_line_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as ``value, path``."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(folder).select("value", F.col("_metadata.file_path").alias("path"))


def parsed_stream(lines: DataFrame, format_name: str, upload_id: int, as_of: str) -> DataFrame:
    """Lines of one format as log rows of a dataset."""
    return conform(entries(parse(lines, format_name, as_of)).withColumn("upload_id", F.lit(upload_id)))


def write_log(rows: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append log rows to a table partitioned by dataset; each file lands exactly once."""
    writer = (
        rows.writeStream.format("parquet").outputMode("append").partitionBy("upload_id")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_log_and_rejects(
    lines: DataFrame, format_name: str, upload_id: int, as_of: str, log_path: str, rejects_path: str,
    checkpoint: str, available_now: bool = False,
) -> StreamingQuery:
    """Ingest a stream of lines: entries to one table, rejected lines with their file to the other.

    Both are written per batch into a folder of its own, so a repeated batch replaces itself.
    """

    def save(batch: DataFrame, number: int) -> None:
        flagged = parse(batch, format_name, as_of).withColumn("upload_id", F.lit(upload_id)).persist()
        conform(entries(flagged)).write.mode("overwrite").parquet(f"{log_path}/batch={number}")
        rejected = flagged.where(~F.col("parsed")).withColumnRenamed("value", "line")
        conform(rejected, REJECT_SCHEMA).write.mode("overwrite").parquet(f"{rejects_path}/batch={number}")
        flagged.unpersist()

    writer = lines.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def traffic_windows(
    log: DataFrame, size: str = "1 hour", slide: str | None = None, watermark: str = WATERMARK
) -> DataFrame:
    """Requests, visitors and bytes per window, updated with every batch. Visitors are approximate; ``closed_windows``
    counts them exactly. Rows older than the watermark are left out."""
    return (
        log.withWatermark("timestamp", watermark)
        .groupBy(F.window("timestamp", size, slide).alias("_w"))
        .agg(
            F.count(F.lit(1)).alias("total_requests"),
            F.approx_count_distinct("ip").alias("approx_visitors"),
            F.sum("bytes_sent").alias("total_bytes"),
        )
        .select(
            F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
            "total_requests", "approx_visitors", "total_bytes",
        )
    )


def closed_windows(
    log: DataFrame, size: str = "1 hour", slide: str | None = None, watermark: str = WATERMARK
) -> DataFrame:
    """Requests, exact visitors and bytes per window, once the watermark has passed it.

    One row per window and address is counted first, and those are counted per window; the state of both ends with
    the watermark. A visitor with most rows is one row of the second count. Rows without a dataset are marks of a time.
    """
    by_visitor = (
        log.withWatermark("timestamp", watermark)
        .groupBy(F.window("timestamp", size, slide).alias("_w"), "ip")
        .agg(F.count("upload_id").alias("hits"), F.sum("bytes_sent").alias("bytes"))
    )
    return (
        by_visitor.groupBy("_w")
        .agg(F.sum("hits").alias("total_requests"), F.count("ip").alias("visitors"), F.sum("bytes").alias("total_bytes"))
        .where("total_requests > 0")
        .select(
            F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "total_requests", "visitors", "total_bytes"
        )
    )


def latency_windows(log: DataFrame, size: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """A latency sketch per window, once the watermark has passed it; ``merge_latencies`` makes sketches of longer times."""
    windows = log.withWatermark("timestamp", watermark).groupBy(F.window("timestamp", size).alias("_w")).agg(*sketch_measures())
    return windows.where("timed_requests > 0").select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "timed_requests", "total_time", "latencies"
    )


def visitor_sessions(log: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Sessions per dataset, address and user agent, emitted once the watermark passes them."""
    return (
        log.withWatermark("timestamp", watermark)
        .groupBy(
            "upload_id", "ip", F.coalesce("user_agent", F.lit("unknown")).alias("ua_fixed"),
            F.session_window("timestamp", gap).alias("_w"),
        )
        # Marks have no status. A test of the keys would be pushed below the watermark, which marks must reach.
        .agg(F.count("status_code").alias("hits"), F.max("timestamp").alias("ended"))
        .where("hits > 0")
        .select("upload_id", "ip", "ua_fixed", F.col("_w.start").alias("started"), "ended", "hits")
    )


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sessions that a stream of ``visitor_sessions`` still holds open, in its columns, out of its checkpoint's state.

    Read after a batch they are those the stream has not emitted: with its output they make up all sessions so far.
    """
    state = spark.read.format("statestore").load(checkpoint)
    # The state's values are the keys, the session, and the buffers of the aggregates in their order.
    upload_id, ip, agent, session, hits, ended = (F.col("value")[name] for name in state.schema["value"].dataType.names)
    return state.select(
        upload_id.alias("upload_id"), ip.alias("ip"), agent.alias("ua_fixed"), session["start"].alias("started"), ended.alias("ended"), hits.alias("hits")
    ).where("hits > 0")


def with_end_marks(log: DataFrame, marks: DataFrame) -> DataFrame:
    """The stream and a second one of marks: rows without a dataset and address, of a time only.

    A mark later than the last row by the session gap and the watermark closes every session.
    """
    return log.unionByName(marks.select(*log.columns))


def write_end_mark(log_schema: T.StructType, spark: SparkSession, folder: str, at: dt.datetime) -> None:
    """Write a mark of the time ``at`` for the stream that reads ``folder``."""
    row = [at if field.name == "timestamp" else None for field in log_schema]
    nullable = T.StructType([T.StructField(field.name, field.dataType) for field in log_schema])
    spark.createDataFrame([tuple(row)], nullable).write.mode("append").parquet(folder)


def probe_alerts(log: DataFrame, size: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """Brute force and enumeration inside a window, by the thresholds and severities of the detectors, once the
    watermark has passed it. Each probed path is one row of a first count, so paths are exact; the state of both
    counts ends with the watermark."""
    candidates = log.withWatermark("timestamp", watermark).select(
        "upload_id", "ip", "timestamp", "status_code", "url",
        F.explode(F.array_compact(F.array(
            F.when(contains_any("url", LOGIN_WORDS),
                   F.struct(F.lit("brute_force").alias("alert"), F.col("url").alias("target"))),
            F.when(contains_any("url", PROBE_PATHS),
                   F.struct(F.lit("directory_enumeration").alias("alert"), F.lit("").alias("target"))),
        ))).alias("_c"),
    )
    by_path = candidates.groupBy(
        F.window("timestamp", size).alias("_w"), "upload_id", "ip",
        F.col("_c.alert").alias("alert"), F.col("_c.target").alias("target"), "url",
    ).agg(
        F.count(F.lit(1)).alias("hits"), F.count_if(F.col("status_code") == 401).alias("denied"),
        F.count_if(F.col("status_code") == 404).alias("missing"),
    )
    counted = by_path.groupBy("_w", "upload_id", "ip", "alert", "target").agg(
        F.sum("hits").alias("hits"), F.sum("denied").alias("denied"), F.sum("missing").alias("missing"), F.count("url").alias("paths"),
    )
    login = F.col("alert") == "brute_force"
    severe = F.when(login, (F.col("denied") > 20) | (F.col("hits") > 50)).otherwise(
        (F.col("paths") > 10) | (F.col("missing") > 20)
    )
    return counted.where(
        F.when(login, (F.col("hits") > 10) | (F.col("denied") > 5)).otherwise(F.col("hits") > 5)
    ).select(
        F.col("_w.start").alias("window_start"), "upload_id", "ip", "alert", "target", "hits", "denied", "missing",
        F.when(login, F.lit(1)).otherwise(F.col("paths")).alias("paths"),
        F.when(severe, "high").otherwise("medium").alias("severity"),
    )


def row_findings(log: DataFrame, rules: list[RowRule] | None = None) -> DataFrame:
    """Findings of the row detectors and ``rules``; keeps no state."""
    return match_rows(log, native_row_rules() + list(rules or []))


def running_risk(findings: DataFrame, period: str = "365 days", watermark: str = "1 day") -> DataFrame:
    """Score and class per address over the findings of a period so far (update mode).

    A period's state goes once the watermark has passed its end.
    """
    totals = findings.withWatermark("timestamp", watermark).groupBy(
        F.window("timestamp", period).alias("_w"), "ip"
    ).agg(F.sum(severity_points()).alias("score"), F.count(F.lit(1)).alias("findings"))
    risk = F.least(F.col("score"), F.lit(MAX_SCORE).cast("bigint"))
    return totals.select(F.col("_w.start").alias("period_start"), "ip", "score", risk.alias("risk_score"), risk_class(risk).alias("severity"), "findings")


def candidate_counts(log: DataFrame, period: str = "365 days", watermark: str = "1 day") -> DataFrame:
    """Counts of brute force, enumeration and scanner candidates per path and period so far (update mode).

    Paths are kept, as their number decides a severity; a period's state goes once the watermark has passed its end.
    """
    rows = candidates(log.withWatermark("timestamp", watermark), COUNTING_DETECTORS)
    counted = rows.groupBy(F.window("timestamp", period).alias("_w"), *COUNT_KEYS).agg(*counts_of_candidates())
    return counted.select(F.col("_w.start").alias("period_start"), *COUNT_KEYS, "hits", "denied", "missing", "first_seen")


def total_risk(running: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Score and class per address over all periods, from the latest rows of ``running_risk`` and, for the findings of the
    counting detectors, of ``candidate_counts``. A target's counts are summed over periods before they are judged."""
    parts = running.select("ip", "score", "findings")
    if counts is not None:
        found = findings_of_counts(counts).groupBy("ip").agg(F.sum(severity_points()).alias("score"), F.count(F.lit(1)).alias("findings"))
        parts = parts.unionByName(found)
    totals = parts.groupBy("ip").agg(F.sum("score").alias("score"), F.sum("findings").alias("findings"))
    risk = F.least(F.col("score"), F.lit(MAX_SCORE).cast("bigint"))
    return totals.select("ip", "score", risk.alias("risk_score"), risk_class(risk).alias("severity"), "findings")


def distinct_lines(log: DataFrame, keys: list[str], watermark: str = "1 day") -> DataFrame:
    """Drop rows replayed within the watermark."""
    return log.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(keys)


def run_to_files(
    result: DataFrame, path: str, checkpoint: str, mode: str = "append", keys: list[str] | None = None
) -> StreamingQuery:
    """Process what is available, write it, and return once done. With ``keys`` updates are compacted."""
    if mode == "append":
        query = (
            result.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    else:
        query = write_updates(result, path, checkpoint, mode, available_now=True, keys=keys)
    query.awaitTermination()
    return query


class LateRows(StreamingQueryListener):
    """Counts the rows that watermarks dropped, over all batches of a run.

    Add it with ``spark.streams.addListener`` before the query starts.
    """

    def __init__(self) -> None:
        self._counts: dict[str, int] = {}
        self._ended: dict[str, threading.Event] = {}

    def _end(self, run: str) -> threading.Event:
        return self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        dropped = sum(operator.numRowsDroppedByWatermark for operator in event.progress.stateOperators)
        self._counts[run] = self._counts.get(run, 0) + dropped

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def of(self, query: StreamingQuery, timeout: float = 60.0) -> int:
        """The count of an ended query. Events arrive in order, its end last."""
        run = str(query.runId)
        if not self._end(run).wait(timeout):
            raise TimeoutError(f"no event of the end of {run}")
        return self._counts.get(run, 0)
