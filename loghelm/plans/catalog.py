"""Named queries over a folder of Parquet tables, one per operator."""

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loghelm.functions.agents import bot_class
from loghelm.functions.urls import percent_decode, target_path, target_query, url_template
from loghelm.operators import detectors, latency_sketches, panels, reports, risk, sessions
from loghelm.operators import parse as p
from loghelm.operators.detect_format import detect_formats, sample_lines
from loghelm.operators.filters import Filters, apply_filters
from loghelm.operators.rule_pack import default_pack
from loghelm.operators.sigma import compile_pack, sigma_by_rule, sigma_findings, with_rule_text
from loghelm.schema import DATASET_SCHEMA, conform
from loghelm.session import prepare_session, scratch_dir
from loghelm.sources.access_view import read_access_log, request_rows, with_classes
from loghelm.sources.datasets import LogStore, files_to_import, inventory, scan_counts
from loghelm.sources.lines import read_lines
from loghelm.sources.render import line, render
from loghelm.streaming import jobs
from loghelm.streaming.moving import moving_risk, rocksdb_state

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = "2024-01-25"
LONG_TIMEOUT = 43_200
SOME_DAYS = {"start_date": "2024-01-05 06:00:00", "end_date": "2024-01-20"}


def plain(df: DataFrame) -> DataFrame:
    """Results in types any reader shares: zone-free times, long integers, joined lists,
    and floating-point numbers to six digits."""

    def shown(field: T.StructField):
        column = F.col(field.name)
        match field.dataType:
            case T.TimestampType():
                column = column.cast("timestamp_ntz")
            case T.IntegerType():
                column = column.cast("bigint")
            case T.DoubleType() | T.FloatType():
                column = F.round(column.cast("double"), 6)
            case T.DecimalType():
                column = F.round(column.cast("double"), 6)
            case T.ArrayType():
                column = F.array_join(column, " | ")
        return column.alias(field.name)

    return df.select(*[shown(f) for f in df.schema])


def _log_query(build: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        return plain(build(read_access_log(prepare_session(spark), directory)))

    return run


def _query(build: Callable[[SparkSession, str], DataFrame]) -> Query:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        return plain(build(prepare_session(spark), directory))

    return run


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


# --- parsing: render the log to lines of a format, parse them back ---------------------

ENTRY_COLUMNS = [
    "upload_id", "timestamp", "ip", "method", "url", "query_string", "status_code", "bytes_sent",
    "response_time_ms", "user_agent", "host", "protocol", "normalized_url", "bot_classification",
]


def _round_trip(rendered_as: str, parser: str | None = None) -> Query:
    def build(log: DataFrame) -> DataFrame:
        lines = render(log, rendered_as)
        if rendered_as == "json":
            parsed = p.parse_json(lines, AS_OF)
        else:
            parsed = p.parse(lines, parser or rendered_as, AS_OF)
        return p.entries(parsed).select(*ENTRY_COLUMNS)

    return _log_query(build)


def _mixed_lines(log: DataFrame) -> DataFrame:
    """Common-format lines, with IIS lines, which do not parse as common, for one dataset."""
    value = F.when(F.col("upload_id") == 3, line("iis_w3c")).otherwise(line("clf"))
    return log.select("upload_id", value.alias("value"))


def _parse_stats(log: DataFrame) -> DataFrame:
    return p.parse_stats(p.parse_lines(_mixed_lines(log), "clf"), ["upload_id"])


def _quarantine(log: DataFrame) -> DataFrame:
    return p.quarantine(p.parse_lines(_mixed_lines(log), "clf"))


def _labelled_lines(log: DataFrame) -> DataFrame:
    """Every row as a line of each format, the format and dataset being the file."""
    formats = F.array(*[
        F.struct(F.lit(name).alias("name"), line(name).alias("value")) for name in p.FORMATS
    ])
    exploded = log.select("upload_id", "timestamp", "ip", F.explode(formats).alias("_l"))
    return exploded.select(
        F.concat_ws("-", "_l.name", F.col("upload_id").cast("string")).alias("file"),
        F.struct("timestamp", "ip").alias("position"), "_l.value",
    )


def _detect_sample(log: DataFrame) -> DataFrame:
    return detect_formats(sample_lines(_labelled_lines(log), "file", "position"), "file")


def _parse_separators(log: DataFrame) -> DataFrame:
    """Lines whose agent and tail hold U+0085, U+2028 and U+2029."""
    lines = render(log, "apache_access").select(
        F.concat(F.replace("value", F.lit("/"), F.lit("/")), F.lit(" \u2028tail\u0085\u2029")).alias("value")
    )
    lines = lines.select(F.replace("value", F.lit("Mozilla"), F.lit("Moz\u2028illa")).alias("value"))
    return p.parse_lines(lines, "apache_access").where("parsed").groupBy("status_code").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.contains("user_agent", F.lit("\u2028"))).alias("agents"), F.sum("bytes_sent").alias("bytes")
    )


def _detect_whole(log: DataFrame) -> DataFrame:
    return detect_formats(_labelled_lines(log), "file")


# --- sources and datasets -------------------------------------------------------------

CODECS = {1: "none", 2: "gzip", 3: "bzip2"}
DATASET_FORMATS = {1: "apache_access", 2: "nginx_access", 3: "iis_w3c"}


def _src_text(spark: SparkSession, directory: str) -> DataFrame:
    log, folder = read_access_log(spark, directory), scratch_dir(spark, "lines")
    for upload_id, codec in CODECS.items():
        rows = render(log.where(F.col("upload_id") == upload_id), "clf").select("value")
        rows.write.option("compression", codec).text(f"{folder}/{codec}")
    parsed = p.parse_lines(read_lines(spark, folder, recursive=True), "clf")
    codec = F.element_at(F.split("path", "/"), -2)
    return parsed.groupBy(codec.alias("codec")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("bytes_sent").alias("bytes")
    )


def _ingested(spark: SparkSession, directory: str) -> LogStore:
    """A store with files of three formats, each with some lines at its end that no format takes."""
    log, folder = read_access_log(spark, directory), scratch_dir(spark, "ingest")
    for upload_id in DATASET_FORMATS:
        _write_raw(log, upload_id, folder)
    store = LogStore(spark, f"{folder}/store")
    store.ingest_folder(f"{folder}/raw", AS_OF)
    return store


# Log rows of a file that is written for ingest, about: a larger log has more files of a format, as one that rotates does.
FILE_ROWS = 500_000


def _write_raw(log: DataFrame, upload_id: int, folder: str, name: str | None = None) -> None:
    """Write a dataset's lines to files below ``raw``: first those of its format, by time, then its bad ones.

    Rows of one second and address share a file, so that no two files are equal; their lines are fully ordered, so
    that what is written again is the same byte by byte.
    """
    mine, form = log.where(F.col("upload_id") == upload_id), DATASET_FORMATS[upload_id]
    files = max(1, -(-mine.count() // FILE_ROWS))
    lines = F.array(F.struct(F.lit(0).alias("bad"), line(form).alias("value")), F.struct(F.lit(1).alias("bad"), F.when(_is_bad(), _bad_line()).alias("value")))
    second = F.date_trunc("second", "timestamp")
    dealt = mine.select(second.alias("second"), "ip", F.explode(lines).alias("l")).select("second", "ip", "l.*")
    dealt = dealt.where("bad = 0 OR value IS NOT NULL").repartition(files, "second", "ip")
    dealt.sortWithinPartitions("bad", "second", "ip", "value").select("value").write.text(f"{folder}/raw/{name or form}")


def _is_bad() -> Column:
    return F.col("bytes_sent") % 7 == 0


def _bad_line() -> Column:
    return F.concat(F.lit("?? "), "ip", F.lit(" "), F.col("bytes_sent").cast("string"))


def _bad_lines(log: DataFrame) -> DataFrame:
    return log.where(_is_bad()).select(_bad_line().alias("value"))


def _ingest_summary(spark: SparkSession, directory: str) -> DataFrame:
    return _store_summary(_ingested(spark, directory))


def _store_summary(store: LogStore) -> DataFrame:
    facts = store.log().groupBy("upload_id").agg(
        F.count_if(F.col("status_code") == 200).alias("ok"), F.sum("bytes_sent").alias("bytes"),
        F.count("response_time_ms").alias("timed"),
    )
    data_files = store.datasets().where(F.col("total_entries") > 0)
    return data_files.join(facts, F.col("id") == F.col("upload_id")).groupBy("format").agg(
        F.sum("parsed_lines").alias("parsed_lines"), F.sum("rejected_lines").alias("rejected_lines"),
        F.min("confidence").alias("confidence"),
        F.sum("ok").alias("ok"), F.sum("bytes").alias("bytes"), F.sum("timed").alias("timed"),
    )


def _ingest_rejects(spark: SparkSession, directory: str) -> DataFrame:
    store = _ingested(spark, directory)
    formats = store.datasets().select(F.col("id").alias("upload_id"), "format")
    return store.rejects().join(formats, "upload_id").select("format", "line")


def _document_files(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files, and as registry the content of two sources."""
    documents = _table(spark, directory, "documents").select(
        F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"),
        F.length("text").alias("length"), F.sha2("text", 256).alias("checksum"), "source",
    )
    known = documents.where(F.col("source").isin("src0", "src1")).select("checksum")
    return documents.drop("source"), known


def _folder_scan(spark: SparkSession, directory: str) -> DataFrame:
    return scan_counts(*_document_files(spark, directory))


def _dedup_files(spark: SparkSession, directory: str) -> DataFrame:
    return files_to_import(*_document_files(spark, directory)).select("path", "length", "checksum")


def _registry(log: DataFrame) -> DataFrame:
    number = F.col("id").cast("string")
    made = log.groupBy(F.col("upload_id").alias("id")).agg(F.count(F.lit(1)).alias("total_entries"))
    formats = F.when(F.col("id") == 1, "apache_access").when(F.col("id") == 2, "clf").otherwise("nginx_error")
    return conform(
        made.select(
            "id", F.concat(F.lit("access-"), number, F.lit(".log")).alias("filename"),
            formats.alias("format"), "total_entries",
        ),
        DATASET_SCHEMA,
    )


def _datasets_inventory(log: DataFrame) -> DataFrame:
    return inventory(log, _registry(log)).select(
        "upload_id", "filename", "format", "entries", "first_seen", "last_seen", "unique_ips"
    )


def _dataset_delete(spark: SparkSession, directory: str) -> DataFrame:
    log = read_access_log(spark, directory)
    store = LogStore(spark, scratch_dir(spark, "delete"))
    store.append(log)
    store.register(_registry(log))
    store.delete(2)
    kept = store.log().groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("bytes_sent").alias("bytes")
    )
    names = store.datasets().select(F.col("id").alias("upload_id"), "filename")
    return kept.join(names, "upload_id")


def _date_range_store(spark: SparkSession, directory: str) -> DataFrame:
    """The range of dates on the stored log, which reads the folders of those days."""
    store = LogStore(spark, scratch_dir(spark, "by-day"))
    store.append(read_access_log(spark, directory))
    return apply_filters(store.log(), Filters(**SOME_DAYS)).select(*BASE_COLUMNS)


# --- enrichment -----------------------------------------------------------------------


def _url_decode(spark: SparkSession, directory: str) -> DataFrame:
    """Page addresses percent-encoded byte by byte at their separators, then decoded."""
    encoded = F.col("url")
    for raw, code in (("%", "%25"), ("/", "%2F"), ("=", "%3d"), (":", "%3A")):
        encoded = F.replace(encoded, F.lit(raw), F.lit(code))
    target = F.concat(encoded, F.lit("?a+b%20c%zz"))
    return _table(spark, directory, "pages").select(
        "page_id", percent_decode(target_path(target)).alias("path"),
        percent_decode(target_query(target)).alias("query"),
    )


def _url_template(spark: SparkSession, directory: str) -> DataFrame:
    return _table(spark, directory, "pages").select("page_id", url_template(F.col("url")).alias("template"))


def _bot_class(spark: SparkSession, directory: str) -> DataFrame:
    """Classes of the log's user agents, and of every document's text as an agent."""
    agents = read_access_log(spark, directory).select(F.lit("log").alias("origin"), "user_agent")
    texts = _table(spark, directory, "documents").select(
        F.lit("documents").alias("origin"), F.col("text").alias("user_agent")
    )
    return agents.unionByName(texts).groupBy("origin", bot_class("user_agent").alias("class")).agg(
        F.count(F.lit(1)).alias("count")
    )


# --- filters --------------------------------------------------------------------------

BASE_COLUMNS = ["upload_id", "timestamp", "ip", "url", "status_code", "bytes_sent"]


def _filtered(**values) -> Query:
    return _log_query(lambda log: apply_filters(log, Filters(**values)).select(*BASE_COLUMNS))


SOME_FILTERS = {
    "start_date": "2024-01-05", "end_date": "2024-01-20", "status_code": 200,
    "user_agent": "Mozilla", "bot_classification": "human",
}


def _sessions_null_keys(log: DataFrame) -> DataFrame:
    """Sessions where every third address and every fifth status belong to no dataset or no address."""
    blank = log.withColumn("upload_id", F.when(F.col("bytes_sent") % 3 != 0, F.col("upload_id"))).withColumn(
        "ip", F.when(F.col("bytes_sent") % 5 != 0, F.col("ip"))
    )
    return sessions.sessionize(blank).select("upload_id", "ip", "timestamp", "ua_fixed", "is_new_session", "session_id_num")


# --- detection ------------------------------------------------------------------------


def _findings(log: DataFrame) -> DataFrame:
    return detectors.all_findings(log, default_pack().rules)


def _row_query(rule: Callable[[], detectors.RowRule]) -> Query:
    return _log_query(lambda log: detectors.match_rows(log, [rule()]))


def _sigma_findings(log: DataFrame) -> DataFrame:
    pack = default_pack()
    return with_rule_text(sigma_findings(log, pack), pack.rules)


NETWORK_RULE = {
    "id": "v6", "title": "IPv6 networks", "level": "low",
    "detection": {"near": {"src_ip|cidr": ["fd00:10::/27", "2001:db8:0:40::/58"]}, "condition": "near"},
}


def _sigma_cidr6(log: DataFrame) -> DataFrame:
    """The log with its IPv4 addresses written as IPv6 ones, short and long in turn."""
    octets = F.split("ip", r"\.")
    short = F.concat(F.lit("fd00:"), F.lower(F.hex(octets[3].cast("int"))), F.lit("::1"))
    long = F.concat(F.lit("2001:0DB8:0000:"), F.lpad(F.hex(octets[3].cast("int")), 4, "0"), F.lit(":0:0:0:"), octets[2])
    v6 = F.when(octets[3].cast("int") % 2 == 0, short).otherwise(long)
    return sigma_findings(log.withColumn("ip", v6), compile_pack([NETWORK_RULE]))


SELECTION_RULE = {
    "id": "selection", "title": "Selection", "level": "low",
    "detection": {
        "posts": {
            "cs-method": "post", "sc-status": [200, 302, 500], "c-useragent|contains": ["CURL", "sqlmap"],
            "c-uri|startswith": ["/sign", "/pur"], "cs-uri-query|endswith": ["0", "4", "8"],
        },
        "condition": "posts",
    },
}
KEYWORD_RULE = {
    "id": "keywords", "title": "Keywords", "level": "low",
    "detection": {"keywords": ["etc/passwd", "<SCRIPT>", "Googlebot", "union * password"], "condition": "keywords"},
}
CONDITION_RULES = [
    {
        "id": "groups", "title": "Groups", "level": "low",
        "detection": {
            "selection_url": {"url|contains": "/click/"},
            "selection_status": {"sc-status": 200},
            "other_agent": [{"c-useragent|startswith": "curl"}, {"c-useragent": None}],
            "filter_main_low": {"cs-uri-query|re": "^k=[0-9]$"},
            "filter_main_host": {"cs-host|endswith": ".example.com"},
            "condition": "(all of selection_* or 1 of other*) and not 1 of filter_main_*",
        },
    },
    {
        "id": "network", "title": "Network", "level": "medium",
        "detection": {
            "near": {"src_ip|cidr": ["10.0.0.0/28", "10.0.0.64/27"]},
            "both": {"cs-uri-query|contains|all": ["id=", "password"]},
            "condition": "near and not both or all of both*",
        },
    },
]


def _pack_query(rules: list[dict]) -> Query:
    return _log_query(lambda log: sigma_findings(log, compile_pack(rules)))


# --- streaming ------------------------------------------------------------------------


def _log_stream(spark: SparkSession, directory: str) -> DataFrame:
    schema = _table(spark, directory, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{directory}/events*.parquet")
    return with_classes(request_rows(events))


def _appended(spark: SparkSession, result: DataFrame, purpose: str) -> DataFrame:
    folder = scratch_dir(spark, purpose)
    jobs.run_to_files(result, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(result.schema).parquet(f"{folder}/out")


def _updated(spark: SparkSession, result: DataFrame, keys: list[str], purpose: str) -> DataFrame:
    folder = scratch_dir(spark, purpose)
    jobs.run_to_files(result, f"{folder}/out", f"{folder}/checkpoint", mode="update")
    return jobs.latest_updates(spark, f"{folder}/out", keys)


def _stream_ingest(spark: SparkSession, directory: str) -> DataFrame:
    folder = scratch_dir(spark, "stream-ingest")
    log = read_access_log(spark, directory)
    render(log, "apache_access").select("value").write.text(f"{folder}/raw")
    rows = jobs.parsed_stream(jobs.read_line_stream(spark, f"{folder}/raw"), "apache_access", 7, AS_OF)
    jobs.write_log(rows, f"{folder}/log", f"{folder}/checkpoint", available_now=True).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/log").select(*ENTRY_COLUMNS)


def _stream_folder_ingest(spark: SparkSession, directory: str) -> DataFrame:
    """Files of one format, then files of others along with a copy of the first, each time one trigger or more."""
    log, folder = read_access_log(spark, directory), scratch_dir(spark, "stream-folder")
    store = LogStore(spark, f"{folder}/store")
    first, *others = DATASET_FORMATS

    def run() -> None:
        store.ingest_stream(f"{folder}/raw", AS_OF, f"{folder}/checkpoint", available_now=True).awaitTermination()

    _write_raw(log, first, folder)
    run()
    for upload_id in others:
        _write_raw(log, upload_id, folder)
    _write_raw(log, first, folder, "again")
    run()
    return _store_summary(store)


def _stream_rejects(spark: SparkSession, directory: str) -> DataFrame:
    folder = scratch_dir(spark, "stream-rejects")
    log = read_access_log(spark, directory)
    render(log, "clf").select("value").unionByName(_bad_lines(log)).write.text(f"{folder}/raw")
    jobs.write_log_and_rejects(
        jobs.read_line_stream(spark, f"{folder}/raw"), "clf", 7, AS_OF, f"{folder}/log", f"{folder}/rejected",
        f"{folder}/checkpoint", available_now=True,
    ).awaitTermination()
    stored = spark.read.parquet(f"{folder}/log").select(F.lit("entries").alias("kind"), F.lit("").alias("line"))
    rejected = spark.read.parquet(f"{folder}/rejected").select(F.lit("rejected").alias("kind"), "line")
    return stored.unionByName(rejected).groupBy("kind", "line").agg(F.count(F.lit(1)).alias("lines"))


def _closed(
    spark: SparkSession, directory: str, job: Callable[[DataFrame], DataFrame], purpose: str, after: dt.timedelta = dt.timedelta(days=1)
) -> DataFrame:
    """What a job appends over the log, and once more with a mark that closes what is open."""
    folder = scratch_dir(spark, purpose)
    log = _log_stream(spark, directory)
    plain_log = read_access_log(spark, directory)
    plain_log.limit(0).write.parquet(f"{folder}/marks")

    def run() -> DataFrame:
        marks = spark.readStream.schema(log.schema).parquet(f"{folder}/marks")
        result = job(jobs.with_end_marks(log, marks))
        jobs.run_to_files(result, f"{folder}/out", f"{folder}/checkpoint")
        return spark.read.schema(result.schema).parquet(f"{folder}/out")

    run()
    last = plain_log.agg(F.max("timestamp")).first()[0]
    if last is not None:
        jobs.write_end_mark(log.schema, spark, f"{folder}/marks", last + after)
    return run()


def _stream_traffic(spark: SparkSession, directory: str) -> DataFrame:
    return _closed(spark, directory, jobs.closed_windows, "stream-traffic")


def _stream_sliding(spark: SparkSession, directory: str) -> DataFrame:
    sliding = _closed(spark, directory, lambda log: jobs.closed_windows(log, "2 hours", "1 hour"), "stream-sliding")
    return sliding.select("window_start", "total_requests", "visitors", "total_bytes")


def _stream_sessions(spark: SparkSession, directory: str) -> DataFrame:
    return _closed(spark, directory, jobs.visitor_sessions, "stream-sessions")


def _stream_open_sessions(spark: SparkSession, directory: str) -> DataFrame:
    """All sessions, without an end mark: those the stream has closed, and those its state holds open."""
    folder = scratch_dir(spark, "stream-open")
    result = jobs.visitor_sessions(_log_stream(spark, directory))
    jobs.run_to_files(result, f"{folder}/out", f"{folder}/checkpoint")
    closed = spark.read.schema(result.schema).parquet(f"{folder}/out").withColumn("is_open", F.lit(False))
    return closed.unionByName(jobs.open_sessions(spark, f"{folder}/checkpoint").withColumn("is_open", F.lit(True)))


def _stream_latency(spark: SparkSession, directory: str) -> DataFrame:
    """Sketches of the stream's hours, merged by day, with whether their quantiles are close to the exact ones."""
    hours = _closed(spark, directory, jobs.latency_windows, "stream-latency").withColumn("day", F.date_trunc("day", "window_start"))
    return _checked_sketches(hours, read_access_log(spark, directory).withColumn("day", F.date_trunc("day", "timestamp")), "day")


def _stream_alerts(spark: SparkSession, directory: str) -> DataFrame:
    return _closed(spark, directory, lambda log: jobs.probe_alerts(log, size="7 days"), "stream-alerts", dt.timedelta(days=8))


def _stream_findings(spark: SparkSession, directory: str) -> DataFrame:
    found = jobs.row_findings(_log_stream(spark, directory), default_pack().rules)
    return _appended(spark, found, "stream-findings")


def _running_risk(spark: SparkSession, directory: str) -> DataFrame:
    found = jobs.row_findings(_log_stream(spark, directory), default_pack().rules)
    return _updated(spark, jobs.running_risk(found), ["period_start", "ip"], "stream-risk")


def _stream_ip_risk(spark: SparkSession, directory: str) -> DataFrame:
    """Of row findings, as its SQL."""
    return jobs.total_risk(_running_risk(spark, directory))


def _stream_ip_risk_all(spark: SparkSession, directory: str) -> DataFrame:
    """Of all findings, as ``ip_risk``."""
    counts = jobs.candidate_counts(_log_stream(spark, directory))
    latest = _updated(spark, counts, ["period_start", *detectors.COUNT_KEYS], "stream-counts")
    return jobs.total_risk(_running_risk(spark, directory), latest)


def _stream_ip_risk_window(spark: SparkSession, directory: str) -> DataFrame:
    """Row findings of the last seven days of the log."""
    found = jobs.row_findings(_log_stream(spark, directory), default_pack().rules)
    with rocksdb_state(spark):
        latest = _updated(spark, moving_risk(found, dt.timedelta(days=7)), ["ip"], "stream-moving")
    return latest.where("score > 0")


def _stream_dedup(spark: SparkSession, directory: str) -> DataFrame:
    """Every request twice, as if replayed, must come out once."""
    twice = _log_stream(spark, directory).unionByName(_log_stream(spark, directory))
    keys = ["upload_id", "ip", "user_agent", "timestamp", "url"]
    return _appended(spark, jobs.distinct_lines(twice, keys), "stream-dedup").select(*BASE_COLUMNS)


def _merged_sketches(log: DataFrame) -> DataFrame:
    """Merged sketch reports, with whether each estimate is within 3 % (or 2) of the exact count."""
    merged = panels.merge_sketches(panels.panel_sketches(log, by=["upload_id"]).drop("upload_id"))
    exact = panels.panel_report(log).select("panel", "key", F.col("visitors").alias("exact"))
    close = F.abs(F.col("visitors") - F.col("exact")) <= F.greatest(F.lit(2.0), F.col("exact") * 0.03)
    return merged.join(exact, ["panel", "key"]).select("panel", "key", "hits", "bytes", close.alias("visitors_close"))


def _checked_sketches(parts: DataFrame, log: DataFrame, key: str) -> DataFrame:
    merged = latency_sketches.sketched_quantiles(latency_sketches.merge_latencies(parts, [key]))
    close = latency_sketches.within_rank_error(merged, log, [key])
    return merged.select(key, "timed_requests", "avg_response_time").join(close, key)


def _latency_merge_kll(log: DataFrame) -> DataFrame:
    """Reports of a dataset's days, merged over the days."""
    dated = log.withColumn("day", F.date_trunc("day", "timestamp"))
    return _checked_sketches(latency_sketches.latency_sketches(dated, ["upload_id", "day"]), log, "upload_id")


def _merged_by_dataset(build: Callable, merge: Callable) -> Query:
    return _log_query(lambda log: merge(build(log, by=["upload_id"]).drop("upload_id")))


QUERIES: dict[str, Query] = {
    "traffic_hour": _log_query(lambda log: reports.traffic_over_time(log, "hour")),
    "traffic_summary": _log_query(reports.traffic_summary),
    "traffic_minute": _log_query(lambda log: reports.traffic_over_time(log, "minute")),
    "traffic_day": _log_query(lambda log: reports.traffic_over_time(log, "day")),
    "traffic_month": _log_query(lambda log: reports.traffic_over_time(log, "month")),
    "latency_percentiles": _log_query(reports.latency_percentiles),
    "slowest_endpoints": _log_query(reports.slowest_endpoints),
    "fastest_endpoints": _log_query(reports.fastest_endpoints),
    "throughput_hourly": _log_query(reports.throughput_hourly),
    "top_urls": _log_query(reports.top_urls),
    "top_urls_normalized": _log_query(lambda log: reports.top_urls(log, normalized=True)),
    "top_ips": _log_query(reports.top_ips),
    "top_user_agents": _log_query(reports.top_user_agents),
    "status_distribution": _log_query(reports.status_distribution),
    "status_rates": _log_query(reports.status_rates),
    "error_rate": _log_query(reports.error_rate),
    "peak_hours": _log_query(reports.peak_hours),
    "peak_days": _log_query(reports.peak_days),
    "moving_avg_7d": _log_query(reports.moving_average),
    "traffic_growth": _log_query(lambda log: reports.traffic_growth(log, AS_OF)),
    "status_by_endpoint": _log_query(reports.status_by_endpoint),
    "status_by_hour": _log_query(reports.status_by_hour),
    "status_by_day": _log_query(reports.status_by_day),
    "browser_dist": _log_query(reports.browser_distribution),
    "os_dist": _log_query(reports.os_distribution),
    "log_explorer": _log_query(
        lambda log: reports.log_explorer(log, Filters(upload_id=2), "response_time_ms", True, 50, 20)
    ),
    "log_explorer_count": _log_query(lambda log: reports.log_explorer_count(log, Filters(upload_id=2))),
    "filter_dataset": _filtered(dataset_id=2),
    "filter_date_range": _filtered(**SOME_DAYS),
    "filter_date_range_store": _query(_date_range_store),
    "filter_equality": _filtered(
        ip="10.0.0.8", status_code=200, bot_classification="human", normalized_url="/view/{id}"
    ),
    "filter_ua": _filtered(user_agent="Mozilla/5.0 (Mac"),
    "filter_combined": _filtered(**SOME_FILTERS),
    "summary_filtered": _log_query(lambda log: reports.traffic_summary(log, Filters(**SOME_FILTERS))),
    "sessions": _log_query(
        lambda log: sessions.sessionize(log).select(
            "upload_id", "ip", "timestamp", "url", "ua_fixed", "prev_time",
            "is_new_session", "session_id_num", "session_id",
        )
    ),
    "sessions_null_keys": _log_query(_sessions_null_keys),
    "sessions_timeout": _log_query(lambda log: sessions.numbered_sessions(log, LONG_TIMEOUT)),
    "session_metrics": _log_query(lambda log: sessions.session_metrics(log, LONG_TIMEOUT)),
    "session_summary": _log_query(sessions.session_summary),
    "session_summary_filtered": _log_query(
        lambda log: sessions.session_summary(log, LONG_TIMEOUT, Filters(**SOME_FILTERS))
    ),
    "entry_pages": _log_query(sessions.entry_pages),
    "exit_pages": _log_query(sessions.exit_pages),
    "landing_pages": _log_query(lambda log: sessions.landing_pages(log, timeout=LONG_TIMEOUT)),
    "bounce_pages": _log_query(sessions.bounce_pages),
    "panel_report": _log_query(panels.panel_report),
    "panel_merge": _merged_by_dataset(panels.panel_report, panels.merge_rows),
    "latency_merge_kll": _log_query(_latency_merge_kll),
    "panel_merge_hll": _log_query(_merged_sketches),
    "files_by_format": _log_query(lambda log: panels.files_by_format(_registry(log))),
    "det_brute_force": _log_query(detectors.detect_brute_force),
    "det_dir_enum": _log_query(detectors.detect_enumeration),
    "det_scanner": _log_query(detectors.detect_scanners),
    "det_sqli": _row_query(detectors.sqli_rule),
    "det_xss": _row_query(detectors.xss_rule),
    "det_cmd_injection": _row_query(detectors.command_injection_rule),
    "det_path_traversal": _row_query(detectors.path_traversal_rule),
    "findings": _log_query(_findings),
    "ip_risk": _log_query(lambda log: risk.ip_risk(_findings(log))),
    "ip_findings": _log_query(lambda log: risk.ip_findings(_findings(log))),
    "security_overview": _log_query(lambda log: risk.security_overview(_findings(log))),
    "severity_dist": _log_query(lambda log: risk.severity_distribution(_findings(log))),
    "attack_categories": _log_query(lambda log: risk.attack_categories(_findings(log))),
    "risk_dist": _log_query(lambda log: risk.risk_distribution(_findings(log))),
    "attack_trends": _log_query(
        lambda log: risk.attack_trends(log, _findings(log))
    ),
    "sigma_selection": _pack_query([SELECTION_RULE]),
    "sigma_keywords": _pack_query([KEYWORD_RULE]),
    "sigma_condition": _pack_query(CONDITION_RULES),
    "sigma_findings": _log_query(_sigma_findings),
    "sigma_cidr6": _log_query(_sigma_cidr6),
    "sigma_by_rule": _log_query(lambda log: sigma_by_rule(log, default_pack())),
    "parse_combined": _round_trip("apache_access"),
    "parse_nginx": _round_trip("nginx_access"),
    "parse_clf": _round_trip("clf"),
    "parse_fallback": _round_trip("malformed", "clf"),
    "parse_apache_error": _round_trip("apache_error"),
    "parse_nginx_error": _round_trip("nginx_error"),
    "parse_iis": _round_trip("iis_w3c"),
    "parse_json": _round_trip("json"),
    "parse_infer": _round_trip("text", p.UNKNOWN_FORMAT),
    "parse_separators": _log_query(_parse_separators),
    "parse_stats": _log_query(_parse_stats),
    "quarantine": _log_query(_quarantine),
    "detect_format": _log_query(_detect_sample),
    "detect_format_whole": _log_query(_detect_whole),
    "url_decode": _query(_url_decode),
    "url_template": _query(_url_template),
    "bot_class": _query(_bot_class),
    "src_text": _query(_src_text),
    "ingest_summary": _query(_ingest_summary),
    "ingest_rejects": _query(_ingest_rejects),
    "folder_scan": _query(_folder_scan),
    "dedup_files": _query(_dedup_files),
    "datasets_inventory": _log_query(_datasets_inventory),
    "dataset_delete": _query(_dataset_delete),
    "stream_ingest": _query(_stream_ingest),
    "stream_rejects": _query(_stream_rejects),
    "stream_folder_ingest": _query(_stream_folder_ingest),
    "stream_traffic": _query(_stream_traffic),
    "stream_sliding": _query(_stream_sliding),
    "stream_sessions": _query(_stream_sessions),
    "stream_open_sessions": _query(_stream_open_sessions),
    "stream_latency": _query(_stream_latency),
    "stream_alerts": _query(_stream_alerts),
    "stream_findings": _query(_stream_findings),
    "stream_ip_risk": _query(_stream_ip_risk),
    "stream_ip_risk_all": _query(_stream_ip_risk_all),
    "stream_ip_risk_window": _query(_stream_ip_risk_window),
    "stream_dedup": _query(_stream_dedup),
}
