"""Schemas shared by parsers, reports and detectors."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of the log table, in storage order.
LOG_SCHEMA = T.StructType([
    T.StructField("upload_id", T.LongType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("ip", T.StringType(), False),
    T.StructField("method", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("query_string", T.StringType()),
    T.StructField("status_code", T.IntegerType(), False),
    T.StructField("bytes_sent", T.LongType(), False),
    T.StructField("request_size_bytes", T.LongType()),
    T.StructField("response_time_ms", T.DoubleType()),
    T.StructField("referrer", T.StringType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("virtual_host", T.StringType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("normalized_url", T.StringType(), False),
    T.StructField("bot_classification", T.StringType(), False),
])

# The stored log has this column besides: the UTC day of a row, by which its files are partitioned.
LOG_DAY = "log_day"

DATASET_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("filename", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("uploaded_at", T.TimestampType()),
    T.StructField("total_entries", T.LongType()),
    T.StructField("parser_used", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("original_path", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("checksum", T.StringType()),
    T.StructField("last_modified", T.TimestampType()),
    T.StructField("parsed_lines", T.LongType()),
    T.StructField("rejected_lines", T.LongType()),
])

# Lines that their file's format does not take, as they came.
REJECT_SCHEMA = T.StructType([
    T.StructField("upload_id", T.LongType(), False),
    T.StructField("path", T.StringType()),
    T.StructField("line", T.StringType()),
])

FINDING_COLUMNS = [
    "rule_id", "rule_title", "severity", "dataset_id",
    "timestamp", "ip", "providers", "evidence",
]


def conform(df: DataFrame, schema: T.StructType = LOG_SCHEMA) -> DataFrame:
    """Select the columns of ``schema`` in order; a missing one becomes a typed NULL."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema
    ])


def utc_day(time: Column) -> Column:
    """The day of a timestamp in UTC, whatever the session's zone, so that writers and readers agree."""
    return F.date_from_unix_date(F.floor(F.unix_micros(time) / F.lit(86_400_000_000)).cast("int"))


def naive_time(column: Column) -> Column:
    """Time without zone, the way results are handed out (session zone is UTC)."""
    return column.cast("timestamp_ntz")
