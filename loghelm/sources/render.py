"""Log rows written back as raw lines, the inverse of the parsers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that may not stand raw in a request target.
ESCAPES = [("%", "%25"), (" ", "%20"), ("<", "%3C"), (">", "%3E"), ('"', "%22")]


def _escaped(column: Column) -> Column:
    for raw, escape in ESCAPES:
        column = F.replace(column, F.lit(raw), F.lit(escape))
    return column


def _target() -> Column:
    query = F.when(F.col("query_string").isNotNull(), F.concat(F.lit("?"), _escaped(F.col("query_string"))))
    return F.concat(_escaped(F.col("url")), F.coalesce(query, F.lit("")))


def _or_dash(column: Column) -> Column:
    return F.coalesce(column, F.lit("-"))


def _time(pattern: str) -> Column:
    return F.date_format("timestamp", pattern)


def _common() -> Column:
    return F.format_string(
        '%s - - [%s] "%s %s %s" %s %s', "ip", _time("dd/MMM/yyyy:HH:mm:ss Z"), "method", _target(),
        "protocol", F.col("status_code").cast("string"), F.col("bytes_sent").cast("string"),
    )


def _combined(latency: Column) -> Column:
    took = F.when(F.col("response_time_ms").isNotNull(), F.concat(F.lit(" "), latency.cast("string")))
    return F.concat(
        _common(), F.lit(' "'), _or_dash(F.col("referrer")), F.lit('" "'), _or_dash(F.col("user_agent")),
        F.lit('"'), F.coalesce(took, F.lit("")),
    )


def _malformed() -> Column:
    # A payload instead of the protocol, so that only the fallback layout fits.
    return F.format_string(
        '%s - - [%s] "%s %s <x>" %s %s', "ip", _time("dd/MMM/yyyy:HH:mm:ss Z"), "method", _target(),
        F.col("status_code").cast("string"), F.col("bytes_sent").cast("string"),
    )


def _iis() -> Column:
    return F.concat_ws(
        " ", _time("yyyy-MM-dd HH:mm:ss"), F.lit("10.9.9.9"), "method", "url",
        _or_dash(F.translate("query_string", " ", "+")), F.lit("80"), F.lit("-"), "ip",
        _or_dash(F.translate("user_agent", " ", "+")), F.lit("-"), F.col("status_code").cast("string"),
        F.lit("0"), F.lit("0"), F.coalesce(F.col("response_time_ms"), F.lit(0.0)).cast("bigint").cast("string"),
    )


def _apache_error() -> Column:
    return F.format_string(
        "[%s] [error] [client %s] request %s failed", _time("EEE MMM dd HH:mm:ss yyyy"), "ip", "url"
    )


def _nginx_error() -> Column:
    query = F.when(F.col("query_string").isNotNull(), F.concat(F.lit("?"), _escaped(F.col("query_string"))))
    return F.format_string(
        '%s [error] 7#7: *1 upstream failed, client: %s, server: s, request: "%s %s HTTP/1.1", host: "h%s"',
        _time("yyyy/MM/dd HH:mm:ss"), "ip", "method",
        F.concat(F.col("url"), F.coalesce(query, F.lit(""))), F.col("upload_id").cast("string"),
    )


def _json() -> Column:
    return F.to_json(F.struct(
        F.lit("0.0.0.0").alias("ip"), F.col("ip").alias("client_ip"), "method", "url",
        F.col("status_code").alias("status"), F.col("bytes_sent").alias("bytes"), "user_agent",
        F.concat(_time("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("timestamp"),
    ))


def _free_text() -> Column:
    took = F.col("response_time_ms")
    return F.concat(
        F.lit("["), _time("dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000] from "), F.col("ip"), F.lit(" did "),
        F.col("method"), F.lit(" "), _target(), F.lit(" giving "), F.col("status_code").cast("string"),
        F.lit(" "), F.col("bytes_sent").cast("string"), F.lit(' as "'), _or_dash(F.col("user_agent")),
        F.lit('"'),
        F.when(took.isNotNull(), F.concat(F.lit(" "), took.cast("string"), F.lit("ms"))).otherwise(""),
    )


def line(format_name: str) -> Column:
    """The line of a log row in a format. ``malformed``, ``json`` and ``text`` are such too."""
    makers = {
        "apache_access": lambda: _combined(F.round(F.col("response_time_ms") * 1000).cast("bigint")),
        "nginx_access": lambda: _combined((F.col("response_time_ms") / 1000).cast("decimal(18,6)")),
        "clf": _common, "malformed": _malformed, "iis_w3c": _iis, "apache_error": _apache_error,
        "nginx_error": _nginx_error, "json": _json, "text": _free_text,
    }
    return makers[format_name]()


def render(log: DataFrame, format_name: str) -> DataFrame:
    """``upload_id, value``: each row as one raw line."""
    return log.select("upload_id", line(format_name).alias("value"))
