"""Raw log lines to typed rows, one regular-expression pass per line.

Each format rewrites a matching line to its fields joined by newline (which no raw line
contains; decoding, which can bring one in, comes after the split) and one split yields
them, so the cost does not grow with the number of fields. Separators such as U+0085 and
U+2028 are characters like any other.
Lines that do not match are kept and flagged, not dropped.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.functions.agents import bot_class
from loghelm.functions.urls import percent_decode, target_path, target_query, url_template

# The time comes first: a line that does not match is a single field, and no time.
FIELDS = [
    "time", "ip", "method", "target", "query", "protocol", "status",
    "bytes", "referrer", "agent", "latency", "host",
]
WHITESPACE = " \t\r\n\x0b\x0c"


@dataclass(frozen=True)
class Layout:
    """A line pattern and the field that each of its groups fills."""

    pattern: str
    groups: tuple[str, ...]

    def fields(self, line: Column) -> Column:
        """The fields joined by newline; the line unchanged when it does not match."""
        slots = {name: f"${i}" for i, name in enumerate(self.groups, start=1)}
        return F.regexp_replace(
            line, f"(?s)^{self.pattern}.*$", "\n".join(slots.get(name, "") for name in FIELDS)
        )


# Line layouts. A match may start after any whitespace in the line.
LEAD = r"(?:.*?\s)??"
CLIENT_AND_TIME = LEAD + r"(\S++)\s++\S++\s++\S++\s++\[([^\]]++)\]\s++"
LAZY_REQUEST = r'"(\S+)\s+(.+?)\s+(HTTP/\d\.\d)"\s++'
GREEDY_REQUEST = r'"(\S+)\s+(.+)\s+(HTTP/\d\.\d)"\s++'
# Any quoted text: first word, and as protocol the last one if HTTP is in it.
ANY_REQUEST = r'"(?=[^"])([^" ]*+)(?: ([^"]*?))??(?: ([^" ]*HTTP[^" ]*))?"\s++'
STATUS_AND_BYTES = r"(\d{3})\s++(\S++)"
REFERRER_AND_AGENT = r'\s++"([^"]*+)"\s++"([^"]*+)"'
LATENCY = r"(?:\s++([0-9.]++))?"

REQUEST_GROUPS = ("ip", "time", "method", "target", "protocol", "status", "bytes")
CLIENT_GROUPS = ("referrer", "agent")

COMBINED_MALFORMED = Layout(
    CLIENT_AND_TIME + ANY_REQUEST + STATUS_AND_BYTES + REFERRER_AND_AGENT,
    REQUEST_GROUPS + CLIENT_GROUPS,
)
ERROR_NGINX = (
    r".*?(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})\s+\[\w+\]\s+\d+#\d+:\s+(?:\*\d+)?\s*"
    r"(?=(?:.*?client:\s*([^,]+))?)(?=(?:.*?request:\s*\"(\w+)\s+([^\s]+)\s+([^\"]+)\")?)"
    r"(?=(?:.*?host:\s*\"([^\"]+)\")?)"
)

# What every line holds that a layout can match, told much faster than by the layout: a request after the time, and
# two more quoted texts.
HAS_REQUEST = r'\]\s+"'
HAS_THREE_QUOTED = r'(?s)^(?=.*?\]\s+")(?:[^"]*+"){6}'
TWO_PROTOCOLS = r'(?s)HTTP/\d\.\d".*HTTP/\d\.\d"'


def _access_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("d/MMM/yyyy:HH:mm:ss Z"))


def _ctime(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, r"\.\d+", ""), r"\s+", " ")
    return F.try_to_timestamp(F.regexp_replace(plain, r"^[A-Za-z]{3} ", ""), F.lit("MMM d HH:mm:ss yyyy"))


def _at(pattern: str) -> Callable[[Column], Column]:
    return lambda text: F.try_to_timestamp(text, F.lit(pattern))


@dataclass(frozen=True)
class LogFormat:
    name: str
    layouts: tuple[Layout, ...]
    time: Callable[[Column], Column]
    needs: str  # a pattern that is found in every line of a layout
    latency_per_ms: float | None = None  # latency units in a millisecond
    splits_target: bool = True
    decodes: bool = True
    error_log: bool = False
    plus_is_space: bool = False
    comment: str | None = None
    has_bytes: bool = True


# Formats in order of precedence for detection.
FORMATS = {
    f.name: f
    for f in [
        LogFormat(
            "apache_access",
            (
                Layout(
                    CLIENT_AND_TIME + LAZY_REQUEST + STATUS_AND_BYTES + REFERRER_AND_AGENT + LATENCY,
                    REQUEST_GROUPS + CLIENT_GROUPS + ("latency",),
                ),
                COMBINED_MALFORMED,
            ),
            _access_time, HAS_THREE_QUOTED,
            latency_per_ms=1000.0,
        ),
        LogFormat(
            "apache_error",
            (
                Layout(
                    r".*?\[([^\]]+)\]\s+\[\w+\]\s+\[client\s+([^\]]+)\]\s+",
                    ("time", "ip"),
                ),
            ),
            _ctime, r"\[client", error_log=True, has_bytes=False, decodes=False,
        ),
        LogFormat(
            "clf",
            (
                Layout(CLIENT_AND_TIME + GREEDY_REQUEST + STATUS_AND_BYTES, REQUEST_GROUPS),
                Layout(CLIENT_AND_TIME + ANY_REQUEST + STATUS_AND_BYTES, REQUEST_GROUPS),
            ),
            _access_time, HAS_REQUEST,
        ),
        LogFormat(
            "iis_w3c",
            (
                Layout(
                    r".*?(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s+\S++\s++(\S++)\s++(\S++)\s++(\S++)\s++"
                    r"\S++\s++\S++\s++(\S++)\s++(\S++)\s++(\S++)\s++(\d++)\s++\d++\s++\d++\s++(\d++)",
                    ("time", "method", "target", "query", "ip", "agent", "referrer", "status", "latency"),
                ),
            ),
            lambda text: F.try_to_timestamp(F.regexp_replace(text, r"\s+", " "), F.lit("yyyy-MM-dd HH:mm:ss")),
            r"\d{4}-\d{2}-\d{2}\s",
            latency_per_ms=1.0, splits_target=False, decodes=False, plus_is_space=True,
            comment="#", has_bytes=False,
        ),
        LogFormat(
            "nginx_access",
            (
                Layout(
                    CLIENT_AND_TIME + GREEDY_REQUEST + STATUS_AND_BYTES + REFERRER_AND_AGENT + LATENCY,
                    REQUEST_GROUPS + CLIENT_GROUPS + ("latency",),
                ),
                COMBINED_MALFORMED,
            ),
            _access_time, HAS_THREE_QUOTED,
            latency_per_ms=0.001,
        ),
        LogFormat(
            "nginx_error",
            (Layout(ERROR_NGINX, ("time", "ip", "method", "target", "protocol", "host")),),
            _at("yyyy/MM/dd HH:mm:ss"), "#", error_log=True, has_bytes=False, decodes=False,
        ),
    ]
}
UNKNOWN_FORMAT = "UNKNOWN_FORMAT"


def _given(text: Column) -> Column:
    """NULL for an absent field."""
    return F.when(text != "", text)


def _not_dash(text: Column) -> Column:
    return F.when((text != "-") & (text != ""), text)


def strip(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITESPACE))


def _fields_of(lines: DataFrame, fmt: LogFormat, line: str, hit: str) -> DataFrame:
    """Adds ``hit``: the fields of ``line`` by the first layout that matches, joined."""
    return _other_fields(lines.withColumn(hit, fmt.layouts[0].fields(F.col(line))), fmt, line, hit)


def _other_fields(found: DataFrame, fmt: LogFormat, line: str, hit: str) -> DataFrame:
    """Where the first layout has not matched, ``hit`` by the others."""
    for layout in fmt.layouts[1:]:
        matched = F.instr(hit, "\n") > 0
        found = found.withColumn(hit, F.when(matched, F.col(hit)).otherwise(layout.fields(F.col(line))))
    return found


def _field(parts: str, name: str) -> Column:
    return F.get(parts, F.lit(FIELDS.index(name)))


def _valid(fmt: LogFormat, parts: str, timestamp: Column) -> Column:
    valid = (F.size(parts) == len(FIELDS)) & timestamp.isNotNull()
    if not fmt.error_log:
        valid = valid & _field(parts, "status").try_cast("int").isNotNull()
    if fmt.has_bytes:
        size = _field(parts, "bytes")
        valid = valid & ((size == "-") | size.try_cast("bigint").isNotNull())
    return F.coalesce(valid, F.lit(False))


def parse_flags(lines: DataFrame, line: str) -> DataFrame:
    """Adds a boolean column per format: whether the stripped ``line`` parses in it.

    The layouts are tried on lines only that hold what they need. The access formats judge the same time, status and size
    of a line with one protocol at most, as their layouts then part after it or only in how they cut the target: there
    nginx is as Apache, and common as Apache if its first layout matches.
    """
    text = F.col(line)
    tested = lines.withColumn("_request", text.contains("[") & text.rlike(HAS_REQUEST))
    tested = tested.withColumn("_one", ~(F.col("_request") & text.rlike(TWO_PROTOCOLS)))
    for name, fmt in FORMATS.items():
        same = {"nginx_access": F.col("_one"), "clf": F.col("_first")}.get(name, F.lit(False))
        tested = tested.withColumn("_try", F.when(~same & _needed(text, fmt), text))
        tested = tested.withColumn(name, fmt.layouts[0].fields(F.col("_try")))
        if name == "apache_access":
            tested = tested.withColumn("_first", F.coalesce(F.col("_one") & (F.instr(name, "\n") > 0), F.lit(False)))
        tested = _other_fields(tested, fmt, "_try", name)
        tested = tested.withColumn(name, F.split(name, "\n"))
        flag = _valid(fmt, name, fmt.time(_field(name, "time")))
        if fmt.comment:
            flag = flag & ~text.startswith(fmt.comment)
        if name in ("nginx_access", "clf"):
            flag = F.when(same, F.col("apache_access")).otherwise(flag)
        tested = tested.withColumn(name, flag)
    return tested.drop("_request", "_one", "_first", "_try")


def _needed(text: Column, fmt: LogFormat) -> Column:
    """Whether a line holds what the format needs; plain texts and what formats share are looked up first."""
    if not fmt.error_log and fmt.has_bytes:
        return F.col("_request") if fmt.needs == HAS_REQUEST else F.col("_request") & text.rlike(fmt.needs)
    return text.contains("#") if fmt.needs == "#" else text.contains("[client") if fmt.needs == r"\[client" else text.rlike(fmt.needs)


def parse_lines(lines: DataFrame, format_name: str, line: str = "value") -> DataFrame:
    """All columns of ``lines`` but blank and comment lines, plus the entry and ``parsed``.

    ``parsed`` is false for a line outside the format, whose entry columns mean nothing.
    """
    fmt = FORMATS[format_name]
    kept = lines.columns
    text = lines.withColumn("_line", strip(F.col(line))).where(F.col("_line") != "")
    if fmt.comment:
        text = text.where(~F.col("_line").startswith(fmt.comment))
    text = _fields_of(text, fmt, "_line", "_f").select(*kept, F.split("_f", "\n").alias("_f"))
    # The generator keeps filters above it from being pushed below, where each would
    # run the regular expression and the time parser once more.
    row = F.struct(F.col("_f").alias("f"), fmt.time(_field("_f", "time")).alias("at"))
    text = text.select(*kept, F.explode(F.array(row)).alias("_r"))

    def field(name: str) -> Column:
        return _field("_r.f", name)

    if fmt.error_log:
        no_request, status, size = "-", F.lit(500), F.lit(0).cast("bigint")
    else:
        no_request, status, size = "/", field("status").try_cast("int"), F.lit(0).cast("bigint")
        if fmt.has_bytes:
            size = F.when(field("bytes") == "-", 0).otherwise(field("bytes").try_cast("bigint"))
    protocol = _given(field("protocol"))
    if len(fmt.layouts) > 1:
        protocol = F.coalesce(protocol, F.lit("UNKNOWN"))
    agent = _not_dash(field("agent"))
    if fmt.plus_is_space:
        agent = F.translate(agent, "+", " ")
    latency = F.lit(None).cast("double")
    if fmt.latency_per_ms:
        latency = field("latency").try_cast("double") / fmt.latency_per_ms
    staged = text.select(
        *kept,
        F.col("_r.at").alias("timestamp"),
        F.coalesce(_given(field("ip")), F.lit("-")).alias("ip"),
        F.coalesce(_given(field("method")), F.lit("-")).alias("method"),
        F.coalesce(_given(field("target")), F.lit(no_request)).alias("_target"),
        field("query").alias("_query"),
        status.cast("int").alias("status_code"),
        size.alias("bytes_sent"),
        latency.alias("response_time_ms"),
        _not_dash(field("referrer")).alias("referrer"),
        agent.alias("user_agent"),
        _given(field("host")).alias("host"),
        protocol.alias("protocol"),
        _valid(fmt, "_r.f", F.col("_r.at")).alias("parsed"),
    )
    if fmt.splits_target:
        url, query = target_path(F.col("_target")), target_query(F.col("_target"))
    else:
        url, query = F.col("_target"), _not_dash(F.col("_query"))
    staged = staged.withColumn("url", url).withColumn("query_string", query)
    if fmt.decodes:
        staged = staged.withColumn("url", percent_decode(F.col("url")))
        staged = staged.withColumn("query_string", percent_decode(F.col("query_string")))
    return staged.select(
        *kept, "timestamp", "ip", "method", "url", "query_string", "status_code", "bytes_sent",
        "response_time_ms", "referrer", "user_agent", "host", "protocol", "parsed",
    )


# JSON keys read from an object line, a later key of a pair winning.
JSON_SCHEMA = (
    "ip STRING, client_ip STRING, method STRING, url STRING, path STRING, status STRING, "
    "status_code STRING, bytes STRING, user_agent STRING, timestamp STRING"
)
# What each field looks like in a line of unknown layout.
IP_PATTERN = r"\b((?:[0-9]{1,3}\.){3}[0-9]{1,3})\b"
METHOD_PATTERN = r"\b(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b"
PATH_PATTERN = r"\s(/[^\s?]+)(?:\?([^\s]+))?\s"
STATUS_PATTERN = r"\s([1-5][0-9]{2})\s"
STATUS_BYTES_PATTERN = r"\s([1-5][0-9]{2})\s+([0-9]+|-)\s"
DURATION_PATTERN = r"\s([0-9]+(?:\.[0-9]+)?)(?:ms|µs|s)?\s*$"
BRACKET_PATTERN = r"(?s)\[(.*?)\]"
QUOTED_PATTERN = r'"([^"]*)"'


def parse_json(lines: DataFrame, as_of: str, line: str = "value") -> DataFrame:
    """JSON lines. Lines that are no JSON object are flagged."""
    kept = lines.columns
    objects = lines.withColumn("_line", strip(F.col(line))).where(F.col("_line") != "")
    objects = objects.withColumn("_j", F.from_json("_line", JSON_SCHEMA))
    is_object = F.col("_line").startswith("{") & F.col("_line").endswith("}")
    found = _json_fields(F.col("_j"))
    return objects.select(
        *kept,
        F.coalesce(found["timestamp"], F.lit(as_of).cast("timestamp")).alias("timestamp"),
        F.coalesce(found["ip"], F.lit("0.0.0.0")).alias("ip"),
        F.coalesce(found["method"], F.lit("UNKNOWN")).alias("method"),
        F.coalesce(found["url"], F.lit("/")).alias("url"),
        F.lit(None).cast("string").alias("query_string"),
        F.coalesce(found["status_code"], F.lit(200)).alias("status_code"),
        F.coalesce(found["bytes_sent"], F.lit(0).cast("bigint")).alias("bytes_sent"),
        F.lit(None).cast("double").alias("response_time_ms"),
        F.lit(None).cast("string").alias("referrer"),
        F.coalesce(found["user_agent"], F.lit("Unknown")).alias("user_agent"),
        F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("string").alias("protocol"),
        F.coalesce(is_object & F.col("_j").isNotNull(), F.lit(False)).alias("parsed"),
    )


def _json_fields(j: Column) -> dict[str, Column]:
    return {
        "ip": F.coalesce(j["client_ip"], j["ip"]),
        "method": j["method"],
        "url": F.coalesce(j["path"], j["url"]),
        "status_code": F.coalesce(j["status_code"], j["status"]).try_cast("int"),
        "bytes_sent": j["bytes"].try_cast("bigint"),
        "user_agent": j["user_agent"],
        "timestamp": j["timestamp"].try_cast("timestamp"),
    }


def parse_unknown(lines: DataFrame, as_of: str, line: str = "value") -> DataFrame:
    """Guess the fields of lines in no known format. Every non-blank line gives a row.

    ``as_of`` is the time of lines that carry none.
    """
    kept = lines.columns
    text = lines.withColumn("_line", strip(F.col(line))).where(F.col("_line") != "")
    body = F.col("_line")

    def first(pattern: str, group: int = 1) -> Column:
        return F.regexp_extract(body, pattern, group)

    # Extracts get columns of their own, as each is looked at twice below.
    looks_json = body.startswith("{") & body.endswith("}")
    staged = text.select(
        *kept, "_line",
        F.when(looks_json, F.from_json("_line", JSON_SCHEMA)).alias("_j"),
        F.regexp_extract_all("_line", F.lit(QUOTED_PATTERN), 1).alias("_quoted"),
        first(IP_PATTERN).alias("_ip"),
        first(METHOD_PATTERN).alias("_method"),
        first(PATH_PATTERN).alias("_path"),
        first(PATH_PATTERN, 2).alias("_query"),
        first(STATUS_PATTERN).alias("_any_status"),
        first(STATUS_BYTES_PATTERN).alias("_status"),
        first(STATUS_BYTES_PATTERN, 2).alias("_bytes"),
        first(DURATION_PATTERN).alias("_duration"),
        first(BRACKET_PATTERN).alias("_bracket"),
    )
    last = F.try_element_at("_quoted", F.lit(-1))
    second_last = F.try_element_at("_quoted", F.lit(-2))
    agent = F.when(last.rlike("Mozilla|Opera|compatible"), last).when(
        second_last.rlike("Mozilla|Opera"), second_last
    )
    duration = F.col("_duration").try_cast("double")
    took = (
        F.when(body.endswith("ms"), duration)
        .when(body.endswith("µs"), duration / 1000.0)
        .when(body.endswith("s"), duration * 1000.0)
        .otherwise(duration)
    )
    # Only the part before a blank is read, so a zone offset is not applied.
    stamp = F.try_to_timestamp(
        F.substring_index(F.ltrim("_bracket"), " ", 1), F.lit("d/MMM/yyyy:HH:mm:ss")
    )
    found = _json_fields(F.col("_j"))
    status = F.coalesce(_given(F.col("_status")), _given(F.col("_any_status"))).try_cast("int")
    return staged.select(
        *kept,
        F.coalesce(found["timestamp"], stamp, F.lit(as_of).cast("timestamp")).alias("timestamp"),
        F.coalesce(found["ip"], _given(F.col("_ip")), F.lit("0.0.0.0")).alias("ip"),
        F.coalesce(found["method"], _given(F.col("_method")), F.lit("UNKNOWN")).alias("method"),
        F.coalesce(found["url"], _given(F.col("_path")), F.lit("/")).alias("url"),
        F.ltrim(_given(F.col("_query")), F.lit("?")).alias("query_string"),
        F.coalesce(found["status_code"], status, F.lit(200)).alias("status_code"),
        F.coalesce(
            found["bytes_sent"], F.col("_bytes").try_cast("bigint"), F.lit(0).cast("bigint")
        ).alias("bytes_sent"),
        took.alias("response_time_ms"),
        F.lit(None).cast("string").alias("referrer"),
        F.coalesce(found["user_agent"], agent, F.lit("Unknown")).alias("user_agent"),
        F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("string").alias("protocol"),
        F.lit(True).alias("parsed"),
    )


def parse(lines: DataFrame, format_name: str, as_of: str, line: str = "value") -> DataFrame:
    """Parse by format name; ``UNKNOWN_FORMAT`` guesses."""
    if format_name == UNKNOWN_FORMAT:
        return parse_unknown(lines, as_of, line)
    return parse_lines(lines, format_name, line)


def entries(parsed: DataFrame) -> DataFrame:
    """The parsed rows, ready to store: classified, with URL and query decoded once more.

    The template is taken from the URL before that second decoding.
    """
    return (
        parsed.where("parsed")
        .drop("parsed")
        .withColumn("normalized_url", url_template(F.col("url")))
        .withColumn("bot_classification", bot_class("user_agent"))
        .withColumn("url", percent_decode(F.col("url")))
        .withColumn("query_string", percent_decode(F.col("query_string")))
    )


def quarantine(parsed: DataFrame, line: str = "value") -> DataFrame:
    """The lines that did not parse, as they came."""
    return parsed.where(~F.col("parsed")).select(line)


def parse_stats(parsed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Lines, parsed and rejected per group (one row without ``by``)."""
    return parsed.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if("parsed").alias("parsed_lines"),
        F.count_if(~F.col("parsed")).alias("rejected_lines"),
    )
