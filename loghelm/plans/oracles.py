"""The same queries as SQL for a second engine, to check results against."""

import json

from loghelm.functions.agents import BOT_WORDS
from loghelm.operators.detectors import (
    COMMAND_PATTERNS, REQUEST_FIELDS, SCANNER_NAMES, SQLI_PATTERNS, TRAVERSAL_PATTERNS, XSS_PATTERNS,
)
from loghelm.operators.rule_pack import DEFAULT_RULES
from loghelm.sources.access_view import AGENTS

AS_OF = "2024-01-25"
SQL_TYPES = {"s": "{0}", "l": "CAST({0} AS BIGINT)", "d": "ROUND(CAST({0} AS DOUBLE), 6)", "t": "CAST({0} AS TIMESTAMP)"}


def _bot(agent: str) -> str:
    cases = "".join(
        f" WHEN regexp_matches(lower({agent}), '{'|'.join(words)}') THEN '{name}'" for name, words in BOT_WORDS.items()
    )
    return f"CASE WHEN {agent} IS NULL OR {agent} IN ('', '-') THEN 'unknown'{cases} ELSE 'unknown' END"


def _template(url: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({url}, '/'), lambda x, i: CASE WHEN i > 1 AND "
        "regexp_full_match(x, '[0-9]+|[a-zA-Z0-9_-]{10,}') THEN '{id}' ELSE x END), '/')"
    )


_AGENT_CASES = " ".join(f"WHEN {i} THEN '{text}'" for i, text in enumerate(AGENTS))
VIEW = f"""SELECT CAST(1 + user_id % 3 AS BIGINT) AS upload_id, ts AS timestamp,
 concat('10.0.', CAST(CAST(floor(user_id / 256.0) AS INT) AS VARCHAR), '.', CAST(user_id % 256 AS VARCHAR)) AS ip,
 CASE WHEN event_type IN ('purchase','signup') THEN 'POST' ELSE 'GET' END AS method,
 CASE WHEN k % 25 = 3 THEN '/login' WHEN k % 25 = 7 THEN '/admin' WHEN k % 25 = 8 THEN '/.env'
      WHEN k % 25 = 11 THEN '/static/../../etc/passwd' ELSE concat('/', event_type, '/', CAST(k AS VARCHAR)) END AS url,
 CASE WHEN k % 25 = 1 THEN 'id=1 UNION SELECT password FROM users' WHEN k % 25 = 2 THEN 'q=<script>alert(1)</script>'
      WHEN k % 25 = 4 THEN 'ip=127.0.0.1;cat /etc/passwd' WHEN k % 2 = 0 THEN concat('k=', CAST(k AS VARCHAR)) END AS query_string,
 CASE WHEN event_type = 'error' THEN 500 WHEN k % 25 IN (7, 8) THEN 404 WHEN k % 25 = 3 THEN 401
      WHEN k % 10 = 9 THEN 302 ELSE 200 END AS status_code,
 CAST(floor(value * 100) AS BIGINT) AS bytes_sent,
 CASE WHEN k % 4 <> 0 THEN value END AS response_time_ms,
 CASE user_id % 7 {_AGENT_CASES} END AS user_agent,
 'HTTP/1.1' AS protocol
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) e"""
LOG = f"""log AS (SELECT v.*, {_template('url')} AS normalized_url, {_bot('user_agent')} AS bot_classification,
 COALESCE(user_agent, 'unknown') AS ua_fixed, date_trunc('second', timestamp) AS sec FROM ({VIEW}) v)"""


def _sql(columns: str, body: str, ctes: str = "") -> str:
    """Body with its result columns cast: ``name:type`` with s, l, d, t for the types."""
    shown = ", ".join(
        f"{SQL_TYPES[kind].format(name)} AS {name}" for name, kind in (c.split(":") for c in columns.split())
    )
    extra = f", {ctes}" if ctes else ""
    return f"WITH {LOG}{extra} SELECT {shown} FROM ({body}) result"


def _over_time(unit: str) -> str:
    return _sql(
        "time_bucket:t total_requests:l unique_visitors:l total_bytes:l",
        f"""SELECT date_trunc('{unit}', timestamp) AS time_bucket, count(*) AS total_requests,
        count(DISTINCT ip) AS unique_visitors, sum(bytes_sent) AS total_bytes FROM log GROUP BY 1""",
    )


def _top(name: str, column: str, limit: str = "LIMIT 10", kind: str = "s") -> str:
    return _sql(
        f"{name}:{kind} count:l",
        f"SELECT {column} AS {name}, count(*) AS count FROM log GROUP BY 1 ORDER BY 2 DESC, 1 ASC NULLS LAST {limit}",
    )


BROWSER = """CASE WHEN user_agent IS NULL OR user_agent = '' THEN 'Unknown'
 WHEN user_agent ILIKE '%chrome%' AND user_agent NOT ILIKE '%edg%' THEN 'Chrome'
 WHEN user_agent ILIKE '%safari%' AND user_agent NOT ILIKE '%chrome%' THEN 'Safari'
 WHEN user_agent ILIKE '%firefox%' THEN 'Firefox' WHEN user_agent ILIKE '%edg%' THEN 'Edge'
 WHEN user_agent ILIKE '%googlebot%' THEN 'Googlebot' WHEN user_agent ILIKE '%curl%' THEN 'cURL' ELSE 'Unknown' END"""
SYSTEM = """CASE WHEN user_agent IS NULL OR user_agent = '' THEN 'Unknown'
 WHEN user_agent ILIKE '%windows%' THEN 'Windows' WHEN user_agent ILIKE '%mac os x%' THEN 'Mac OS'
 WHEN user_agent ILIKE '%linux%' AND user_agent NOT ILIKE '%android%' THEN 'Linux'
 WHEN user_agent ILIKE '%android%' THEN 'Android'
 WHEN user_agent ILIKE '%iphone%' OR user_agent ILIKE '%ipad%' THEN 'iOS' ELSE 'Unknown' END"""

BASE = "upload_id:l timestamp:t ip:s url:s status_code:l bytes_sent:l"
SOME_WHERE = """timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-20 23:59:59.999999'
 AND status_code = 200 AND user_agent LIKE '%Mozilla%' AND bot_classification = 'human'"""


def _where(condition: str) -> str:
    return _sql(BASE, f"SELECT * FROM log WHERE {condition}")


def _session_ctes(timeout: int, dataset: str = "upload_id, ") -> str:
    key = f"PARTITION BY {dataset}ip, ua_fixed ORDER BY timestamp"
    return f"""lagged AS (SELECT *, lag(timestamp) OVER ({key}) AS prev_time FROM log),
 marked AS (SELECT *, CASE WHEN prev_time IS NULL OR epoch_us(timestamp) - epoch_us(prev_time) > {timeout * 1_000_000}
   THEN 1 ELSE 0 END AS is_new_session FROM lagged),
 visits AS (SELECT *, CAST(sum(is_new_session) OVER ({key}) AS BIGINT) AS session_id_num FROM marked)"""


def _session_stats(where: str = "TRUE", dataset: str = "upload_id, ") -> str:
    return f"""stats AS (SELECT {dataset}ip, ua_fixed, session_id_num, count(*) AS hits,
   min(timestamp) AS started, max(timestamp) AS ended, arg_min(url, timestamp) AS entry_url,
   arg_max(url, timestamp) AS exit_url FROM visits WHERE {where} GROUP BY {dataset}ip, ua_fixed, session_id_num)"""


def _session_summary(timeout: int, where: str = "TRUE") -> str:
    return _sql(
        "total_sessions:l avg_pages_per_session:d avg_session_duration_sec:d returning_visitors:l",
        """SELECT count(*) AS total_sessions, coalesce(avg(hits), 0) AS avg_pages_per_session,
        coalesce(avg((epoch_us(ended) - epoch_us(started)) / 1000000.0), 0) AS avg_session_duration_sec,
        (SELECT count(*) FROM (SELECT ip FROM stats GROUP BY ip HAVING count(*) > 1) r) AS returning_visitors
        FROM stats""",
        _session_ctes(timeout) + ", " + _session_stats(where),
    )


def _pages(column: str, count: str = "count", timeout: int = 1800, having: str = "TRUE") -> str:
    return _sql(
        f"url:s {count}:l",
        f"SELECT {column} AS url, count(*) AS {count} FROM stats WHERE {having} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        _session_ctes(timeout) + ", " + _session_stats(),
    )


def _panels(by: str) -> str:
    parts = {
        "visitors": "strftime(timestamp, '%Y-%m-%d')", "hours": "strftime(timestamp, '%H')", "requests": "url",
        "hosts": "ip", "status_codes": "CAST(status_code AS VARCHAR)", "browsers": BROWSER, "os": SYSTEM,
        "general": "'total'",
    }
    union = " UNION ALL ".join(
        f"""SELECT {by}'{panel}' AS panel, {key} AS key, count(*) AS hits,
        count(DISTINCT {{'i': ip, 'u': user_agent, 'd': CAST(timestamp AS DATE)}}) AS visitors, sum(bytes_sent) AS bytes
        FROM log GROUP BY ALL""" for panel, key in parts.items()
    )
    return f"panels AS ({union})"


# --- detection ------------------------------------------------------------------------

FINDING = "rule_id:s rule_title:s severity:s dataset_id:l timestamp:t ip:s providers:s evidence:s"
TEXT = "concat('URL: ', url, CASE WHEN query_string <> '' THEN concat(', Query: ', query_string) ELSE '' END)"


def _row_detector(rule: str, title: str, severity: str, patterns: list[str], prefix: str = "") -> str:
    tests = " OR ".join(f"coalesce({c} ILIKE '{p}', FALSE)" for p in patterns for c in REQUEST_FIELDS)
    return f"""SELECT '{rule}' AS rule_id, '{title}' AS rule_title, '{severity}' AS severity, upload_id AS dataset_id,
    timestamp, ip, 'Native Detection' AS providers, concat('{prefix}', {TEXT}) AS evidence FROM log WHERE {tests}"""


SQLI = _row_detector("custom_sqli", "SQL Injection Attempt", "critical", SQLI_PATTERNS)
XSS = _row_detector("custom_xss", "Cross-Site Scripting Attempt", "high", XSS_PATTERNS)
COMMAND = _row_detector(
    "custom_command_injection", "Command Injection Attempt", "critical", COMMAND_PATTERNS,
    "Potential command injection detected in ",
)
TRAVERSAL = _row_detector(
    "custom_path_traversal", "Path Traversal Attempt", "high", TRAVERSAL_PATTERNS,
    "Path traversal sequence detected in ",
)


def _counting(rule: str, title: str, severity: str, evidence: str, where: str, group: str, having: str) -> str:
    return f"""SELECT '{rule}' AS rule_id, '{title}' AS rule_title, {severity} AS severity, upload_id AS dataset_id,
    min(timestamp) AS timestamp, ip, 'Native Detection' AS providers, {evidence} AS evidence
    FROM log WHERE {where} GROUP BY {group} HAVING {having}"""


DENIED = "count(*) FILTER (status_code = 401)"
MISSING = "count(*) FILTER (status_code = 404)"
BRUTE = _counting(
    "custom_brute_force", "Brute Force Attempt",
    f"CASE WHEN {DENIED} > 20 OR count(*) > 50 THEN 'high' ELSE 'medium' END",
    f"concat({DENIED}, ' failed logins, ', count(*), ' total attempts on ', url)",
    "url ILIKE '%login%' OR url ILIKE '%signin%' OR url ILIKE '%auth%'", "upload_id, ip, url",
    f"count(*) > 10 OR {DENIED} > 5",
)
ENUMERATION = _counting(
    "custom_directory_enumeration", "Directory Enumeration",
    f"CASE WHEN count(DISTINCT url) > 10 OR {MISSING} > 20 THEN 'high' ELSE 'medium' END",
    f"concat('Probed ', count(DISTINCT url), ' sensitive paths, ', {MISSING}, ' 404s')",
    "url ILIKE '%/admin%' OR url ILIKE '%/.git%' OR url ILIKE '%/.env%' OR url ILIKE '%/backup%' "
    "OR url ILIKE '%/config%' OR url ILIKE '%/phpmyadmin%'", "upload_id, ip", "count(*) > 5",
)
SCANNER = _counting(
    "custom_scanner", "Security Scanner Detected", "'medium'",
    "concat('Scanner UA: ', user_agent, ', requests: ', count(*))",
    " OR ".join(f"user_agent ILIKE '%{n}%'" for n in SCANNER_NAMES), "upload_id, ip, user_agent", "TRUE",
)


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({column}, '')), '{w}')" for w in words) + ")"


def _path_or_query(words: list[str]) -> str:
    return f"({_any('url', words)} OR {_any('query_string', words)})"


def _words(words: list[str]) -> str:
    return f"({_any('url', words)} OR {_any('query_string', words)} OR {_any('user_agent', words)})"


IP_NUMBER = (
    "(CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 "
    "+ CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT))"
)
SCRIPT = "regexp_matches(lower(coalesce(user_agent, '')), '^({})')"
# The rule pack, each rule written out by hand.
RULES = [
    ("lh-refused-login", "Refused sign-in", "low",
     "lower(url) IN ('/login', '/session/new') AND status_code IN (401, 403) AND user_agent IS NOT NULL"),
    ("lh-staff-area", "Staff area visited from a script", "medium",
     "regexp_matches(lower(url), '^/(admin|internal)') AND " + SCRIPT.format("curl/|go-http-client/|sqlmap/")),
    ("lh-settings-file", "Settings file asked for", "high", r"regexp_matches(lower(url), '/(\.env|settings\.py|application\.yml)$')"),
    ("lh-dump", "Archive or dump asked for", "medium", r"regexp_matches(lower(url), '\.(sql|bak|tgz|env)$')"),
    ("lh-parent-folder", "Path climbs to a parent folder", "high", "contains(url, '/../')"),
    ("lh-two-tables", "Query joins a second table", "critical",
     "coalesce(query_string ILIKE '%union%' AND query_string ILIKE '%password%', FALSE)"),
    ("lh-chained-command", "Command chained to a value", "critical", "coalesce(regexp_matches(query_string, '=[^&]*[;|]\\s*[a-z]+ /'), FALSE)"),
    ("lh-office-errors", "Server error or redirect seen from an office network", "low",
     f"{IP_NUMBER} BETWEEN 167772160 AND 167772223 AND status_code IN (302, 500)"),
    ("lh-silent-change", "Change without a user agent", "medium", "user_agent IS NULL AND method NOT IN ('GET', 'HEAD', 'OPTIONS')"),
    ("lh-crawler-version", "Crawler of the second generation", "informational",
     r"regexp_matches(lower(coalesce(user_agent, '')), '(bot|spider)/2\..;')"),
    ("lh-markup", "Markup in a request", "high", _words(["<script", "<svg/onload", "%3cobject"])),
    ("lh-account-file", "Account file named", "high", "coalesce(query_string ILIKE '%cat /%/passwd%', FALSE)"),
    ("lh-watchers", "Monitor or scanner", "low",
     _any("user_agent", ["pingdom"]) + " OR (method = 'GET' AND " + _any("user_agent", ["sqlmap"]) + ")"),
    ("lh-odd-sale", "Sale that failed or came without a browser", "medium",
     "method = 'POST' AND contains(url, '/purchase/') AND (status_code IN (500, 503) OR " + SCRIPT.format("curl|sqlmap") + ")"),
    ("lh-first-page", "First page of a signup", "informational",
     "starts_with(url, '/signup/') AND coalesce(ends_with(query_string, '=0'), FALSE)"),
]


def _sigma(rules: list[tuple[str, str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{i}' AS rule_id, '{t}' AS rule_title, '{s}' AS severity, upload_id AS dataset_id, timestamp, ip,
        'Sigma' AS providers, concat('URL: ', url, CASE WHEN query_string <> '' THEN concat(' | Query: ', query_string)
        ELSE '' END) AS evidence FROM log WHERE {c}""" for i, t, s, c in rules
    )


SELECTION = [("selection", "Selection", "low",
    "method = 'POST' AND status_code IN (200, 302, 500) AND " + _any("user_agent", ["curl", "sqlmap"])
    + " AND regexp_matches(url, '^(/sign|/pur)') AND coalesce(regexp_matches(query_string, '[048]$'), FALSE)")]
KEYWORDS = [("keywords", "Keywords", "low",
    _words(["etc/passwd", "<script>", "googlebot"]) + " OR coalesce(query_string ILIKE '%union % password%', FALSE)")]
NEAR = f"({IP_NUMBER} BETWEEN 167772160 AND 167772175 OR {IP_NUMBER} BETWEEN 167772224 AND 167772255)"
BOTH = "(coalesce(contains(query_string, 'id=') AND contains(query_string, 'password'), FALSE))"
CONDITIONS = [
    ("groups", "Groups", "low",
     """((contains(url, '/click/') AND status_code = 200) OR starts_with(coalesce(user_agent, ''), 'curl') OR user_agent IS NULL)
     AND NOT coalesce(regexp_matches(query_string, '^k=[0-9]$'), FALSE)"""),
    ("network", "Network", "medium", f"({NEAR} AND NOT {BOTH}) OR {BOTH}"),
]
NATIVE_ROWS = " UNION ALL ".join([SQLI, XSS, COMMAND, TRAVERSAL])
COUNTED = " UNION ALL ".join([BRUTE, ENUMERATION, SCANNER])
SIGMA = _sigma(RULES)
ABOUT = ", ".join("({})".format(", ".join(
    "'" + text.replace("'", "''") + "'" for text in (rule["id"], json.dumps(rule), rule["status"]))) for rule in DEFAULT_RULES)
RULE_TEXT = f"""SELECT f.*, a.rule_source, a.status, NULL AS filename FROM ({SIGMA}) f
 JOIN (VALUES {ABOUT}) a(rule_id, rule_source, status) ON f.rule_id = a.rule_id"""
ALL = f"found AS ({COUNTED} UNION ALL {NATIVE_ROWS} UNION ALL {SIGMA})"
POINTS = "CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 25 WHEN 'medium' THEN 10 ELSE 5 END"
RISK = f"""risk AS (SELECT *, CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 50 THEN 'high'
 WHEN risk_score >= 20 THEN 'medium' ELSE 'low' END AS severity FROM (
 SELECT ip, sum({POINTS}) AS score, least(sum({POINTS}), 100) AS risk_score, count(*) AS findings,
 count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'high') AS high_count,
 count(*) FILTER (severity = 'medium') AS medium_count,
 count(*) FILTER (severity NOT IN ('critical', 'high', 'medium')) AS low_count,
 array_to_string(list_sort(list(DISTINCT rule_title)), ' | ') AS signatures FROM found GROUP BY ip) s)"""

# --- parsing --------------------------------------------------------------------------

ENTRY = ("upload_id:l timestamp:t ip:s method:s url:s query_string:s status_code:l bytes_sent:l "
         "response_time_ms:d user_agent:s host:s protocol:s normalized_url:s bot_classification:s")


def _parsed(**changes: str) -> str:
    values = {
        "upload_id": "upload_id", "timestamp": "sec", "ip": "ip", "method": "method", "url": "url",
        "query_string": "query_string", "status_code": "status_code", "bytes_sent": "bytes_sent",
        "response_time_ms": "NULL", "user_agent": "user_agent", "host": "NULL", "protocol": "protocol",
        "normalized_url": "normalized_url", "bot_classification": "bot_classification",
    } | changes
    body = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in values.items()) + " FROM log"
    return _sql(ENTRY.replace("host:s", "host:v"), body)


SQL_TYPES["v"] = "CAST({0} AS VARCHAR)"
NO_AGENT = {"user_agent": "CAST(NULL AS VARCHAR)", "bot_classification": "'unknown'"}
FREE_AGENT = "CASE WHEN regexp_matches(user_agent, 'Mozilla|Opera|compatible') THEN user_agent ELSE 'Unknown' END"
JSON_AGENT = "coalesce(user_agent, 'Unknown')"
IIS_LINE = """concat_ws(' ', strftime(sec, '%Y-%m-%d %H:%M:%S'), '10.9.9.9', method, url,
 coalesce(replace(query_string, ' ', '+'), '-'), '80', '-', ip, coalesce(replace(user_agent, ' ', '+'), '-'), '-',
 CAST(status_code AS VARCHAR), '0', '0', CAST(CAST(trunc(coalesce(response_time_ms, 0.0)) AS BIGINT) AS VARCHAR))"""
FORMATS = "(VALUES ('apache_access'), ('apache_error'), ('clf'), ('iis_w3c'), ('nginx_access'), ('nginx_error')) f(format)"
DETECTED = _sql(
    "file:s format:s confidence:d",
    f"SELECT DISTINCT concat(format, '-', upload_id) AS file, format, 1.0 AS confidence FROM log, {FORMATS}",
)
DATASETS = """registry AS (SELECT upload_id, concat('access-', upload_id, '.log') AS filename,
 CASE upload_id WHEN 1 THEN 'apache_access' WHEN 2 THEN 'clf' ELSE 'nginx_error' END AS format,
 count(*) AS entries FROM log GROUP BY upload_id)"""
DOCUMENT_FILES = """files AS (SELECT concat('doc-', lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS path, length(text) AS length,
 sha256(text) AS checksum, source FROM documents),
 taken AS (SELECT min(path) AS path, any_value(length) AS length, checksum FROM files
 WHERE checksum NOT IN (SELECT checksum FROM files WHERE source IN ('src0', 'src1')) GROUP BY checksum)"""

INGESTED = "CASE upload_id WHEN 1 THEN 'apache_access' WHEN 2 THEN 'nginx_access' ELSE 'iis_w3c' END"
BAD_LINE = "concat('?? ', ip, ' ', CAST(bytes_sent AS VARCHAR))"

def _sketched(key: str, column: str) -> str:
    """The counts and means of merged sketches, whose quantiles are to be close."""
    close = [f"{name}_response_time_close" for name in ("median", "p90", "p95", "p99")]
    columns = f"{key} timed_requests:l avg_response_time:d " + " ".join(f"{name}:s" for name in close)
    return _sql(
        columns,
        f"""SELECT {column} AS {key.split(":")[0]}, count(*) AS timed_requests, avg(response_time_ms) AS avg_response_time,
        {", ".join(f"TRUE AS {name}" for name in close)} FROM log WHERE response_time_ms IS NOT NULL GROUP BY 1""",
    )


ORACLES: dict[str, str] = {
    "traffic_minute": _over_time("minute"),
    "traffic_hour": _over_time("hour"),
    "traffic_day": _over_time("day"),
    "traffic_month": _over_time("month"),
    "traffic_summary": _sql(
        "total_requests:l hits:l unique_visitors:l total_bytes:l",
        """SELECT count(*) AS total_requests, count(*) FILTER (status_code = 200) AS hits,
        count(DISTINCT ip) AS unique_visitors, sum(bytes_sent) AS total_bytes FROM log""",
    ),
    "summary_filtered": _sql(
        "total_requests:l hits:l unique_visitors:l total_bytes:l",
        f"""SELECT count(*) AS total_requests, count(*) FILTER (status_code = 200) AS hits,
        count(DISTINCT ip) AS unique_visitors, coalesce(sum(bytes_sent), 0) AS total_bytes FROM log WHERE {SOME_WHERE}""",
    ),
    "latency_percentiles": _sql(
        "avg_response_time:d median_response_time:d p90_response_time:d p95_response_time:d p99_response_time:d",
        """SELECT avg(response_time_ms) AS avg_response_time, median(response_time_ms) AS median_response_time,
        quantile_cont(response_time_ms, 0.90) AS p90_response_time, quantile_cont(response_time_ms, 0.95) AS p95_response_time,
        quantile_cont(response_time_ms, 0.99) AS p99_response_time FROM log WHERE response_time_ms IS NOT NULL""",
    ),
    "slowest_endpoints": _sql(
        "url:s avg_time:d count:l",
        """SELECT normalized_url AS url, avg(response_time_ms) AS avg_time, count(*) AS count FROM log
        WHERE response_time_ms IS NOT NULL GROUP BY 1 HAVING count(*) > 5 ORDER BY 2 DESC, 1 LIMIT 10""",
    ),
    "fastest_endpoints": _sql(
        "url:s avg_time:d median_time:d p90_time:d p95_time:d p99_time:d count:l",
        """SELECT normalized_url AS url, avg(response_time_ms) AS avg_time,
        quantile_cont(response_time_ms, 0.5) AS median_time, quantile_cont(response_time_ms, 0.90) AS p90_time,
        quantile_cont(response_time_ms, 0.95) AS p95_time, quantile_cont(response_time_ms, 0.99) AS p99_time,
        count(*) AS count FROM log WHERE response_time_ms IS NOT NULL
        GROUP BY 1 HAVING count(*) > 5 ORDER BY 2, 1 LIMIT 10""",
    ),
    "throughput_hourly": _sql(
        "hour_bucket:t total_bytes:l bytes_per_second:d",
        """SELECT date_trunc('hour', timestamp) AS hour_bucket, sum(bytes_sent) AS total_bytes,
        sum(bytes_sent) / 3600.0 AS bytes_per_second FROM log GROUP BY 1""",
    ),
    "top_urls": _top("url", "url"),
    "top_urls_normalized": _top("url", "normalized_url"),
    "top_ips": _top("ip", "ip"),
    "top_user_agents": _top("user_agent", "user_agent"),
    "status_distribution": _top("status_code", "status_code", "", "l"),
    "status_rates": _sql(
        "success_rate:d client_error_rate:d server_error_rate:d",
        """SELECT sum(CASE WHEN status_code >= 200 AND status_code < 400 THEN 1 ELSE 0 END) * 100.0 / count(*) AS success_rate,
        sum(CASE WHEN status_code >= 400 AND status_code < 500 THEN 1 ELSE 0 END) * 100.0 / count(*) AS client_error_rate,
        sum(CASE WHEN status_code >= 500 THEN 1 ELSE 0 END) * 100.0 / count(*) AS server_error_rate FROM log""",
    ),
    "error_rate": _sql(
        "total_requests:l hits:l error_rate:d",
        """SELECT total_requests, hits, (total_requests - hits) * 100.0 / total_requests AS error_rate FROM (
        SELECT count(*) AS total_requests, count(*) FILTER (status_code = 200) AS hits FROM log) s""",
    ),
    "peak_hours": _top("hour", "extract(hour FROM timestamp)", "LIMIT 5", "l"),
    "peak_days": _top("day", "date_trunc('day', timestamp)", "LIMIT 5", "t"),
    "moving_avg_7d": _sql(
        "day:t daily_requests:l moving_avg_7d:d",
        """SELECT day, daily_requests, avg(daily_requests) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
        AS moving_avg_7d FROM (SELECT date_trunc('day', timestamp) AS day, count(*) AS daily_requests FROM log GROUP BY 1) d""",
    ),
    "traffic_growth": _sql(
        "last_7d:l prev_7d:l growth_percent:d",
        f"""SELECT last_7d, prev_7d, CASE WHEN prev_7d = 0 THEN 0 ELSE (last_7d - prev_7d) * 100.0 / prev_7d END AS growth_percent
        FROM (SELECT count(*) FILTER (timestamp >= DATE '{AS_OF}' - INTERVAL 7 DAY) AS last_7d,
        count(*) FILTER (timestamp >= DATE '{AS_OF}' - INTERVAL 14 DAY AND timestamp < DATE '{AS_OF}' - INTERVAL 7 DAY)
        AS prev_7d FROM log) p""",
    ),
    "status_by_endpoint": _sql(
        "normalized_url:s status_code:l count:l",
        "SELECT normalized_url, status_code, count(*) AS count FROM log GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50",
    ),
    "status_by_hour": _sql(
        "hour:l status_code:l count:l",
        "SELECT extract(hour FROM timestamp) AS hour, status_code, count(*) AS count FROM log GROUP BY 1, 2",
    ),
    "status_by_day": _sql(
        "day:t status_code:l count:l",
        "SELECT date_trunc('day', timestamp) AS day, status_code, count(*) AS count FROM log GROUP BY 1, 2",
    ),
    "browser_dist": _top("browser", BROWSER, ""),
    "os_dist": _top("os", SYSTEM, ""),
    "log_explorer": _sql(
        "timestamp:t ip:s method:s status_code:l url:s response_time_ms:d user_agent:s",
        """SELECT * FROM log WHERE upload_id = 2 ORDER BY response_time_ms DESC NULLS LAST, timestamp, ip, method,
        status_code, url, user_agent NULLS LAST LIMIT 50 OFFSET 20""",
    ),
    "log_explorer_count": _sql("total:l", "SELECT count(*) AS total FROM log WHERE upload_id = 2"),
    "filter_dataset": _where("upload_id = 2"),
    "filter_date_range": _where(
        "timestamp >= TIMESTAMP '2024-01-05 06:00:00' AND timestamp <= TIMESTAMP '2024-01-20 23:59:59.999999'"
    ),
    "filter_equality": _where(
        "ip = '10.0.0.8' AND status_code = 200 AND bot_classification = 'human' AND normalized_url = '/view/{id}'"
    ),
    "filter_ua": _where("contains(user_agent, 'Mozilla/5.0 (Mac')"),
    "filter_combined": _where(SOME_WHERE),
    "sessions": _sql(
        "upload_id:l ip:s timestamp:t url:s ua_fixed:s prev_time:t is_new_session:l session_id_num:l session_id:s",
        """SELECT *, coalesce(upload_id, 0) || '-' || ip || '-' || ua_fixed || '-' || session_id_num AS session_id
        FROM visits""",
        _session_ctes(1800),
    ),
    "sessions_null_keys": _sql(
        "upload_id:l ip:s timestamp:t ua_fixed:s is_new_session:l session_id_num:l", "SELECT * FROM visits",
        "blank AS (SELECT * REPLACE (CASE WHEN bytes_sent % 3 <> 0 THEN upload_id END AS upload_id, "
        "CASE WHEN bytes_sent % 5 <> 0 THEN ip END AS ip) FROM log), " + _session_ctes(1800).replace("FROM log)", "FROM blank)"),
    ),
    "sessions_timeout": _sql(
        "session_id:s ip:s user_agent:s start_time:t end_time:t pages:l duration_sec:d entry_url:s exit_url:s",
        """SELECT concat('s_', row_number() OVER (ORDER BY started, ip, ua_fixed, session_id_num)) AS session_id, ip,
        ua_fixed AS user_agent, started AS start_time, ended AS end_time, hits AS pages,
        (epoch_us(ended) - epoch_us(started)) / 1000000.0 AS duration_sec, entry_url, exit_url FROM stats""",
        _session_ctes(43200, "") + ", " + _session_stats(dataset=""),
    ),
    "session_metrics": _sql(
        "total_sessions:l avg_duration_seconds:d avg_pages_per_session:d",
        """SELECT count(*) AS total_sessions, avg((epoch_us(ended) - epoch_us(started)) / 1000000.0) AS avg_duration_seconds,
        avg(hits) AS avg_pages_per_session FROM stats""",
        _session_ctes(43200, "") + ", " + _session_stats(dataset=""),
    ),
    "session_summary": _session_summary(1800),
    "session_summary_filtered": _session_summary(43200, SOME_WHERE),
    "entry_pages": _pages("entry_url"),
    "exit_pages": _pages("exit_url"),
    "landing_pages": _pages("entry_url", timeout=43200),
    "bounce_pages": _pages("entry_url", "bounce_count", having="hits = 1"),
    "panel_report": _sql("panel:s key:s hits:l visitors:l bytes:l", "SELECT * FROM panels", _panels("")),
    "panel_merge": _sql(
        "panel:s key:s hits:l visitors:l bytes:l",
        """SELECT panel, key, sum(hits) AS hits, sum(visitors) AS visitors, sum(bytes) AS bytes FROM panels
        WHERE key <> '' GROUP BY panel, key""",
        _panels("upload_id, "),
    ),
    "latency_merge_kll": _sketched("upload_id:l", "upload_id"),
    "panel_merge_hll": _sql(
        "panel:s key:s hits:l bytes:l visitors_close:s",
        "SELECT panel, key, hits, bytes, TRUE AS visitors_close FROM panels WHERE key <> ''", _panels(""),
    ),
    "files_by_format": _sql(
        "report_format:s outcome:s reason:s files:l entries:l",
        """SELECT CASE format WHEN 'apache_access' THEN 'COMBINED' WHEN 'clf' THEN 'COMMON' END AS report_format,
        CASE WHEN format = 'nginx_error' THEN 'skipped' ELSE 'processed' END AS outcome,
        CASE WHEN format = 'nginx_error' THEN 'Unsupported format: nginx_error' END AS reason,
        count(*) AS files, sum(entries) AS entries FROM registry GROUP BY 1, 2, 3""",
        DATASETS,
    ),
    "det_brute_force": _sql(FINDING, BRUTE),
    "det_dir_enum": _sql(FINDING, ENUMERATION),
    "det_scanner": _sql(FINDING, SCANNER),
    "det_sqli": _sql(FINDING, SQLI),
    "det_xss": _sql(FINDING, XSS),
    "det_cmd_injection": _sql(FINDING, COMMAND),
    "det_path_traversal": _sql(FINDING, TRAVERSAL),
    "findings": _sql(FINDING, "SELECT * FROM found", ALL),
    "ip_risk": _sql(
        "ip:s score:l risk_score:l severity:s critical_count:l high_count:l medium_count:l low_count:l signatures:s",
        "SELECT * FROM risk", f"{ALL}, {RISK}",
    ),
    "ip_findings": _sql(
        FINDING + " risk_score:l risk_class:s",
        """SELECT found.*, risk_score, risk.severity AS risk_class FROM found JOIN risk ON found.ip = risk.ip""",
        f"{ALL}, {RISK}",
    ),
    "security_overview": _sql(
        "total_attacks:l suspicious_ips_count:l critical_risk_ips:l high_risk_ips:l medium_risk_ips:l low_risk_ips:l",
        """SELECT (SELECT count(*) FROM found) AS total_attacks, count(*) AS suspicious_ips_count,
        count(*) FILTER (severity = 'critical') AS critical_risk_ips, count(*) FILTER (severity = 'high') AS high_risk_ips,
        count(*) FILTER (severity = 'medium') AS medium_risk_ips, count(*) FILTER (severity = 'low') AS low_risk_ips FROM risk""",
        f"{ALL}, {RISK}",
    ),
    "severity_dist": _sql("name:s value:l", "SELECT severity AS name, count(*) AS value FROM found GROUP BY 1", ALL),
    "attack_categories": _sql("name:s value:l", "SELECT rule_title AS name, count(*) AS value FROM found GROUP BY 1", ALL),
    "risk_dist": _sql(
        "name:s value:l", "SELECT severity AS name, count(*) AS value FROM risk GROUP BY 1", f"{ALL}, {RISK}"
    ),
    "attack_trends": _sql(
        "timestamp:t attacks:l",
        """SELECT date_trunc('hour', timestamp) AS timestamp, count(*) AS attacks FROM log
        WHERE ip IN (SELECT ip FROM found) GROUP BY 1""",
        ALL,
    ),
    "sigma_selection": _sql(FINDING, _sigma(SELECTION)),
    "sigma_keywords": _sql(FINDING, _sigma(KEYWORDS)),
    "sigma_condition": _sql(FINDING, _sigma(CONDITIONS)),
    "sigma_cidr6": _sql(
        FINDING,
        f"""SELECT * REPLACE (CASE WHEN n % 2 = 0 THEN concat('fd00:', lower(to_hex(n)), '::1')
        ELSE concat('2001:0DB8:0000:', lpad(to_hex(n), 4, '0'), ':0:0:0:', split_part(ip, '.', 3)) END AS ip)
        FROM (SELECT *, CAST(split_part(ip, '.', 4) AS BIGINT) AS n FROM ({_sigma([("v6", "IPv6 networks", "low", "TRUE")])}) f) g
        WHERE CASE WHEN n % 2 = 0 THEN n BETWEEN 0 AND 31 ELSE n BETWEEN 64 AND 127 END""",
    ),
    "sigma_findings": _sql(FINDING + " rule_source:s status:s filename:v", RULE_TEXT),
    "sigma_by_rule": _sql(
        "rule_id:s rule_title:s severity:s matches:l ips:l",
        """SELECT rule_id, rule_title, severity, count(*) AS matches, count(DISTINCT ip) AS ips FROM found GROUP BY 1, 2, 3""",
        f"found AS ({SIGMA})",
    ),
    "parse_combined": _parsed(response_time_ms="round(response_time_ms * 1000) / 1000.0"),
    "parse_nginx": _parsed(response_time_ms="response_time_ms"),
    "parse_clf": _parsed(**NO_AGENT),
    "parse_fallback": _parsed(
        **NO_AGENT, protocol="'UNKNOWN'",
        url="CASE WHEN query_string IS NULL THEN url || ' <x>' ELSE url END",
        query_string="query_string || ' <x>'",
        normalized_url="CASE WHEN query_string IS NULL THEN "
        + _template("(url || ' <x>')") + " ELSE normalized_url END",
    ),
    "parse_apache_error": _parsed(
        **NO_AGENT, method="'-'", url="'-'", query_string="CAST(NULL AS VARCHAR)", status_code="500", bytes_sent="0",
        protocol="CAST(NULL AS VARCHAR)", normalized_url="'-'",
    ),
    "parse_nginx_error": _parsed(**NO_AGENT, status_code="500", bytes_sent="0", host="concat('h', upload_id)"),
    "parse_iis": _parsed(
        query_string="replace(query_string, ' ', '+')", bytes_sent="0", protocol="CAST(NULL AS VARCHAR)",
        response_time_ms="trunc(coalesce(response_time_ms, 0.0))", user_agent="replace(user_agent, '+', ' ')",
    ),
    "parse_json": _parsed(
        query_string="CAST(NULL AS VARCHAR)", protocol="CAST(NULL AS VARCHAR)", user_agent=JSON_AGENT,
    ),
    "parse_infer": _parsed(
        response_time_ms="response_time_ms", protocol="CAST(NULL AS VARCHAR)", user_agent=FREE_AGENT,
        bot_classification=_bot(f"({FREE_AGENT})"),
    ),
    "parse_separators": _sql(
        "status_code:l lines:l agents:l bytes:l",
        """SELECT status_code, count(*) AS lines, count(*) FILTER (contains(user_agent, 'Mozilla')) AS agents,
        sum(bytes_sent) AS bytes FROM log GROUP BY 1""",
    ),
    "parse_stats": _sql(
        "upload_id:l lines:l parsed_lines:l rejected_lines:l",
        """SELECT upload_id, count(*) AS lines, count(*) FILTER (upload_id <> 3) AS parsed_lines,
        count(*) FILTER (upload_id = 3) AS rejected_lines FROM log GROUP BY 1""",
    ),
    "quarantine": _sql("value:s", f"SELECT {IIS_LINE} AS value FROM log WHERE upload_id = 3"),
    "detect_format": DETECTED,
    "detect_format_whole": DETECTED,
    "url_decode": """SELECT CAST(page_id AS BIGINT) AS page_id,
        CASE WHEN contains(url, '?') THEN regexp_extract(url, '^([^?]*)', 1) ELSE url END AS path,
        CASE WHEN contains(url, '?') THEN regexp_extract(url, '\\?(.*)$', 1) || '?a+b c%zz' ELSE 'a+b c%zz' END AS query
        FROM pages""",
    "url_template": f"SELECT CAST(page_id AS BIGINT) AS page_id, {_template('url')} AS template FROM pages",
    "bot_class": _sql(
        "origin:s class:s count:l",
        f"""SELECT origin, {_bot('user_agent')} AS class, count(*) AS count FROM (
        SELECT 'log' AS origin, user_agent FROM log UNION ALL SELECT 'documents', text FROM documents) a GROUP BY 1, 2""",
    ),
    "src_text": _sql(
        "codec:s lines:l bytes:l",
        """SELECT CASE upload_id WHEN 1 THEN 'none' WHEN 2 THEN 'gzip' ELSE 'bzip2' END AS codec, count(*) AS lines,
        sum(bytes_sent) AS bytes FROM log GROUP BY 1""",
    ),
    "ingest_summary": _sql(
        "format:s parsed_lines:l rejected_lines:l confidence:d ok:l bytes:l timed:l",
        f"""SELECT {INGESTED} AS format,
        count(*) AS parsed_lines, count(*) FILTER (bytes_sent % 7 = 0) AS rejected_lines, 1.0 AS confidence,
        count(*) FILTER (status_code = 200) AS ok,
        CASE WHEN upload_id = 3 THEN 0 ELSE sum(bytes_sent) END AS bytes,
        CASE WHEN upload_id = 3 THEN count(*) ELSE count(response_time_ms) END AS timed FROM log GROUP BY upload_id""",
    ),
    "ingest_rejects": _sql("format:s line:s", f"SELECT {INGESTED} AS format, {BAD_LINE} AS line FROM log WHERE bytes_sent % 7 = 0"),
    "stream_rejects": _sql(
        "kind:s line:s lines:l",
        f"""SELECT kind, line, count(*) AS lines FROM (SELECT 'entries' AS kind, '' AS line FROM log
        UNION ALL SELECT 'rejected', {BAD_LINE} FROM log WHERE bytes_sent % 7 = 0) k GROUP BY 1, 2""",
    ),
    "folder_scan": f"""WITH {DOCUMENT_FILES} SELECT CAST(count(*) AS BIGINT) AS files_discovered,
        CAST((SELECT count(*) FROM taken) AS BIGINT) AS files_imported,
        CAST(count(*) - (SELECT count(*) FROM taken) AS BIGINT) AS files_skipped FROM files""",
    "dedup_files": f"WITH {DOCUMENT_FILES} SELECT path, CAST(length AS BIGINT) AS length, checksum FROM taken",
    "datasets_inventory": _sql(
        "upload_id:l filename:s format:s entries:l first_seen:t last_seen:t unique_ips:l",
        """SELECT registry.*, first_seen, last_seen, unique_ips FROM registry JOIN (SELECT upload_id AS u,
        min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(DISTINCT ip) AS unique_ips FROM log GROUP BY 1) f
        ON u = upload_id""",
        DATASETS,
    ),
    "dataset_delete": _sql(
        "upload_id:l entries:l bytes:l filename:s",
        """SELECT upload_id, count(*) AS entries, sum(bytes_sent) AS bytes, concat('access-', upload_id, '.log') AS filename
        FROM log WHERE upload_id <> 2 GROUP BY 1""",
    ),
    "stream_ingest": _parsed(upload_id="7", response_time_ms="round(response_time_ms * 1000) / 1000.0"),
    "stream_traffic": _sql(
        "window_start:t window_end:t total_requests:l visitors:l total_bytes:l",
        """SELECT date_trunc('hour', timestamp) AS window_start, date_trunc('hour', timestamp) + INTERVAL 1 HOUR AS window_end,
        count(*) AS total_requests, count(DISTINCT ip) AS visitors, sum(bytes_sent) AS total_bytes FROM log GROUP BY 1, 2""",
    ),
    "stream_sliding": _sql(
        "window_start:t total_requests:l visitors:l total_bytes:l",
        """SELECT window_start, count(*) AS total_requests, count(DISTINCT ip) AS visitors, sum(bytes_sent) AS total_bytes FROM (
        SELECT unnest([date_trunc('hour', timestamp), date_trunc('hour', timestamp) - INTERVAL 1 HOUR]) AS window_start,
        ip, bytes_sent FROM log) w GROUP BY 1""",
    ),
    "stream_sessions": _sql(
        "upload_id:l ip:s ua_fixed:s started:t ended:t hits:l",
        "SELECT upload_id, ip, ua_fixed, started, ended, hits FROM stats", _session_ctes(1800) + ", " + _session_stats(),
    ),
    "stream_open_sessions": _sql(
        "upload_id:l ip:s ua_fixed:s started:t ended:t hits:l is_open:s",
        """SELECT upload_id, ip, ua_fixed, started, ended, hits, ended + INTERVAL 30 MINUTE > (SELECT date_trunc('millisecond',
        max(timestamp)) FROM log) - INTERVAL 10 MINUTE AS is_open FROM stats""", _session_ctes(1800) + ", " + _session_stats(),
    ),
    "stream_latency": _sketched("day:t", "date_trunc('day', timestamp)"),
    "stream_alerts": _sql(
        "window_start:t upload_id:l ip:s alert:s target:s hits:l denied:l missing:l paths:l severity:s",
        f"""SELECT time_bucket(INTERVAL 7 DAY, timestamp, TIMESTAMP '1970-01-01') AS window_start, upload_id, ip, alert, target,
        count(*) AS hits, {DENIED} AS denied, {MISSING} AS missing, count(DISTINCT url) AS paths,
        CASE WHEN alert = 'brute_force' AND ({DENIED} > 20 OR count(*) > 50)
        OR alert <> 'brute_force' AND (count(DISTINCT url) > 10 OR {MISSING} > 20) THEN 'high' ELSE 'medium' END AS severity FROM (
        SELECT *, 'brute_force' AS alert, url AS target FROM log WHERE url ILIKE '%login%' OR url ILIKE '%signin%' OR url ILIKE '%auth%'
        UNION ALL SELECT *, 'directory_enumeration' AS alert, '' AS target FROM log
        WHERE regexp_matches(lower(url), '/admin|/\\.git|/\\.env|/backup|/config|/phpmyadmin')) c
        GROUP BY 1, 2, 3, 4, 5 HAVING CASE WHEN alert = 'brute_force' THEN count(*) > 10 OR {DENIED} > 5 ELSE count(*) > 5 END""",
    ),
    "stream_findings": _sql(FINDING, f"{NATIVE_ROWS} UNION ALL {SIGMA}"),
    "stream_ip_risk": _sql(
        "ip:s score:l risk_score:l severity:s findings:l", "SELECT * FROM risk", f"found AS ({NATIVE_ROWS} UNION ALL {SIGMA}), {RISK}"
    ),
    "stream_ip_risk_all": _sql("ip:s score:l risk_score:l severity:s findings:l", "SELECT * FROM risk", f"{ALL}, {RISK}"),
    "stream_ip_risk_window": _sql(
        "ip:s score:l risk_score:l severity:s findings:l", "SELECT * FROM risk",
        f"""every AS ({NATIVE_ROWS} UNION ALL {SIGMA}), found AS (SELECT * FROM every WHERE date_trunc('day', timestamp)
        + INTERVAL 8 DAY >= (SELECT date_trunc('millisecond', max(timestamp)) FROM every) - INTERVAL 1 DAY), {RISK}""",
    ),
    "stream_dedup": _sql(BASE, "SELECT * FROM log"),
}
# The same rows, from the store.
ORACLES["filter_date_range_store"] = ORACLES["filter_date_range"]
# The same files, as they arrive.
ORACLES["stream_folder_ingest"] = ORACLES["ingest_summary"]
