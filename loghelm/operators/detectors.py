"""Attack detection over the log table.

Row rules (each row on its own) and the tests of the three counting detectors are all
evaluated in one scan. For the latter rows become candidates of a detector and its target, are
counted per distinct URL (which combines on the map side) and then per target.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.functions.text import contains_sql, ilike_sql
from loghelm.operators.filters import Filters, apply_filters
from loghelm.schema import FINDING_COLUMNS
from loghelm.session import materialized

REQUEST_FIELDS = ["url", "query_string", "protocol"]

# ILIKE patterns of the row detectors, on url, query_string and protocol.
SQLI_PATTERNS = [
    "%UNION SELECT%", "%UNION%20SELECT%", "%OR 1=1%", "%OR%201=1%",
    "%information_schema%", "%sleep(%", "%benchmark(%",
]
XSS_PATTERNS = ["%<script>%", "%javascript:%", "%onerror=%", "%alert(%", "%%3Cscript%3E%"]
COMMAND_PATTERNS = ["%wget %", "%curl %", "%cat %", "%ls %", "%;%", "%|%", "%&&%"]
TRAVERSAL_PATTERNS = ["%../%", "%%2e%2e%2f%", "%%2e%2e/%", "%..%2f%"]

# Substrings of the counting detectors and their thresholds.
LOGIN_WORDS = ["login", "signin", "auth"]
PROBE_PATHS = ["/admin", "/.git", "/.env", "/backup", "/config", "/phpmyadmin"]
SCANNER_NAMES = [
    "Nikto", "Nmap", "Gobuster", "DirBuster", "sqlmap",
    "ffuf", "wfuzz", "masscan", "ZMap", "OpenVAS",
]

BRUTE_FORCE = "custom_brute_force"
ENUMERATION = "custom_directory_enumeration"
SCANNER = "custom_scanner"
NATIVE = "Native Detection"


@dataclass(frozen=True)
class RowRule:
    """A condition on one log row, as a SQL expression over the log columns.

    With a ``prefix`` the evidence is one text, without it URL and query are separate.
    """

    rule_id: str
    title: str
    severity: str
    provider: str
    condition: str
    prefix: str | None = None
    source: str | None = None
    status: str | None = None
    filename: str | None = None


def _evidence(prefix: str | None) -> Column:
    has_query = F.col("query_string") != ""
    if prefix is None:
        parts = [F.concat(F.lit("URL: "), "url"), F.when(has_query, F.concat(F.lit("Query: "), "query_string"))]
        return F.array_compact(F.array(*parts))
    query = F.when(has_query, F.concat(F.lit(", Query: "), "query_string"))
    return F.array(F.concat(F.lit(f"{prefix}URL: "), "url", F.coalesce(query, F.lit(""))))


def _row_detector(rule_id: str, title: str, severity: str, patterns: list[str], prefix: str = "") -> RowRule:
    return RowRule(rule_id, title, severity, NATIVE, ilike_sql(REQUEST_FIELDS, patterns), prefix)


def sqli_rule() -> RowRule:
    return _row_detector("custom_sqli", "SQL Injection Attempt", "critical", SQLI_PATTERNS)


def xss_rule() -> RowRule:
    return _row_detector("custom_xss", "Cross-Site Scripting Attempt", "high", XSS_PATTERNS)


def command_injection_rule() -> RowRule:
    return _row_detector(
        "custom_command_injection", "Command Injection Attempt", "critical",
        COMMAND_PATTERNS, "Potential command injection detected in ",
    )


def path_traversal_rule() -> RowRule:
    return _row_detector(
        "custom_path_traversal", "Path Traversal Attempt", "high",
        TRAVERSAL_PATTERNS, "Path traversal sequence detected in ",
    )


def native_row_rules() -> list[RowRule]:
    return [sqli_rule(), xss_rule(), command_injection_rule(), path_traversal_rule()]


CONDITIONS_PER_MASK = 60


def expand_hits(rows: DataFrame, conditions: list[str], keep: list) -> DataFrame:
    """``keep`` and ``_n``, the number of a condition, for every condition a row meets.

    All conditions are computed in one projection, where Spark evaluates what they share
    (such as a lower-cased URL) once, and packed into the bits of a few numbers. Only a
    row with a set bit is expanded.
    """
    starts = range(0, len(conditions), CONDITIONS_PER_MASK)
    masks = {f"_mask{start}": _mask(conditions[start:start + CONDITIONS_PER_MASK]) for start in starts}
    numbers = [_set_bits(F.col(f"_mask{start}"), start) for start in starts]
    kept = rows.select(*keep, *[column.alias(name) for name, column in masks.items()])
    names = [c for c in kept.columns if c not in masks]
    return kept.select(*names, F.explode(F.concat(*numbers) if numbers else _no_numbers()).alias("_n"))


def _no_numbers() -> Column:
    return F.array().cast("array<int>")


def _mask(conditions: list[str]) -> Column:
    bits = [f"CASE WHEN {c} THEN {1 << position}L ELSE 0L END" for position, c in enumerate(conditions)]
    return F.expr(" + ".join(bits))


def _set_bits(mask: Column, start: int) -> Column:
    """Numbers of the conditions whose bit is set; empty, without further work, for 0."""
    positions = F.sequence(F.lit(0), F.lit(CONDITIONS_PER_MASK - 1))
    found = F.filter(positions, lambda i: F.getbit(mask, i) == 1)
    return F.when(mask != 0, F.transform(found, lambda i: i + F.lit(start))).otherwise(_no_numbers())


def match_rows(log: DataFrame, rules: list[RowRule], filters: Filters | None = None) -> DataFrame:
    """One finding per row and rule that holds, from a single scan for all rules."""
    rows = apply_filters(log, filters)
    return _row_findings(expand_hits(rows, [rule.condition for rule in rules], ROW_COLUMNS), rules)


ROW_COLUMNS = ["upload_id", "timestamp", "ip", "url", "query_string"]


def _row_findings(hits: DataFrame, rules: list[RowRule]) -> DataFrame:
    """Findings of the hits of ``rules``, ``_n`` being the rule's number."""
    about = F.array(*[
        F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.title).alias("rule_title"),
            F.lit(r.severity).alias("severity"), F.array(F.lit(r.provider)).alias("providers"),
        )
        for r in rules or [RowRule("", "", "", "", "false")]
    ])
    evidence = _evidence(None)
    for prefix in {r.prefix for r in rules if r.prefix is not None}:
        owners = [i for i, r in enumerate(rules) if r.prefix == prefix]
        evidence = F.when(F.col("_n").isin(owners), _evidence(prefix)).otherwise(evidence)
    return findings_of(
        hits.select(
            F.col("upload_id").alias("dataset_id"), "timestamp", "ip", F.get(about, F.col("_n")).alias("_r"), evidence.alias("evidence")
        ).select("dataset_id", "timestamp", "ip", "evidence", "_r.*")
    )


def findings_of(df: DataFrame) -> DataFrame:
    return df.select(*FINDING_COLUMNS)


COUNTING_DETECTORS = [BRUTE_FORCE, ENUMERATION, SCANNER]


CANDIDATE_COLUMNS = ["upload_id", "ip", "timestamp", "status_code", "url", "user_agent"]
# Which rows a counting detector counts.
CANDIDATE_TESTS = {
    BRUTE_FORCE: contains_sql("url", LOGIN_WORDS),
    ENUMERATION: contains_sql("url", PROBE_PATHS),
    SCANNER: contains_sql("user_agent", SCANNER_NAMES),
}


def _candidates(hits: DataFrame, detectors: list[str]) -> DataFrame:
    """Hits as candidates of the counting detectors, ``_n`` being the detector's number: what they target, and the URL."""
    names = F.array(*[F.lit(name) for name in detectors])
    detector = F.col("detector")
    return hits.withColumn("detector", F.get(names, F.col("_n"))).select(
        "upload_id", "ip", "timestamp", "status_code", "detector",
        F.when(detector == BRUTE_FORCE, F.col("url")).when(detector == SCANNER, F.col("user_agent")).alias("target"),
        F.when(detector == ENUMERATION, F.col("url")).alias("path"),
    )


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def counted_findings(
    log: DataFrame, filters: Filters | None = None, only: str | None = None
) -> DataFrame:
    """Brute force, directory enumeration and scanner findings (or ``only`` one of them)."""
    names = [only] if only else COUNTING_DETECTORS
    return _counted_findings(candidates(apply_filters(log, filters), names))


def candidates(rows: DataFrame, detectors: list[str]) -> DataFrame:
    """Rows that the counting detectors count, once for each."""
    hits = expand_hits(rows, [CANDIDATE_TESTS[name] for name in detectors], CANDIDATE_COLUMNS)
    return _candidates(hits, detectors)


def _counted_findings(candidates: DataFrame) -> DataFrame:
    return findings_of_counts(candidates.groupBy(*COUNT_KEYS).agg(*counts_of_candidates()))


COUNT_KEYS = ["detector", "upload_id", "ip", "target", "path"]


def counts_of_candidates() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("hits"),
        F.count_if(F.col("status_code") == 401).alias("denied"),
        F.count_if(F.col("status_code") == 404).alias("missing"),
        F.min("timestamp").alias("first_seen"),
    ]


def findings_of_counts(by_path: DataFrame) -> DataFrame:
    """Findings of the counting detectors from ``counts_of_candidates`` by ``COUNT_KEYS``."""
    group = [key for key in COUNT_KEYS if key != "path"]
    counts = (
        by_path.groupBy(*group)
        .agg(
            F.sum("hits").alias("hits"), F.sum("denied").alias("denied"),
            F.sum("missing").alias("missing"), F.count("path").alias("paths"),
            F.min("first_seen").alias("first_seen"),
        )
    )
    is_login, is_probe = F.col("detector") == BRUTE_FORCE, F.col("detector") == ENUMERATION
    reported = counts.where(
        F.when(is_login, (F.col("hits") > 10) | (F.col("denied") > 5))
        .when(is_probe, F.col("hits") > 5)
        .otherwise(True)
    )
    severe = F.when(is_login, (F.col("denied") > 20) | (F.col("hits") > 50)).when(
        is_probe, (F.col("paths") > 10) | (F.col("missing") > 20)
    ).otherwise(False)
    title = (
        F.when(is_login, "Brute Force Attempt").when(is_probe, "Directory Enumeration")
        .otherwise("Security Scanner Detected")
    )
    evidence = (
        F.when(is_login, F.concat(
            _text("denied"), F.lit(" failed logins, "), _text("hits"), F.lit(" total attempts on "), "target"))
        .when(is_probe, F.concat(
            F.lit("Probed "), _text("paths"), F.lit(" sensitive paths, "), _text("missing"), F.lit(" 404s")))
        .otherwise(F.concat(F.lit("Scanner UA: "), "target", F.lit(", requests: "), _text("hits")))
    )
    return findings_of(
        reported.select(
            F.col("detector").alias("rule_id"), title.alias("rule_title"),
            F.when(severe, "high").otherwise("medium").alias("severity"),
            F.col("upload_id").alias("dataset_id"), F.col("first_seen").alias("timestamp"), "ip",
            F.array(F.lit(NATIVE)).alias("providers"), F.array(evidence).alias("evidence"),
        )
    )


def detect_brute_force(log: DataFrame, filters: Filters | None = None) -> DataFrame:
    return counted_findings(log, filters, BRUTE_FORCE)


def detect_enumeration(log: DataFrame, filters: Filters | None = None) -> DataFrame:
    return counted_findings(log, filters, ENUMERATION)


def detect_scanners(log: DataFrame, filters: Filters | None = None) -> DataFrame:
    return counted_findings(log, filters, SCANNER)


def all_findings(
    log: DataFrame, rules: list[RowRule] | None = None, filters: Filters | None = None
) -> DataFrame:
    """Findings of the seven detectors and of ``rules`` (compiled rule pack).

    The log is scanned once: hits of all conditions, a small part of it, are stored, and rows and counts follow from them.
    """
    row_rules = native_row_rules() + list(rules or [])
    conditions = [r.condition for r in row_rules] + [CANDIDATE_TESTS[name] for name in COUNTING_DETECTORS]
    keep = [*ROW_COLUMNS, *[c for c in CANDIDATE_COLUMNS if c not in ROW_COLUMNS]]
    hits = materialized(expand_hits(apply_filters(log, filters), conditions, keep), "hits")
    counting = hits.where(F.col("_n") >= len(row_rules)).withColumn("_n", F.col("_n") - len(row_rules))
    return _counted_findings(_candidates(counting, COUNTING_DETECTORS)).unionByName(
        _row_findings(hits.where(F.col("_n") < len(row_rules)), row_rules)
    )
