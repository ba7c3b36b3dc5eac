"""Sigma rules as Spark conditions, evaluated together in one scan of the log.

A rule is a mapping, as read from YAML. Each named selection becomes a SQL test over the
log columns, and the rule's condition a SQL expression over those tests, so operator
precedence and parentheses are Spark's own. An absent (NULL) field never matches.
"""

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.functions.net import network_sql
from loghelm.functions.text import quoted
from loghelm.operators.detectors import RowRule, match_rows
from loghelm.operators.filters import Filters

# Rule field names per log column.
FIELD_NAMES = {
    "method": ["cs-method", "c-method"],
    "status_code": ["sc-status", "c-status"],
    "user_agent": ["cs-user-agent", "c-useragent", "useragent", "cs-cookie", "c-cookie", "cookie"],
    "query_string": ["cs-uri-query", "c-uri-query", "uri-query"],
    "url": [
        "cs-uri-stem", "c-uri-stem", "uri-stem", "cs-uri", "c-uri", "uri",
        "c-uri-extension", "cs-uri-extension",
    ],
    "ip": ["c-ip", "cs-ip", "dst_ip", "c-dst-ip", "src_ip", "c-src-ip"],
    "referrer": ["cs-referer", "c-referer", "referer"],
    "host": ["cs-host", "c-host", "host"],
}
COLUMN_OF = {alias: column for column, aliases in FIELD_NAMES.items() for alias in aliases}
EXTENSION_FIELDS = {"c-uri-extension", "cs-uri-extension"}
EXTENSION_PATTERN = r"\.([^./]+)$"
NUMBER_COLUMNS = {"upload_id", "status_code", "bytes_sent"}
KEYWORD_COLUMNS = ["url", "query_string", "referrer", "user_agent"]
LOG_COLUMNS = {
    "upload_id", "ip", "method", "url", "query_string", "status_code", "bytes_sent", "referrer",
    "user_agent", "host", "protocol", "normalized_url", "bot_classification",
}


class RuleError(ValueError):
    """A rule that cannot be expressed; it is reported and the others still run."""


@dataclass(frozen=True)
class RulePack:
    rules: list[RowRule] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)
    ignored: list[str] = field(default_factory=list)


def _wildcards(value: str) -> tuple[str, str | None]:
    """The value as plain text, and as a pattern if it has an unescaped ``*`` or ``?``."""
    pieces = re.findall(r"\\[*?]|.", value, flags=re.S)
    plain = "".join(p[-1] if len(p) == 2 else p for p in pieces)
    if not {"*", "?"} & set(pieces):
        return plain, None
    return plain, "".join({"*": ".*", "?": "."}.get(p, re.escape(p[-1])) for p in pieces)


OPERATORS = ("and", "or", "not")
# How a text value is compared: plainly, and as a pattern when it has wildcards.
TEXT_TESTS = {
    "": ("lower({0}) = {1}", "^{}$"),
    "contains": ("contains(lower({0}), {1})", "{}"),
    "startswith": ("startswith(lower({0}), {1})", "^{}"),
    "endswith": ("endswith(lower({0}), {1})", "{}$"),
}


def _check_pattern(text: str) -> None:
    """Fail on a pattern that the engine which runs it, Java's, doesn't take."""
    context = SparkContext._active_spark_context
    if context is None:
        re.compile(text)
        return
    try:
        context._jvm.java.util.regex.Pattern.compile(text)
    except (Py4JJavaError, PySparkException) as error:
        raise RuleError(f"bad regular expression {text!r}: {error}") from None


def _value_test(column: str, modifier: str, value) -> str:
    """One value of one field. Text compares without case; ``*`` and ``?`` are wildcards."""
    if value is None:
        return f"{column} IS NULL"
    text = str(value)
    if modifier == "re":
        _check_pattern(text)
        test = f"rlike({column}, {quoted(text)})"
    elif modifier == "cidr":
        test = network_sql(column, text)
    elif modifier in TEXT_TESTS:
        comparison, frame = TEXT_TESTS[modifier]
        plain, pattern = _wildcards(text)
        test = comparison.format(column, quoted(plain.lower()))
        if pattern:
            test = f"rlike({column}, {quoted('(?is)' + frame.replace('{}', pattern))})"
    else:
        raise RuleError(f"unsupported modifier {modifier!r}")
    return f"coalesce({test}, false)"


def _joined(tests: list[str], word: str) -> str:
    if not tests:
        raise RuleError("empty selection")
    return "(" + f" {word} ".join(tests) + ")"


def field_test(spec: str, values) -> str:
    """``field|modifier: value(s)``: any value may match, with ``|all`` every one must."""
    name, *modifiers = spec.split("|")
    column = COLUMN_OF.get(name, name)
    if column not in LOG_COLUMNS:
        raise RuleError(f"unknown field {name!r}")
    if name in EXTENSION_FIELDS:
        column = f"regexp_extract({column}, {quoted(EXTENSION_PATTERN)}, 1)"
    elif column in NUMBER_COLUMNS:
        column = f"CAST({column} AS STRING)"
    every = "all" in modifiers
    rest = [m for m in modifiers if m != "all"]
    if len(rest) > 1:
        raise RuleError(f"unsupported modifiers {rest!r}")
    listed = values if isinstance(values, list) else [values]
    return _joined([_value_test(column, rest[0] if rest else "", v) for v in listed], "AND" if every else "OR")


def keyword_test(words: list) -> str:
    """Any word anywhere in url, query string, referrer or user agent."""
    text = f"concat_ws('\n', {', '.join(KEYWORD_COLUMNS)})"
    tests = []
    for word in map(str, words):
        if _wildcards(word)[1] is None:
            tests.append(_value_test(text, "contains", word))  # one field holds it whole
        else:
            tests += [_value_test(column, "contains", word) for column in KEYWORD_COLUMNS]
    return _joined(tests, "OR")


def selection_test(selection) -> str:
    """A mapping is the AND of its fields; a list is the OR of mappings or keywords."""
    if isinstance(selection, dict):
        return _joined([field_test(spec, values) for spec, values in selection.items()], "AND")
    if not isinstance(selection, list):
        return keyword_test([selection])
    tests = [selection_test(item) for item in selection if isinstance(item, dict)]
    words = [item for item in selection if not isinstance(item, dict)]
    return _joined(tests + ([keyword_test(words)] if words else []), "OR")


def condition_sql(condition: str, selections: dict[str, str]) -> str:
    """The condition with each selection name replaced by its test.

    ``1 of x*`` and ``x*`` are the OR, ``all of x*`` the AND of the matching names;
    ``them`` and ``*`` stand for every selection.
    """

    def matching(pattern: str) -> list[str]:
        if pattern in ("them", "*"):
            return [c for n, c in selections.items() if not n.startswith("_")]
        stem = pattern.removesuffix("*")
        found = [c for n, c in selections.items() if (n.startswith(stem) if pattern.endswith("*") else n == pattern)]
        if not found:
            raise RuleError(f"no selection named {pattern!r}")
        return found

    def replace(token: re.Match) -> str:
        text = token.group(0)
        if text.lower() in OPERATORS:
            return text.lower()
        quantity, pattern = token.group("quantity"), token.group("pattern") or text
        joint = " and " if quantity and quantity.lower() == "all" else " or "
        return "(" + joint.join(matching(pattern)) + ")"

    token = r"(?P<quantity>1|any|all)\s+of\s+(?P<pattern>[\w*-]+)|[\w*-]+"
    if re.sub(token, "", condition, flags=re.I).strip(" ()\t\n"):
        raise RuleError(f"unsupported condition {condition!r}")
    _check_form(re.sub(token, lambda m: m[0].lower() if m[0].lower() in OPERATORS else "T", condition, flags=re.I))
    return re.sub(token, replace, condition, flags=re.I)


def _check_form(shape: str) -> None:
    """Reduce a condition, its selections written ``T``, to a single ``T`` or fail."""
    before, rest = "", " ".join(shape.replace("(", " ( ").replace(")", " ) ").split())
    while before != rest:
        before, rest = rest, re.sub(r"not T\b|\bT (?:and|or) T\b|\( T \)", "T", rest)
    if rest != "T":
        raise RuleError(f"ill-formed condition {shape!r}")


def compile_rule(rule: dict) -> RowRule:
    detection = rule.get("detection") or {}
    condition = detection.get("condition")
    if not condition:
        raise RuleError("no condition")
    if isinstance(condition, list):
        condition = " or ".join(f"({c})" for c in condition)
    selections = {name: selection_test(s) for name, s in detection.items() if name != "condition"}
    test = f"({condition_sql(condition, selections)})"
    return RowRule(
        rule_id=str(rule.get("id", "unknown")),
        title=rule.get("title", "Unknown Rule"),
        severity=rule.get("level", "medium"),
        provider="Sigma",
        condition=test,
        source=json.dumps(rule, default=str),
        status=rule.get("status", "experimental"),
        filename=rule.get("filename"),
    )


def compile_pack(rules: list[dict]) -> RulePack:
    """Compile rules one by one; a failing or repeated one does not stop the others."""
    pack, seen = RulePack(), set()
    for number, rule in enumerate(rules):
        label = str(rule.get("id") or rule.get("filename") or number)
        if not rule.get("detection"):
            pack.ignored.append(label)
        elif rule.get("id") and rule["id"] in seen:
            pack.failed[rule.get("filename", label)] = "duplicate id"
        else:
            seen.add(rule.get("id"))
            try:
                pack.rules.append(compile_rule(rule))
            except (ValueError, TypeError, AttributeError, re.error) as error:
                pack.failed[label] = str(error)
    return pack


def load_rules(directory: str) -> RulePack:
    """Read and compile every ``.yml``, ``.yaml`` and ``.json`` rule below a directory."""
    rules, unreadable = [], {}
    for path in sorted(Path(directory).rglob("*")):
        if path.suffix not in (".yml", ".yaml", ".json"):
            continue
        name = str(path.relative_to(directory))
        try:
            rule = _read_rule(path)
        except Exception as error:  # any unreadable file is reported, none stops the load
            unreadable[name] = str(error)
            continue
        if isinstance(rule, dict):
            rules.append({**rule, "filename": name})
    pack = compile_pack(rules)
    pack.failed.update(unreadable)
    return pack


def _read_rule(path: Path):
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as error:
        raise RuleError("reading YAML rules needs the yaml package") from error
    return yaml.safe_load(text)


def sigma_findings(log: DataFrame, pack: RulePack, filters: Filters | None = None) -> DataFrame:
    """All rules of the pack over the log, in one scan."""
    return match_rows(log, pack.rules, filters)


def with_rule_text(findings: DataFrame, rules: list[RowRule]) -> DataFrame:
    """``findings`` with ``rule_source``, ``status`` and ``filename`` of their rules; NULL for others.

    The texts are joined from a table with one row per rule, so findings are shuffled without them.
    """
    rows = [(r.rule_id, r.source, r.status, r.filename) for r in rules]
    schema = "rule_id string, rule_source string, status string, filename string"
    about = findings.sparkSession.createDataFrame(rows, schema)
    # As many rows as the pack has rules, which the driver holds anyway.
    return findings.join(F.broadcast(about), "rule_id", "left")


def sigma_by_rule(log: DataFrame, pack: RulePack, filters: Filters | None = None) -> DataFrame:
    return (
        sigma_findings(log, pack, filters)
        .groupBy("rule_id", "rule_title", "severity")
        .agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("ip").alias("ips"))
        .orderBy(F.col("matches").desc(), "rule_id")
    )
