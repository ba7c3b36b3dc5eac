"""Risk per address and the security overview, from findings.

An address can own any share of the findings, so they are counted per address and rule
first; what is gathered per address is bounded by the number of rules. The findings
themselves stay a table, joined back by address where they are wanted.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.operators.filters import Filters, apply_filters
from loghelm.schema import naive_time
from loghelm.session import materialized

# Points per severity (any other counts 5), the cap, and class floors.
SEVERITY_POINTS = {"critical": 40, "high": 25, "medium": 10}
OTHER_POINTS = 5
MAX_SCORE = 100
CLASS_FLOORS = {"critical": 80, "high": 50, "medium": 20}


def _per_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("ip", "rule_title", "severity").agg(F.count(F.lit(1)).alias("n"))


def severity_points() -> Column:
    """The points of a finding by its severity."""
    points = F.lit(OTHER_POINTS)
    for severity, value in SEVERITY_POINTS.items():
        points = F.when(F.col("severity") == severity, value).otherwise(points)
    return points


def ip_risk(findings: DataFrame) -> DataFrame:
    """Score, class, counts per severity and the rule titles, one row per address."""
    other = ~F.coalesce(F.col("severity").isin(*SEVERITY_POINTS), F.lit(False))
    per_ip = _per_rule(findings).groupBy("ip").agg(
        F.sum(F.col("n") * severity_points()).alias("score"),
        *[
            F.sum(F.when(F.col("severity") == s, F.col("n")).otherwise(0)).alias(f"{s}_count")
            for s in SEVERITY_POINTS
        ],
        F.sum(F.when(other, F.col("n")).otherwise(0)).alias("low_count"),
        F.sort_array(F.collect_set("rule_title")).alias("signatures"),
    )
    risk = F.least(F.col("score"), F.lit(MAX_SCORE).cast("bigint"))
    return (
        per_ip.withColumn("risk_score", risk)
        .withColumn("severity", risk_class(F.col("risk_score")))
        .select("ip", "score", "risk_score", "severity", "critical_count", "high_count",
                "medium_count", "low_count", "signatures")
        .orderBy(F.col("risk_score").desc(), F.col("score").desc(), "ip")
    )


def risk_class(score: Column) -> Column:
    result = F.lit("low")
    for name, floor in reversed(CLASS_FLOORS.items()):
        result = F.when(score >= floor, name).otherwise(result)
    return result


def ip_findings(findings: DataFrame) -> DataFrame:
    """Every finding with the score and class of its address.

    The findings are stored first: they are read twice, and detection should run once.
    """
    findings = materialized(findings, "findings")
    scores = ip_risk(findings).select("ip", "risk_score", F.col("severity").alias("risk_class"))
    return findings.join(scores, "ip")


def severity_distribution(findings: DataFrame) -> DataFrame:
    return _named(findings, "severity")


def attack_categories(findings: DataFrame) -> DataFrame:
    return _named(findings, "rule_title")


def risk_distribution(findings: DataFrame) -> DataFrame:
    return _named(ip_risk(findings), "severity")


def _named(df: DataFrame, column: str) -> DataFrame:
    return (
        df.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("value"))
        .orderBy(F.col("value").desc(), "name")
    )


def security_overview(findings: DataFrame) -> DataFrame:
    """Findings in all, suspicious addresses, and addresses per risk class."""
    classes = ip_risk(findings)
    return classes.agg(
        F.coalesce(
            F.sum(sum(F.col(f"{s}_count") for s in ("critical", "high", "medium", "low"))), F.lit(0)
        ).alias("total_attacks"),
        F.count(F.lit(1)).alias("suspicious_ips_count"),
        *[
            F.count_if(F.col("severity") == name).alias(f"{name}_risk_ips")
            for name in ("critical", "high", "medium", "low")
        ],
    )


def attack_trends(log: DataFrame, findings: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Hourly requests of every address that has a finding.

    Requests are counted per address and hour before the semi-join, so a hot address is
    a handful of rows there.
    """
    hourly = apply_filters(log, filters).groupBy(
        "ip", naive_time(F.date_trunc("hour", "timestamp")).alias("timestamp")
    ).agg(F.count(F.lit(1)).alias("n"))
    suspicious = findings.select("ip").distinct()
    return (
        hourly.join(suspicious, "ip", "left_semi")
        .groupBy("timestamp").agg(F.sum("n").alias("attacks"))
        .orderBy("timestamp")
    )
