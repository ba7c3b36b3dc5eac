"""Reports that belong on one page, over one filtered log."""

from pyspark.sql import DataFrame

from loghelm.operators import reports, risk, sessions
from loghelm.operators.detectors import RowRule, all_findings
from loghelm.operators.filters import Filters


def overview(log: DataFrame, filters: Filters | None = None) -> dict[str, DataFrame]:
    return {
        "summary": reports.traffic_summary(log, filters),
        "sessions": sessions.session_summary(log, filters=filters),
        "error_rate": reports.error_rate(log, filters),
    }


def traffic(log: DataFrame, filters: Filters | None = None, resolution: str = "hour") -> DataFrame:
    return reports.traffic_over_time(log, resolution, filters)


def performance(log: DataFrame, filters: Filters | None = None) -> dict[str, DataFrame]:
    return {
        "latency": reports.latency_percentiles(log, filters),
        "slowest_endpoints": reports.slowest_endpoints(log, filters),
        "fastest_endpoints": reports.fastest_endpoints(log, filters),
        "throughput": reports.throughput_hourly(log, filters),
    }


def pages(log: DataFrame, n: int = 10, filters: Filters | None = None) -> dict[str, DataFrame]:
    return {
        "top_urls": reports.top_urls(log, n, filters=filters),
        "top_templates": reports.top_urls(log, n, normalized=True, filters=filters),
        "entry_pages": sessions.entry_pages(log, n, filters),
        "exit_pages": sessions.exit_pages(log, n, filters),
        "landing_pages": sessions.landing_pages(log, n, filters),
        "bounce_candidates": sessions.bounce_pages(log, n, filters),
    }


def visitors(log: DataFrame, n: int = 10, filters: Filters | None = None) -> dict[str, DataFrame]:
    return {
        "top_ips": reports.top_ips(log, n, filters),
        "top_user_agents": reports.top_user_agents(log, n, filters),
        "browsers": reports.browser_distribution(log, filters),
        "systems": reports.os_distribution(log, filters),
    }


def status_codes(log: DataFrame, filters: Filters | None = None) -> dict[str, DataFrame]:
    return {
        "distribution": reports.status_distribution(log, filters),
        "rates": reports.status_rates(log, filters),
        "by_endpoint": reports.status_by_endpoint(log, filters),
        "by_hour": reports.status_by_hour(log, filters),
        "by_day": reports.status_by_day(log, filters),
    }


def trends(log: DataFrame, as_of: str, filters: Filters | None = None) -> dict[str, DataFrame]:
    return {
        "peak_hours": reports.peak_hours(log, filters=filters),
        "peak_days": reports.peak_days(log, filters=filters),
        "moving_average": reports.moving_average(log, filters),
        "growth": reports.traffic_growth(log, as_of, filters),
    }


def security(
    log: DataFrame, rules: list[RowRule] | None = None, filters: Filters | None = None
) -> dict[str, DataFrame]:
    """Security reports over one persisted set of findings; unpersist ``findings`` when done."""
    findings = all_findings(log, rules, filters).persist()
    return {
        "findings": findings,
        "suspicious_ips": risk.ip_risk(findings),
        "overview": risk.security_overview(findings),
        "severity_distribution": risk.severity_distribution(findings),
        "attack_categories": risk.attack_categories(findings),
        "risk_distribution": risk.risk_distribution(findings),
        "attack_trends": risk.attack_trends(log, findings, filters),
    }
