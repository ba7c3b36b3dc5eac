"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Each query runs once to
warm up code generation and once timed; results go to a sink that keeps nothing. The
``scaled`` part times the scans among them on the events repeated TIMES times, in many files.
"""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from loghelm.plans.catalog import QUERIES  # noqa: E402
from loghelm.session import build_session  # noqa: E402

HEADLINE = [
    "traffic_summary", "traffic_hour", "latency_percentiles", "slowest_endpoints", "fastest_endpoints",
    "throughput_hourly", "top_urls", "top_urls_normalized", "top_ips", "top_user_agents",
    "status_distribution", "status_rates", "status_by_endpoint", "peak_hours", "moving_avg_7d",
    "traffic_growth", "browser_dist", "os_dist", "log_explorer", "filter_combined",
    "sessions", "sessions_timeout", "session_summary", "entry_pages", "exit_pages", "bounce_pages",
    "panel_report", "panel_merge", "det_brute_force", "det_dir_enum", "det_sqli", "findings", "ip_risk",
    "security_overview", "attack_trends", "sigma_findings", "sigma_by_rule",
    "parse_combined", "parse_nginx", "parse_clf", "parse_iis", "parse_infer", "detect_format",
    "stream_traffic",
]

TIMES, FILES = int(os.environ.get("BENCH_TIMES", "20")), 32
SCALED = [
    "traffic_summary", "traffic_hour", "latency_percentiles", "slowest_endpoints", "fastest_endpoints", "top_urls",
    "status_by_endpoint", "traffic_growth", "entry_pages", "panel_report", "det_sqli", "findings", "ip_risk", "sigma_by_rule",
]


def repeated(spark, directory: str) -> str:
    """A folder whose events are those of ``directory`` TIMES times, each time of other users."""
    folder = tempfile.mkdtemp(prefix="bench-")
    events = spark.read.parquet(f"{directory}/events.parquet")
    users = events.agg(F.max("user_id")).first()[0] + 1
    many = events.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(TIMES - 1)))).withColumn("user_id", F.col("user_id") + F.col("id") * F.lit(users) % 60_000)
    many.drop("id").repartition(FILES).write.parquet(f"{folder}/events.parquet")
    return folder


def timed(spark, directory: str, names: list[str], runs: int) -> dict[str, float]:
    seconds = {}
    for name in names:
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    return seconds


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "loghelm-bench", f"local[{cpus}]",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = timed(spark, directory, HEADLINE, 2)
    scaled = timed(spark, repeated(spark, directory), SCALED, 1)
    spark.stop()
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": directory.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus),
        "scaled": {"times": TIMES, "value": round(sum(scaled.values()), 3), "queries": scaled},
    }))


if __name__ == "__main__":
    main()
