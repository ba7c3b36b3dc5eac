"""Cases in which a query once did less than its whole job."""

from conftest import at

from loghelm.operators import detectors, risk
from loghelm.streaming import jobs


def test_streaming_risk_of_all_findings(spark, make_log, tmp_path):
    """Counting detectors score too, over batches and the end of a period, and an address has one row."""
    source = str(tmp_path / "in")
    first = [{"ip": "1.1.1.1", "url": "/login", "status_code": 401, "timestamp": at("2020-01-01 12:00:00")} for _ in range(4)]
    first += [{"ip": "2.2.2.2", "user_agent": "sqlmap/1", "timestamp": at("2020-01-01 12:00:00")}]
    first += [{"ip": "3.3.3.3", "url": "/a?q=<script>", "query_string": "q=<script>", "timestamp": at("2020-01-01 12:00:00")}]
    second = [{**row, "timestamp": at("2021-06-01 12:00:00")} for row in first]
    second += [{"ip": "4.4.4.4", "url": f"/admin/{i}", "timestamp": at("2021-06-01 12:00:00")} for i in range(12)]

    def latest(result, name, keys):
        jobs.run_to_files(result, str(tmp_path / name), str(tmp_path / f"{name}-ck"), mode="update")
        return jobs.latest_updates(spark, str(tmp_path / name), keys)

    for rows in (first, second):
        make_log(*rows).coalesce(1).write.mode("append").parquet(source)
        stream = lambda: spark.readStream.schema(make_log({}).schema).parquet(source)
        running = latest(jobs.running_risk(jobs.row_findings(stream())), "risk", ["period_start", "ip"])
        counts = latest(jobs.candidate_counts(stream()), "counts", ["period_start", *detectors.COUNT_KEYS])
    got = {(r.ip, r.score, r.risk_score, r.severity) for r in jobs.total_risk(running, counts).collect()}
    want = risk.ip_risk(detectors.all_findings(spark.read.parquet(source))).collect()
    assert got == {(r.ip, r.score, r.risk_score, r.severity) for r in want}
    assert {"1.1.1.1", "2.2.2.2", "3.3.3.3", "4.4.4.4"} <= {ip for ip, *_ in got}
    by_row = [r.ip for r in jobs.total_risk(running).collect()]
    assert len(by_row) == len(set(by_row)) < running.count()
