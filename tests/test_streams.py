"""Continuous folder ingest, exact visitors and exact probed paths of windows."""

import datetime as dt

from conftest import at

from loghelm.sources.datasets import LogStore
from loghelm.streaming import jobs

CLF = '10.0.0.{0} - - [01/Jan/2023:12:00:0{0} +0000] "GET /a{0} HTTP/1.1" 200 {0}\n'
NGINX_ERROR = "2023/01/01 12:00:0{0} [error] 1#1: *1 open() failed, client: 10.0.1.{0}, server: x, request: \"GET /b HTTP/1.1\"\n"


def test_folder_stream(spark, tmp_path):
    """Formats by file, rejected lines and counts in the registry, copies and repeated triggers skipped."""
    raw, store = tmp_path / "raw", LogStore(spark, str(tmp_path / "store"))
    (raw / "deep").mkdir(parents=True)

    def run(checkpoint="ck", **given):
        store.ingest_stream(str(raw), "2023-02-01", str(tmp_path / checkpoint), available_now=True, **given).awaitTermination()
        return {(r.format, r.parsed_lines, r.rejected_lines) for r in store.datasets().collect()}

    (raw / "one.log").write_text("".join(CLF.format(i) for i in range(1, 6)) + "?? no line\n")
    first = run()
    assert len(first) == 1 and {(p, r) for _, p, r in first} == {(5, 1)} and store.log().count() == 5
    (raw / "deep" / "copy.log").write_text((raw / "one.log").read_text())
    (raw / "deep" / "two.log").write_text("".join(NGINX_ERROR.format(i) for i in range(1, 4)))
    (raw / "empty.log").write_text("")
    both = run(files_per_trigger=1)
    assert {(p, r) for _, p, r in both} == {(5, 1), (3, 0)} and len({f for f, *_ in both}) == 2
    assert store.log().count() == 8 and [r.line for r in store.rejects().collect()] == ["?? no line"]
    # All files once more, as after a lost checkpoint; then without the registry, as after a failure before its write.
    assert run("other") == both and store.log().count() == 8
    store._drop(store.registry_path)
    assert run("third") == both and store.log().count() == 8 and store.rejects().count() == 1


def appended(spark, tmp_path, make_log, job, rows, after=dt.timedelta(days=9)):
    log = make_log(*rows)
    log.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda name: spark.readStream.schema(log.schema).parquet(str(tmp_path / name))
    log.limit(0).write.parquet(str(tmp_path / "marks"))
    for mark in (False, True):
        if mark:
            jobs.write_end_mark(log.schema, spark, str(tmp_path / "marks"), max(r["timestamp"] for r in rows) + after)
        result = job(jobs.with_end_marks(stream("in"), stream("marks")))
        query = jobs.run_to_files(result, str(tmp_path / "out"), str(tmp_path / "ck"))
    return spark.read.schema(result.schema).parquet(str(tmp_path / "out")).collect(), query


def test_windows_count_visitors_exactly(spark, make_log, tmp_path):
    base = at("2023-01-01 12:00:00")
    rows = [{"ip": f"1.0.{i % 40}.{i % 250}", "timestamp": base + dt.timedelta(minutes=i % 170), "bytes_sent": i} for i in range(3000)]
    got, _ = appended(spark, tmp_path, make_log, lambda log: jobs.closed_windows(log, "2 hours", "1 hour"), rows)
    want = {}
    for r in rows:
        hour = r["timestamp"].replace(minute=0)
        for start in (hour, hour - dt.timedelta(hours=1)):
            w = want.setdefault(start.replace(tzinfo=None), [0, set(), 0])
            w[0] += 1
            w[1] |= {r["ip"]}
            w[2] += r["bytes_sent"]
    assert {r.window_start: (r.total_requests, r.visitors, r.total_bytes) for r in got} == {k: (n, len(v), b) for k, (n, v, b) in want.items()}


def test_alerts_count_paths_exactly(spark, make_log, tmp_path):
    """Ten paths are medium and eleven high, however often each is probed."""
    base = at("2023-01-01 12:00:00")
    rows = [{"ip": ip, "url": f"/admin/{i % paths}", "timestamp": base} for ip, paths in (("1.1.1.1", 10), ("2.2.2.2", 11)) for i in range(300)]
    rows += [{"ip": "3.3.3.3", "url": "/login", "status_code": 401, "timestamp": base} for _ in range(21)]
    got, _ = appended(spark, tmp_path, make_log, jobs.probe_alerts, rows)
    assert {(r.ip, r.alert, r.hits, r.paths, r.severity) for r in got} == {
        ("1.1.1.1", "directory_enumeration", 300, 10, "medium"), ("2.2.2.2", "directory_enumeration", 300, 11, "high"), ("3.3.3.3", "brute_force", 21, 1, "high"),
    }
