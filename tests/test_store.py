import bz2
import gzip
import hashlib
import re

import pytest
from conftest import at
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from loghelm.operators import panels, reports
from loghelm.operators.filters import Filters, apply_filters
from loghelm.plans import bundles
from loghelm.session import CLUSTER_SETTINGS, scratch_dir
from loghelm.sources.datasets import LogStore
from loghelm.sources.lines import checksums, empty_files, file_heads, list_files, read_lines, spread_lines
from loghelm.streaming import jobs

CLF = '1.1.1.{} - - [10/Oct/2023:13:55:36 +0000] "GET /{} HTTP/1.1" 200 10\n'


@pytest.fixture
def folder(tmp_path):
    raw = tmp_path / "raw logs"
    (raw / "deep").mkdir(parents=True)
    (raw / "a.log").write_text("".join(CLF.format(i, i) for i in range(5)) + "bad line\n")
    (raw / "deep" / "copy of a.log").write_bytes((raw / "a.log").read_bytes())
    (raw / "b.log.gz").write_bytes(gzip.compress("".join(CLF.format(i, "z") for i in range(3)).encode()))
    (raw / "deep" / "c.log.bz2").write_bytes(bz2.compress(CLF.format(9, "c").encode()))
    (raw / "unknown.txt").write_text("10.1.1.1 wants GET /x now\n")
    (raw / "blank.log").write_text("\n  \n")
    (raw / "empty.log").write_text("")
    (raw / "_SUCCESS").write_text("")
    return raw


def test_lines(spark, folder):
    lines = read_lines(spark, str(folder), recursive=True)
    assert lines.count() == 6 + 6 + 3 + 1 + 1 + 2
    with pytest.raises(AnalysisException):
        read_lines(spark, str(folder / "missing")).count()


def test_heads_and_checksums(spark, folder):
    assert list_files(spark, str(folder)).count() == 6
    heads = {r.path.split("/")[-1]: r.n for r in file_heads(list_files(spark, str(folder))).groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert {k.replace("%20", " "): v for k, v in heads.items()} == {
        "blank.log": 2, "a.log": 6, "copy of a.log": 6, "b.log.gz": 3, "c.log.bz2": 1, "unknown.txt": 1}
    sums = [r.checksum for r in checksums(spark, str(folder)).collect()]
    assert len(sums) == 6 and len(set(sums)) == 5
    assert empty_files(spark, str(folder)) == 1


def test_checksums_are_of_the_bytes(spark, tmp_path):
    data = {"one.log": b"a\nb\n" * 400_000, "two.log": b"b\na\n" * 400_000, "three.log.gz": gzip.compress(b"a\nb\n")}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.split("/")[-1]: r.checksum for r in checksums(spark, str(tmp_path)).collect()}
    assert got == {name: hashlib.sha256(content).hexdigest() for name, content in data.items()}


def test_files_of_permuted_lines_are_both_imported(spark, tmp_path):
    lines = [CLF.format(i, i) for i in range(4)]
    (tmp_path / "in").mkdir()
    for name, order in (("a.log", lines), ("b.log", lines[::-1])):
        (tmp_path / "in" / name).write_text("".join(order))
    store = LogStore(spark, str(tmp_path / "store"))
    assert store.ingest_folder(str(tmp_path / "in"), "2024-01-01").first().files_imported == 2
    assert store.log().count() == 8


def test_heads_end_with_a_line(spark, tmp_path):
    long = "x" * 40_000
    (tmp_path / "long.log").write_text(f"short\u2028one\x0bline\r\n{long}\nrest\n")
    rows = file_heads(list_files(spark, str(tmp_path))).orderBy("position").collect()
    assert [r.value for r in rows] == ["short\u2028one\x0bline", long]


def test_bytes_that_are_no_text_are_left_out(spark, tmp_path):
    (tmp_path / "bad.log").write_bytes(b"caf\xe9 one\nca\xc3\xa9 \xef\xbf\xbd two\n")
    assert [r.value for r in read_lines(spark, str(tmp_path / "bad.log")).collect()] == ["caf one", "caé \ufffd two"]


def test_ingest_delete_reset(spark, folder, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    assert store.log().count() == 0 and store.datasets().count() == 0
    first = store.ingest_folder(str(folder), "2024-01-01").first()
    assert tuple(first) == (7, 4, 1, 2, "SUCCESS")
    assert [(r.line, r.path.split("/")[-1] in ("a.log", "copy%20of%20a.log")) for r in store.rejects().collect()] == [("bad line", True)]
    again = store.ingest_folder(str(folder), "2024-01-01").first()
    assert (again.files_imported, again.files_skipped, again.status) == (0, 5, "COMPLETED_NO_IMPORTS")
    datasets = {r.format: r.total_entries for r in store.datasets().where("format != 'clf'").collect()}
    assert datasets == {"UNKNOWN_FORMAT": 1}
    assert store.log().count() == 5 + 3 + 1 + 1
    row = store.datasets().where("file_size > 300").first()
    assert row.confidence == pytest.approx(5 / 6) and row.total_entries == 5
    assert (row.parsed_lines, row.rejected_lines) == (5, 1)
    store.delete(row.id)
    assert store.rejects().count() == 0
    assert store.log().count() == 5 and store.dataset(row.id).count() == 0 and store.datasets().count() == 3
    back = store.ingest_folder(str(folder), "2024-01-01").first()
    assert back.files_imported == 1 and store.log().count() == 10
    inventory = {r.upload_id: (r.entries, r.unique_ips) for r in store.inventory().collect()}
    assert inventory[row.id] == (5, 5)
    assert panels.files_by_format(store.datasets()).count() == 2
    store.reset()
    assert store.log().count() == 0 and store.datasets().count() == 0


def test_partition_and_filter_pushdown(spark, make_log, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    store.append(make_log(dict(upload_id=1), dict(upload_id=2, ip="2.2.2.2")))
    plan = store.log().where("upload_id = 2 AND status_code = 200").select("ip")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(upload_id" in plan and "EqualTo(status_code,200)" in plan
    assert "ReadSchema: struct<ip:string,status_code:int>" in plan


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_days_prune(spark, make_log, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    times = ["2022-12-31 23:59:59", "2023-01-01 00:00:00", "2023-01-02 12:00:00", "2023-01-02 23:59:59", "2023-01-03 00:00:00"]
    log = make_log(*[dict(timestamp=at(time), ip=f"1.1.1.{i}", upload_id=i % 2) for i, time in enumerate(times)])
    store.append(log)
    assert len(list((tmp_path / "store" / "log_entries").glob("upload_id=*/log_day=*/*.parquet"))) == 5
    for only in (Filters(start_date="2023-01-01", end_date="2023-01-02"), Filters(start_date="2023-01-02 12:00:00"), Filters(end_date="2022-12-31")):
        found = apply_filters(store.log(), only)
        assert {r.ip for r in found.collect()} == {r.ip for r in apply_filters(log, only).collect()} != set()
        filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", _plan(found.select("ip"))).group(1)
        assert ("log_day#" in filters) and (">=" in filters) == (only.start_date is not None) and ("<=" in filters) == (only.end_date is not None)
    day = apply_filters(store.log(), Filters(start_date="2023-01-02", end_date="2023-01-02")).select("ip")
    assert len(set(r[0].rsplit("/", 1)[0] for r in day.select(F.input_file_name()).collect())) == 2
    assert reports.traffic_summary(store.log(), Filters(start_date="2023-01-02")).first() == reports.traffic_summary(log, Filters(start_date="2023-01-02")).first()


def test_days_do_not_hang_on_the_zone(spark, make_log, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    store.append(make_log(dict(timestamp=at("2023-01-01 23:30:00")), dict(timestamp=at("1969-12-31 23:30:00"))))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        found = apply_filters(store.log(), Filters(start_date="2023-01-02", end_date="2023-01-02"))
        assert [str(r.log_day) for r in found.collect()] == ["2023-01-01"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {str(r.log_day) for r in store.log().collect()} == {"2023-01-01", "1969-12-31"}


def test_replaced_datasets_keep_no_days(spark, make_log, tmp_path):
    store = LogStore(spark, str(tmp_path / "the store"))
    store.replace_datasets(make_log(dict(upload_id=-7), dict(upload_id=8)), [-7, 8])
    store.replace_datasets(make_log(dict(upload_id=-7, timestamp=at("2024-05-05 00:00:00"))), [-7])
    assert {(r.upload_id, str(r.log_day)) for r in store.log().collect()} == {(-7, "2024-05-05"), (8, "2023-01-01")}


def test_report_file(spark, make_log, tmp_path):
    panels.write_report(panels.panel_report(make_log(dict(), dict())), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).where("panel = 'general'").first().hits == 2


def test_bundles(make_log):
    log = make_log(dict(url="/login", query_string="a;b", response_time_ms=1.0), dict())
    for build in (bundles.overview, bundles.performance, bundles.pages, bundles.visitors, bundles.status_codes):
        for name, frame in build(log).items():
            assert frame.columns, name
    assert bundles.traffic(log).count() == 1
    assert bundles.trends(log, "2023-01-03")["growth"].first().last_7d == 2
    page = bundles.security(log)
    assert page["overview"].first().total_attacks == 1 and page["attack_trends"].first().attacks == 2
    page["findings"].unpersist()


def test_late_rows_are_dropped_and_counted(spark, make_log, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [
        [dict(timestamp=at("2023-01-01 10:05:00"))], [dict(timestamp=at("2023-01-01 14:00:00"))],
        [dict(timestamp=at("2023-01-01 10:06:00"), ip="late")],
    ]
    schema, dropped, late = make_log(*batches[0]).schema, 0, jobs.LateRows()
    spark.streams.addListener(late)
    for rows in batches:
        make_log(*rows).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = jobs.run_to_files(jobs.traffic_windows(stream), out, str(tmp_path / "ck"), mode="update")
        dropped += late.of(query)
    spark.streams.removeListener(late)
    latest = jobs.latest_updates(spark, out, ["window_start"]).orderBy("window_start").collect()
    assert [r.total_requests for r in latest] == [1, 1] and dropped == 1


def test_replayed_lines(spark, make_log, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):
        make_log(dict(), dict(ip="b")).write.mode("append").parquet(source)
        stream = spark.readStream.schema(make_log(dict()).schema).parquet(source)
        jobs.run_to_files(jobs.distinct_lines(stream, ["ip", "url", "timestamp"]), out, str(tmp_path / "ck"))
    assert spark.read.parquet(out).count() == 2


def test_running_risk_grows(spark, make_log, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):
        make_log(dict(query_string="q=<script>")).write.mode("append").parquet(source)
        stream = spark.readStream.schema(make_log(dict()).schema).parquet(source)
        jobs.run_to_files(jobs.running_risk(jobs.row_findings(stream)), out, str(tmp_path / "ck"), mode="update")
    row = jobs.latest_updates(spark, out, ["ip"]).first()
    assert (row.risk_score, row.severity, row.findings) == (50, "high", 2)


def test_scratch_is_under_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_dir(spark, "x")
    assert "/loghelm/x-" in path and path != scratch_dir(spark, "x")
    if shared:
        assert path.startswith(shared.rstrip("/") + "/loghelm/x-")


def test_lookups_skip_row_groups(spark, make_log, tmp_path):
    """An address that is in the range of a file's addresses but not among them reads no row."""
    one = make_log({})
    many = spark.range(0, 400_000, 2, 1).select(F.concat(F.lit("10."), F.lpad(F.col("id").cast("string"), 9, "0")).alias("_ip"))
    rows = one.drop("ip").crossJoin(many).withColumnRenamed("_ip", "ip")
    store = LogStore(spark, str(tmp_path / "store"))
    store.append(rows)

    def rows_read(address):
        found = store.log().where(F.col("ip") == address)
        kept = found.collect()
        scan = found._jdf.queryExecution().executedPlan()
        while scan.children().size():
            scan = scan.children().head()
        found._jdf.collectToPython()
        return len(kept), scan.metrics().apply("numOutputRows").value()

    assert rows_read("10.000000001") == (0, 0)
    found, read = rows_read("10.000000002")
    assert found == 1 and read > 0


def test_lines_of_a_compressed_file_are_dealt_out(spark, tmp_path):
    """An exchange without key lies between the decompression of one file and what follows; plain files have none."""
    text = "".join(f"line {i} {i * 7919 % 1000003}\n" for i in range(50_000))
    (tmp_path / "a.log.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "b.log").write_text("plain\n")
    packed, plain = f"file://{tmp_path}/a.log.gz", f"file://{tmp_path}/b.log"

    def plan(frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    small = {"advisoryPartitionSizeInBytes": "64k", "coalescePartitions.minPartitionSize": "16k"}
    for name, value in small.items():
        spark.conf.set(f"spark.sql.adaptive.{name}", value)
    try:
        lines = spread_lines(spark, [packed, plain])
        assert "RoundRobinPartitioning" in plan(lines) and "RoundRobinPartitioning" not in plan(spread_lines(spark, [plain]))
        assert lines.count() == 50_001
        spread = spread_lines(spark, [packed]).select(F.upper("value").alias("upper"), F.spark_partition_id().alias("task"))
        spread.write.parquet(str(tmp_path / "out"))
        assert spark.read.parquet(str(tmp_path / "out")).select("task").distinct().count() >= 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", CLUSTER_SETTINGS["spark.sql.adaptive.advisoryPartitionSizeInBytes"])
    assert {r.value for r in lines.collect()} == {*text.splitlines(), "plain"}
