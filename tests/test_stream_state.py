"""What streams keep: compacted updates, open sessions, moving risk, mergeable latencies."""

import datetime as dt

import pytest
from conftest import at
from pyspark.sql import functions as F

from loghelm.operators import latency_sketches as sketches
from loghelm.streaming import jobs
from loghelm.streaming.moving import moving_risk, rocksdb_state
from loghelm.streaming.updates import compact_updates, latest_updates, write_updates


def folders(path, pattern):
    return sorted(int(p.name.split("=")[1]) for p in path.glob(pattern))


def put(spark, path, number, rows):
    spark.createDataFrame(rows, "k string, v long").write.mode("overwrite").parquet(f"{path}/batch={number}")


def shown(spark, path):
    return {(r.k, r.v) for r in latest_updates(spark, str(path), ["k"]).collect()}


def test_compaction_keeps_the_newest_rows(spark, tmp_path):
    path = tmp_path / "out"
    with pytest.raises(FileNotFoundError):
        latest_updates(spark, str(path), ["k"])
    put(spark, path, 0, [("a", 1), (None, 1)])
    put(spark, path, 1, [("b", 1), ("a", 2)])
    put(spark, path, 2, [(None, 3)])
    put(spark, path, 3, [])
    want = {("a", 2), ("b", 1), (None, 3)}
    assert shown(spark, path) == want
    planned = latest_updates(spark, str(path), ["k"])  # before the step
    compact_updates(spark, str(path), ["k"], 1)
    assert shown(spark, path) == want and {(r.k, r.v) for r in planned.collect()} == want
    assert folders(path, "batch=*") == [0, 1, 2, 3] and folders(path / "_base", "upto=*") == [1]
    # A base without its mark doesn't count, and is replaced later on.
    spark.createDataFrame([("a", 99, 3)], "k string, v long, batch long").write.parquet(f"{path}/_base/upto=3")
    (path / "_base" / "upto=3" / "_SUCCESS").unlink()
    assert shown(spark, path) == want
    compact_updates(spark, str(path), ["k"], 3)
    assert shown(spark, path) == want
    assert folders(path, "batch=*") == [2, 3] and folders(path / "_base", "upto=*") == [1, 3]
    put(spark, path, 4, [("a", 5)])
    compact_updates(spark, str(path), ["k"], 2)  # older than the base: nothing to do
    assert shown(spark, path) == {("a", 5), ("b", 1), (None, 3)}
    # A late repeat of a batch that the base holds changes nothing.
    put(spark, path, 1, [("b", 1), ("a", 2)])
    assert shown(spark, path) == {("a", 5), ("b", 1), (None, 3)}


def test_streams_compact_their_updates(spark, make_log, tmp_path):
    """Twelve batches, of which at most a few are left to read."""
    for i in range(12):
        make_log(*[{"ip": f"1.1.1.{j}", "timestamp": at("2023-01-01 12:00:00") + dt.timedelta(minutes=i)} for j in range(i + 1)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = stream.groupBy("ip").agg(F.count(F.lit(1)).alias("hits"))
    write_updates(counts, str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True, keys=["ip"], compact_every=3).awaitTermination()
    got = {r.ip: r.hits for r in latest_updates(spark, str(tmp_path / "out"), ["ip"]).collect()}
    assert got == {f"1.1.1.{j}": 12 - j for j in range(12)}
    assert len(folders(tmp_path / "out", "batch=*")) <= 7 and len(folders(tmp_path / "out" / "_base", "upto=*")) == 2
    assert len(latest_updates(spark, str(tmp_path / "out"), ["ip"]).inputFiles()) < 40


def test_open_sessions_complete_the_closed_ones(spark, make_log, tmp_path):
    base = at("2023-01-01 12:00:00")
    rows = [{"ip": f"1.0.0.{i % 5}", "user_agent": None if i % 5 == 1 else "x", "timestamp": base + dt.timedelta(minutes=i % 5 * 40 + i)} for i in range(40)]
    log = make_log(*rows)
    log.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    result = jobs.visitor_sessions(stream)
    jobs.run_to_files(result, str(tmp_path / "out"), str(tmp_path / "ck"))
    closed = spark.read.schema(result.schema).parquet(str(tmp_path / "out")).collect()
    still_open = jobs.open_sessions(spark, str(tmp_path / "ck")).collect()
    assert closed and still_open and sum(r.hits for r in closed + still_open) == 40
    last = max(r["timestamp"] for r in rows).replace(tzinfo=None)
    assert all(r.ended + dt.timedelta(minutes=40) > last for r in still_open)
    assert all(r.ended + dt.timedelta(minutes=40) <= last for r in closed)


def test_risk_leaves_with_its_period(spark, tmp_path):
    """Totals fall as days leave, down to 0, and the state of days that have left is gone."""
    folder, schema = str(tmp_path / "in"), "ip string, timestamp timestamp, severity string"

    def add(*rows):
        rows = [(ip, day and dt.datetime(2023, 1, day, 12), severity) for ip, day, severity in rows]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        with rocksdb_state(spark):
            risk = moving_risk(spark.readStream.schema(schema).parquet(folder), dt.timedelta(days=5))
            jobs.run_to_files(risk, str(tmp_path / "out"), str(tmp_path / "ck"), mode="update", keys=["ip"])
        latest = latest_updates(spark, str(tmp_path / "out"), ["ip"]).collect()
        state = spark.read.format("statestore").option("stateVarName", "days").load(str(tmp_path / "ck"))
        return {r.ip: (r.score, r.risk_score, r.severity, r.findings) for r in latest}, state.count()

    hot = [("9.9.9.9", 2, "low")] * 3000
    got, days = add(("1.1.1.1", 1, "critical"), ("1.1.1.1", 3, "high"), (None, 3, "high"), ("1.1.1.1", None, "high"), *hot)
    assert got == {"1.1.1.1": (65, 65, "high", 2), "9.9.9.9": (15000, 100, "critical", 3000)} and days == 3
    got, days = add(("2.2.2.2", 9, "medium"), ("1.1.1.1", 3, "unheard"))
    # Day 1 and 2 end five days before the 8th, the watermark's day; day 3 does not.
    assert got == {"1.1.1.1": (30, 30, "medium", 2), "2.2.2.2": (10, 10, "low", 1), "9.9.9.9": (0, 0, "low", 0)} and days == 2
    got, days = add(("2.2.2.2", 28, "medium"), ("3.3.3.3", 2, "high"))
    assert got == {"1.1.1.1": (0, 0, "low", 0), "2.2.2.2": (10, 10, "low", 1), "9.9.9.9": (0, 0, "low", 0)} and days == 1
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or "")


def test_days_of_an_address_leave_at_one_timer(spark, tmp_path):
    """Days that leave in one batch are one change of their address, and the timer of the next day is set then."""
    folder, schema = str(tmp_path / "in"), "ip string, timestamp timestamp, severity string"

    def add(*rows):
        rows = [(ip, dt.datetime(2023, 1, 1, 12) + dt.timedelta(days=day - 1), "medium") for ip, day in rows]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        before = set(folders(tmp_path / "out", "batch=*")) if (tmp_path / "out").exists() else set()
        with rocksdb_state(spark):
            risk = moving_risk(spark.readStream.schema(schema).parquet(folder), dt.timedelta(days=5))
            jobs.run_to_files(risk, str(tmp_path / "out"), str(tmp_path / "ck"), mode="update")
        new = [r for name in set(folders(tmp_path / "out", "batch=*")) - before for r in spark.read.parquet(str(tmp_path / "out" / f"batch={name}")).collect()]
        state = spark.read.format("statestore").option("stateVarName", "days").load(str(tmp_path / "ck"))
        return sorted((r.ip, r.findings) for r in new), state.count()

    # The watermark is the 29th at noon: days 1 to 23 have ended five days before it, days 24 to 30 have not.
    assert add(*[("1.1.1.1", day) for day in range(1, 31)]) == ([("1.1.1.1", 7), ("1.1.1.1", 30)], 7)
    assert add(("2.2.2.2", 33)) == ([("1.1.1.1", 4), ("2.2.2.2", 1)], 5)
    assert add(("1.1.1.1", 33), ("2.2.2.2", 60)) == ([("1.1.1.1", 0), ("1.1.1.1", 5), ("2.2.2.2", 1), ("2.2.2.2", 2)], 1)


def test_merged_latencies(spark, make_log):
    """Sketches of small groups are exact; merged ones of many rows are within the stated error; nulls take no part."""
    few = make_log(*[{"ip": str(i % 2), "response_time_ms": float(i) if i % 3 else None} for i in range(60)])
    parts = sketches.latency_sketches(few, ["upload_id", "ip"])
    whole = sketches.sketched_quantiles(sketches.merge_latencies(parts)).first()
    values = sorted(float(i) for i in range(60) if i % 3)
    assert whole.timed_requests == 40 and whole.avg_response_time == sum(values) / 40
    assert whole.median_response_time in values[19:21] and whole.p99_response_time == values[-1]
    assert sketches.latency_sketches(few.where("response_time_ms IS NULL"), ["ip"]).count() == 0
    many = spark.range(400_000, numPartitions=16).select(
        F.lit(1).alias("one"), (F.col("id") % 20).alias("part"), F.pow(F.rand(5), 4).alias("response_time_ms")
    )
    merged = sketches.sketched_quantiles(sketches.merge_latencies(sketches.latency_sketches(many, ["one", "part"]), ["one"]))
    assert all(sketches.within_rank_error(merged, many, ["one"]).first())
    size = sketches.latency_sketches(many, ["one"]).select(F.length("latencies")).first()[0]
    assert size < 40_000
