import random
import statistics

import numpy as np
import pytest
from conftest import at
from pyspark.sql import functions as F

from loghelm.operators import panels, reports, sessions
from loghelm.operators.filters import Filters
from loghelm.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def morning(make_log):
    def at_time(clock, **values):
        return dict(timestamp=at(f"2024-03-04 {clock}:00"), ip="5.5.5.1", **values)

    return make_log(
        at_time("08:10", url="/start", bytes_sent=300, response_time_ms=20.0),
        at_time("08:25", url="/item/77", bytes_sent=700, response_time_ms=40.0),
        at_time("08:50", url="/start", bytes_sent=200, response_time_ms=60.0, user_agent="Pingdom/1") | dict(ip="5.5.5.2"),
        at_time("09:40", url="/gone", bytes_sent=50, response_time_ms=80.0, status_code=404),
        at_time("09:55", url="/order", bytes_sent=10, response_time_ms=1000.0, status_code=503, method="POST",
                user_agent="Wget/1.21") | dict(ip="5.5.5.3"),
        at_time("11:00", url="/start", bytes_sent=240, response_time_ms=100.0),
        at_time("11:05", url="/item/78", bytes_sent=0, response_time_ms=120.0, status_code=302),
    )


def test_traffic(morning):
    assert tuple(reports.traffic_summary(morning).first()) == (7, 4, 3, 1500)
    hours = reports.traffic_over_time(morning, "hour").collect()
    assert [r.total_requests for r in hours] == [3, 2, 2]
    assert reports.traffic_over_time(morning, "century").count() == 3
    assert tuple(reports.traffic_summary(morning, Filters(bot_classification="monitoring_bot")).first())[0] == 1


def test_sessions_of_a_morning(morning):
    row = sessions.session_summary(morning).first()
    assert (row.total_sessions, row.returning_visitors) == (5, 1)
    assert {r.url: r["count"] for r in sessions.entry_pages(morning).collect()} == {"/start": 3, "/gone": 1, "/order": 1}
    assert {"/item/77", "/item/78"} < {r.url for r in sessions.exit_pages(morning).collect()}
    assert {r.url: r.bounce_count for r in sessions.bounce_pages(morning).collect()} == {"/gone": 1, "/start": 1, "/order": 1}


def test_latency(morning):
    row = reports.latency_percentiles(morning).first()
    assert row.median_response_time == 80.0 and 120 < row.p99_response_time <= 1000
    assert reports.latency_percentiles(morning, approx=True).first().avg_response_time == pytest.approx(1420 / 7)
    empty = reports.latency_percentiles(morning.where("ip = 'none'")).first()
    assert set(empty) == {0.0}


def test_status(morning):
    row = reports.status_rates(morning).first()
    assert [round(v, 2) for v in row] == [71.43, 14.29, 14.29]
    assert set(reports.status_rates(morning.where("false")).first()) == {0.0}
    counts = {r.status_code: r["count"] for r in reports.status_distribution(morning).collect()}
    assert counts == {200: 4, 302: 1, 404: 1, 503: 1}


def test_urls_and_visitors(morning):
    assert [tuple(r) for r in reports.top_urls(morning, 2).collect()] == [("/start", 3), ("/gone", 1)]
    assert ("/item/{id}", 2) in [tuple(r) for r in reports.top_urls(morning, 9, normalized=True).collect()]
    assert tuple(reports.top_ips(morning, 1).first()) == ("5.5.5.1", 5)


def test_trends(morning):
    assert tuple(reports.peak_hours(morning).first()) == (8, 3)
    assert reports.moving_average(morning).first().moving_avg_7d == 7.0
    assert tuple(reports.traffic_growth(morning, "2024-03-08").first()) == (7, 0, 0.0)
    assert tuple(reports.traffic_growth(morning, "2024-03-12").first()) == (0, 7, -100.0)


def test_growth_reads_two_weeks(morning, tmp_path):
    morning.write.parquet(str(tmp_path / "log"))
    stored = morning.sparkSession.read.parquet(str(tmp_path / "log"))
    plan = reports.traffic_growth(stored, "2024-03-08")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp,2024-02-23" in plan


def test_fastest_endpoints_force_no_broadcast(morning):
    plan = reports.fastest_endpoints(morning)._jdf.queryExecution().logical().toString()
    assert "strategy=broadcast" not in plan


def test_explorer(make_log):
    log = make_log(*[dict(url=f"/{i}", response_time_ms=None if i == 3 else float(i)) for i in range(5)])
    rows = reports.log_explorer(log, sort_by="response_time_ms", limit=2, offset=3).collect()
    assert [r.url for r in rows] == ["/0", "/3"]
    assert reports.log_explorer(log, sort_by="drop table").count() == 5


@pytest.mark.parametrize("sort_by, descending", [("response_time_ms", True), ("response_time_ms", False), ("url", True)])
def test_pages_by_the_last_row(make_log, sort_by, descending):
    log = make_log(*[dict(url=f"/{i % 4}", ip=f"1.1.1.{i}", response_time_ms=None if i % 3 == 0 else float(i % 5),
                          user_agent=None if i % 2 else "x") for i in range(23)])
    whole = reports.log_explorer(log, sort_by=sort_by, descending=descending).collect()
    pages, after = [], None
    while page := reports.log_explorer(log, sort_by=sort_by, descending=descending, limit=5, after=after).collect():
        pages += page
        after = page[-1].asDict()
    assert pages == whole


def test_two_visitors(make_log):
    def visit(ip, minutes, status=200):
        hour, minute = divmod(minutes, 60)
        return dict(ip=ip, timestamp=at(f"2022-06-07 {6 + hour:02}:{minute:02}:00"), status_code=status, upload_id=4)

    log = make_log(
        *[visit("7.7.7.7", m) for m in (41, 0, 100, 12, 95)], visit("8.8.8.8", 3), visit("8.8.8.8", 4, 404), visit("8.8.8.8", 50, 500)
    )
    only = Filters(upload_id=4)
    assert tuple(reports.traffic_summary(log, only).first()) == (8, 6, 2, 800)
    row = sessions.session_summary(log, filters=only).first()
    assert (row.total_sessions, row.returning_visitors) == (4, 2)
    assert tuple(reports.status_rates(log, only).first()) == (75.0, 12.5, 12.5)


def test_filters(make_log):
    log = make_log(
        dict(timestamp=at("2023-01-02 23:59:59.999999"), user_agent="A%B"),
        dict(timestamp=at("2023-01-03 00:00:00"), user_agent="AxB", status_code=0),
    )
    def count(**f):
        return reports.log_explorer_count(log, Filters(**f)).first().total

    assert count(end_date="2023-01-02") == 1
    assert count(end_date="2023-01-03T00:00:00") == 2
    assert count(start_date="2023-01-03") == 1
    assert count(user_agent="A%B") == 1 and count(user_agent="a%b") == 0
    assert count(status_code=0) == 2
    assert count(upload_id=5, dataset_id=1) == 0 and count(dataset_id=1) == 2


def test_gap_boundaries(make_log):
    exact = make_log(dict(timestamp=at("2023-01-01 00:00:00")), dict(timestamp=at("2023-01-01 00:30:00")))
    over = make_log(dict(timestamp=at("2023-01-01 00:00:00")), dict(timestamp=at("2023-01-01 00:30:00.000001")))
    same = make_log(dict(), dict(url="/b"))
    assert [sessions.session_table(log).count() for log in (exact, over, same)] == [1, 2, 1]
    assert {r.session_id for r in sessions.sessionize(same).collect()} == {"1-1.1.1.1-Mozilla/5.0-1"}


def test_numbering_across_visitors(make_log):
    log = make_log(
        dict(user_agent="Kiosk", timestamp=at("2021-05-01 07:29:00"), url="/b"),
        dict(user_agent="Kiosk", timestamp=at("2021-05-01 07:00:00"), url="/a"),
        dict(user_agent="Tablet", ip="3.3.3.3", timestamp=at("2021-05-01 07:05:00"), url="/z"),
        dict(user_agent="Kiosk", timestamp=at("2021-05-01 08:10:00"), url="/c"),
    )
    assert tuple(sessions.session_metrics(log).first()) == (3, 580.0, 4 / 3)
    rows = sessions.numbered_sessions(log).orderBy("session_id").collect()
    assert [(r.session_id, r.entry_url, r.exit_url) for r in rows] == [("s_1", "/a", "/b"), ("s_2", "/z", "/z"), ("s_3", "/c", "/c")]


def test_rows_without_dataset_or_address_keep_their_sessions(make_log):
    log = make_log(dict(), dict(url="/b")).withColumn("upload_id", F.lit(None).cast("long")).withColumn("ip", F.lit(None).cast("string"))
    assert [r.session_id_num for r in sessions.sessionize(log).collect()] == [1, 1]


@pytest.mark.parametrize("timeout, slot", [(1800, None), (1800, 60), (7, None), (0, None)])
def test_sessions_against_brute_force(spark, make_log, timeout, slot):
    chance = random.Random(timeout)
    base = at("2023-01-01 00:00:00").timestamp()
    visits = [
        (chance.choice(["a", "b"]), chance.choice([None, "x"]), base + chance.choice([0, 1]) * 86400 + chance.randrange(9000))
        for _ in range(300)
    ]
    import datetime as dt
    log = make_log(*[
        dict(ip=ip, user_agent=ua, timestamp=dt.datetime.fromtimestamp(t, dt.timezone.utc)) for ip, ua, t in visits
    ])
    want, last, number = {}, {}, {}
    for ip, ua, t in sorted(visits, key=lambda v: v[2]):
        key = (ip, ua or "unknown")
        if key not in last or t - last[key] > timeout:
            number[key] = number.get(key, 0) + 1
        last[key] = t
        want[key + (t,)] = number[key]
    got = sessions.sessionize(log, timeout, slot).collect()
    assert len(got) == 300
    assert {(r.ip, r.ua_fixed, r.timestamp.replace(tzinfo=dt.timezone.utc).timestamp()): r.session_id_num for r in got} == want
    starts = sum(r.is_new_session for r in got)
    assert starts == sum(number.values()) == sessions.session_table(log, timeout).count()


def test_filter_does_not_renumber(make_log):
    log = make_log(
        dict(timestamp=at("2023-01-01 10:00:00"), url="/a"),
        dict(timestamp=at("2023-01-01 10:20:00"), url="/b", status_code=404),
        dict(timestamp=at("2023-01-01 10:40:00"), url="/c"),
    )
    row = sessions.session_summary(log, filters=Filters(status_code=200)).first()
    assert (row.total_sessions, row.avg_pages_per_session, row.avg_session_duration_sec) == (1, 2.0, 2400.0)


def test_quantiles_against_numpy(spark):
    chance = np.random.default_rng(7)
    groups = {
        "normal": chance.normal(0, 50, 500), "skew": np.concatenate([np.full(900, 3.5), chance.lognormal(3, 2, 100)]),
        "one": np.array([-2.5]), "ints": chance.integers(0, 5, 400).astype(float), "tiny": chance.random(50) * 1e-9,
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("normal", None), (None, 1.0), (None, 2.0)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probabilities = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    got = {r.g: r for r in exact_quantiles(frame, "v", probabilities, ["g"]).collect()}
    for name, values in {**groups, None: np.array([1.0, 2.0])}.items():
        assert got[name].n == len(values)
        assert [got[name][q] for q in probabilities] == pytest.approx(list(np.quantile(values, list(probabilities.values()))))
        assert got[name]["mean"] == pytest.approx(statistics.fmean(values))


def test_panels(make_log):
    log = make_log(
        dict(user_agent=None), dict(user_agent=None), dict(user_agent="curl"),
        dict(upload_id=2, user_agent="curl", url="/x"), dict(upload_id=2, url=""),
    )
    rows = {(r.panel, r.key): (r.hits, r.visitors, r.bytes) for r in panels.panel_report(log).collect()}
    assert rows["general", "total"] == (5, 3, 500)
    assert rows["requests", "/"] == (3, 2, 300) and rows["browsers", "cURL"] == (2, 1, 200)
    by = panels.panel_report(log, by=["upload_id"])
    one, two = (by.where(F.col("upload_id") == i).drop("upload_id") for i in (1, 2))
    merged = {(r.panel, r.key): (r.hits, r.visitors, r.bytes) for r in panels.merge_reports([one, two]).collect()}
    assert merged["general", "total"] == (5, 4, 500)  # the curl visitor is in both reports
    assert ("requests", "") not in merged and ("requests", "") in rows
    assert panels.merge_reports([]) is None and panels.merge_reports([one]) is one
    sketched = panels.merge_sketches(panels.panel_sketches(log, by=["upload_id"]).drop("upload_id"))
    got = {(r.panel, r.key): (r.hits, r.visitors) for r in sketched.collect()}
    assert got["general", "total"] == (5, 3)


def test_sketches_are_close(spark):
    from loghelm.sources.access_view import read_access_log

    log = read_access_log(spark, "/root/testdata/sf0.001")
    exact = {(r.panel, r.key): r.visitors for r in panels.panel_report(log).collect()}
    sketched = panels.merge_sketches(panels.panel_sketches(log, by=["upload_id"]).drop("upload_id"))
    for r in sketched.collect():
        assert r.visitors == pytest.approx(exact[r.panel, r.key], rel=0.02, abs=1)
