import json

import pytest

from loghelm.operators import risk
from loghelm.operators.detectors import all_findings, detect_brute_force, match_rows, native_row_rules
from loghelm.operators.filters import Filters
from loghelm.operators.rule_pack import DEFAULT_RULES, default_pack
from loghelm.operators.sigma import compile_pack, condition_sql, load_rules, sigma_findings, with_rule_text


@pytest.fixture(scope="module")
def attacks(make_log):
    probes = [dict(ip="203.0.113.1", url=f"{u}/{i}", status_code=404 if i else 200)
              for u in ("/ADMIN", "/site/backup", "/x/.git") for i in range(3)]
    logins = [dict(ip="203.0.113.2", method="POST", url="/account/SignIn", status_code=401)] * 7
    return make_log(
        *probes, *logins,
        dict(ip="203.0.113.3", url="/list", query_string="sort=1 Union Select name"),
        dict(ip="203.0.113.3", url="/list", query_string="next=JavaScript:void"),
        dict(ip="203.0.113.4", user_agent="WFuzz 3"),
        dict(ip="203.0.113.5", url="/tool", query_string="host=a&&b"),
        dict(ip="203.0.113.6", url="/read", query_string="name=..%2fsecret"),
        dict(ip="203.0.113.7"),
    )


def test_each_detector_fires(attacks):
    rows = all_findings(attacks).collect()
    assert len({r.rule_title for r in rows}) == 7
    by_rule = {r.rule_id: r for r in rows}
    assert by_rule["custom_brute_force"].evidence == ["7 failed logins, 7 total attempts on /account/SignIn"]
    assert by_rule["custom_directory_enumeration"].evidence == ["Probed 9 sensitive paths, 6 404s"]
    assert by_rule["custom_sqli"].evidence == ["URL: /list, Query: sort=1 Union Select name"]
    assert by_rule["custom_scanner"].evidence == ["Scanner UA: WFuzz 3, requests: 1"]


def test_findings_scan_the_log_once(spark, attacks, tmp_path):
    attacks.write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = all_findings(log, default_pack().rules)._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path / "log") not in plan  # only what the one scan has stored is read again


def test_risk_and_overview(attacks):
    findings = all_findings(attacks)
    scores = {r.ip: r for r in risk.ip_risk(findings).collect()}
    assert set(scores) == {f"203.0.113.{i}" for i in range(1, 7)}
    assert (scores["203.0.113.3"].risk_score, scores["203.0.113.3"].severity) == (65, "high")
    assert (scores["203.0.113.2"].risk_score, scores["203.0.113.2"].severity) == (10, "low")
    overview = risk.security_overview(findings).first()
    assert (overview.total_attacks, overview.suspicious_ips_count) == (findings.count(), 6)
    assert risk.attack_trends(attacks, findings).first().attacks == attacks.count() - 1
    assert risk.ip_findings(findings).count() == findings.count()


def test_score_is_capped(make_log):
    log = make_log(*[dict(query_string="a;b")] * 5)
    row = risk.ip_risk(match_rows(log, native_row_rules())).first()
    assert (row.score, row.risk_score, row.severity) == (200, 100, "critical")


def test_payload_in_protocol(make_log):
    log = make_log(dict(protocol="<script>alert(1)</script>"))
    assert [r.rule_id for r in match_rows(log, native_row_rules()).collect()] == ["custom_xss"]


def test_brute_force_thresholds(make_log):
    log = make_log(
        *[dict(ip="few", url="/signin", status_code=401)] * 5, *[dict(ip="tried", url="/AUTH")] * 11,
        *[dict(ip="many", url="/login")] * 51, *[dict(ip="ten", url="/login")] * 10,
    )
    got = {r.ip: r.severity for r in detect_brute_force(log).collect()}
    assert got == {"tried": "medium", "many": "high"}
    assert detect_brute_force(log, Filters(ip="few")).count() == 0


def rule(condition="s", **selections):
    return {"id": "r", "title": "R", "level": "low", "detection": {**selections, "condition": condition}}


def hits(log, one):
    pack = compile_pack([one])
    assert not pack.failed, pack.failed
    return sorted(r.ip for r in sigma_findings(log, pack).collect())


@pytest.fixture(scope="module")
def four(make_log):
    return make_log(
        dict(ip="10.0.0.1", url="/a.exe", query_string="X=1&y=2", user_agent="Agent One", method="GET"),
        dict(ip="10.0.1.1", url="/b*c", query_string=None, user_agent=None, method="POST", status_code=404),
        dict(ip="192.168.0.1", url="/50%_x", query_string="y=2", user_agent="agent two", referrer="http://r/\\back"),
        dict(ip="host", url="/plain", host="files.example.com"),
    )


ALL = ["10.0.0.1", "10.0.1.1", "192.168.0.1", "host"]


@pytest.mark.parametrize(
    "detection, expected",
    [
        (rule(s={"c-useragent": "AGENT ONE"}), ["10.0.0.1"]),
        (rule(s={"c-useragent": "agent*"}), ["10.0.0.1", "192.168.0.1"]),
        (rule(s={"c-useragent": "agent ?wo"}), ["192.168.0.1"]),
        (rule(s={"c-useragent": None}), ["10.0.1.1"]),
        (rule(s={"c-useragent": [None, "agent two"]}), ["10.0.1.1", "192.168.0.1"]),
        (rule(s={"c-uri": "/b\\*c"}), ["10.0.1.1"]),
        (rule(s={"c-uri|contains": "0%_"}), ["192.168.0.1"]),
        (rule(s={"c-uri-extension": "exe"}), ["10.0.0.1"]),
        (rule(s={"cs-referer|endswith": "\\back"}), ["192.168.0.1"]),
        (rule(s={"sc-status": 404}), ["10.0.1.1"]),
        (rule(s={"sc-status": [404, 200], "cs-method": "get"}), ["10.0.0.1", "192.168.0.1", "host"]),
        (rule(s={"cs-uri-query|contains|all": ["x=", "Y="]}), ["10.0.0.1"]),
        (rule(s={"c-uri|re": "^/[ab]\\W"}), ["10.0.0.1", "10.0.1.1"]),
        (rule(s={"src_ip|cidr": "10.0.0.0/24"}), ["10.0.0.1"]),
        (rule(s={"c-uri|contains": ["${env:HOME}", "\\u0041", "it's", "pla"]}), ["host"]),
        (rule("not s", s={"cs-host|endswith": ".example.com"}), ALL[:3]),
        (rule(s=[{"cs-method": "POST"}, {"c-uri|startswith": "/PL"}]), ["10.0.1.1", "host"]),
        (rule("keywords", keywords=["agent", "/plain"]), ["10.0.0.1", "192.168.0.1", "host"]),
        (rule("keywords", keywords=["a?ent*one"]), ["10.0.0.1"]),
        (rule("1 of s*", s1={"cs-method": "POST"}, s2={"c-uri": "/plain"}), ["10.0.1.1", "host"]),
        (rule("all of s*", s1={"cs-method": "GET"}, s2={"c-uri": "/plain"}), ["host"]),
        (rule("all of them", a={"cs-method": "GET"}, b={"c-uri": "/plain"}), ["host"]),
        (rule("1 of them", a={"cs-method": "POST"}, b={"c-uri": "/plain"}), ["10.0.1.1", "host"]),
        (rule("a and not (b or 1 of c_*)", a={"sc-status": 200}, b={"c-uri": "/plain"}, c_1={"c-uri|endswith": "exe"}),
         ["192.168.0.1"]),
        (rule("a or b and c", a={"c-uri": "/plain"}, b={"cs-method": "GET"}, c={"c-uri|endswith": "EXE"}), ["10.0.0.1", "host"]),
    ],
)
def test_rule_semantics(four, detection, expected):
    assert hits(four, detection) == sorted(expected)


@pytest.mark.parametrize(
    "bad",
    [
        rule(s={"nothing": "x"}), rule(s={"c-uri|base64offset": "x"}), rule("t", s={"c-uri": "x"}),
        rule("s | count() > 5", s={"c-uri": "x"}), rule("s and", s={"c-uri": "x"}), rule(s={"c-uri|re": "["}), rule(s={}), {"id": "n", "detection": {"s": {"c-uri": "x"}}},
    ],
)
def test_bad_rules_are_isolated(bad):
    pack = compile_pack([bad, {**rule(s={"c-uri": "x"}), "id": "good"}])
    assert len(pack.failed) == 1 and [r.rule_id for r in pack.rules] == ["good"]


def test_condition_text():
    tests = {"sel_a": "(a)", "sel_b": "(b)", "flt": "(c)"}
    assert condition_sql("1 of sel_* AND NOT flt", tests) == "((a) or (b)) and not ((c))"
    assert condition_sql("all of sel_*", tests) == "((a) and (b))"


def test_rule_directory(tmp_path, four):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "one.json").write_text(json.dumps(rule(s={"c-uri": "/plain"})))
    (tmp_path / "two.json").write_text(json.dumps(rule(s={"c-uri": "/plain"})))
    (tmp_path / "none.json").write_text(json.dumps({"id": "x", "title": "no detection"}))
    (tmp_path / "broken.json").write_text("{")
    pack = load_rules(str(tmp_path))
    assert [r.rule_id for r in pack.rules] == ["r"] and pack.rules[0].status == "experimental"
    assert set(pack.failed) == {"two.json", "broken.json"} and pack.ignored == ["x"]
    assert sigma_findings(four, pack).count() == 1
    pytest.importorskip("yaml")
    (tmp_path / "three.yml").write_text(
        "id: y\ntitle: Y\nlevel: high\ndetection:\n  s:\n    cs-uri|contains:\n      - plain\n  condition: s\n")
    assert [r.rule_id for r in load_rules(str(tmp_path)).rules] == ["r", "y"]


def test_rule_texts_are_joined(four):
    pack = compile_pack([{**rule(s={"c-uri": "/plain"}), "filename": "a/b.yml", "status": "test"}])
    (row,) = with_rule_text(all_findings(four, pack.rules), pack.rules).where("rule_id = 'r'").collect()
    assert (row.status, row.filename) == ("test", "a/b.yml") and json.loads(row.rule_source)["title"] == "R"


def test_pattern_that_only_python_takes_fails_alone(four):
    pack = compile_pack([{**rule(s={"c-uri|re": "(?P<x>a)"}), "id": "python"}, {**rule(s={"c-uri|re": "(?<x>pla)"}), "id": "java"}])
    assert list(pack.failed) == ["python"] and [r.rule_id for r in sigma_findings(four, pack).collect()] == ["java"]


def test_pack_uses_every_comparison():
    text = json.dumps(DEFAULT_RULES)
    for word in ("|startswith", "|endswith", "|contains", "|all", "|re", "|cidr", "null", "1 of ", "all of ", "them", "*bot", "keywords"):
        assert word in text, word


def test_more_rules_than_bits(four):
    many = [{**rule(s={"c-uri": "/plain"}), "id": f"r{i}"} for i in range(130)]
    rows = sigma_findings(four, compile_pack(many)).collect()
    assert sorted(r.rule_id for r in rows) == sorted(r["id"] for r in many)


def test_empty_pack_and_default_pack(four):
    assert sigma_findings(four, compile_pack([])).count() == 0
    pack = default_pack()
    assert len(pack.rules) == len(DEFAULT_RULES) and not pack.failed
