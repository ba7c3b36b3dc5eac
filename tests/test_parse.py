from conftest import naive

from loghelm.operators import parse as p
from loghelm.operators.detect_format import detect_formats, sample_lines


def parsed(spark, format_name, *lines):
    frame = spark.createDataFrame([(line,) for line in lines], "value string")
    return p.parse(frame, format_name, "2024-01-01").drop("value").collect()


def test_apache(spark):
    full, dashes, odd, bad, size = parsed(
        spark, "apache_access",
        '203.0.113.9 - mira [03/Feb/2021:04:05:06 +0200] "GET /docs/a%20b.pdf?page=3 HTTP/1.1" 206 1234 "https://example.org/x" "Reader/2.1 (Plan9)" 45000',
        '198.51.100.7 - - [03/Feb/2021:04:05:06 +0200] "HEAD /up HTTP/1.0" 304 - "-" "-"',
        '1.1.1.1 - - [03/Feb/2021:04:05:06 +0200] "PUT /c d <y>" 200 1 "-" "UA"',
        "words and nothing else",
        '1.1.1.1 - - [03/Feb/2021:04:05:06 +0200] "GET / HTTP/1.1" 200 5x "-" "UA"',
    )
    assert (full.ip, full.method, full.url, full.query_string) == ("203.0.113.9", "GET", "/docs/a b.pdf", "page=3")
    assert (full.status_code, full.bytes_sent, full.response_time_ms) == (206, 1234, 45.0)
    assert (full.referrer, full.user_agent) == ("https://example.org/x", "Reader/2.1 (Plan9)")
    assert naive(full.timestamp) == "2021-02-03 02:05:06" and full.protocol == "HTTP/1.1"
    assert (dashes.bytes_sent, dashes.referrer, dashes.user_agent, dashes.response_time_ms) == (0, None, None, None)
    assert (odd.method, odd.url, odd.protocol, odd.parsed) == ("PUT", "/c d <y>", "UNKNOWN", True)
    assert not bad.parsed and not size.parsed


def test_unusual_separators_are_characters(spark):
    first, second = parsed(
        spark, "apache_access",
        '9.9.9.9 - - [03/Feb/2021:04:05:06 +0200] "GET /a HTTP/1.1" 200 1 "-" "Agent\u2028Two" \u2029 rest\u0085',
        '9.9.9.9 - - [03/Feb/2021:04:05:06 +0200] "GET /a\u0085b HTTP/1.1" 200 1 "-" "x"',
    )
    assert first.parsed and first.user_agent == "Agent\u2028Two"
    assert second.parsed and "\u0085" in second.url
    (error,) = parsed(spark, "apache_error", "[Wed Feb  3 04:05:06 2021] [error] [client 9.9.9.9] half\u0085 other half")
    assert error.parsed and error.ip == "9.9.9.9"


def test_decoded_newlines_stay_in_their_field(spark):
    (row,) = parsed(spark, "clf", '9.9.9.9 - - [03/Feb/2021:04:05:06 +0200] "GET /a%0Ab?c=%0d%0Ad HTTP/1.1" 200 1')
    assert (row.url, row.query_string, row.status_code) == ("/a\nb", "c=\r\nd", 200)


def test_leftmost_match_wins(spark):
    line = '1.1.1.1 - - [17/Sep/2019:21:07:45 +0000] "GET /x HTTP/1.1" 200 1'
    second = line.replace("1.1.1.1", "2.2.2.2")
    (row,) = parsed(spark, "clf", f"{line} {second}")
    assert row.ip == "1.1.1.1"


def test_malformed_requests(spark):
    head, tail = '1.1.1.1 - - [17/Sep/2019:21:07:45 +0000] "', '" 200 5'
    cases = {
        "GET": ("GET", "/", "UNKNOWN"),
        "GET /only": ("GET", "/only", "UNKNOWN"),
        "GET HTTP/2": ("GET", "/", "HTTP/2"),
        "GET /a b HTTP/2": ("GET", "/a b", "HTTP/2"),
        "GET /a HTTPx b": ("GET", "/a HTTPx b", "UNKNOWN"),
        "GET /list two words": ("GET", "/list two words", "UNKNOWN"),
        "GET /q xHTTPx": ("GET", "/q", "xHTTPx"),
    }
    rows = parsed(spark, "clf", *[head + request + tail for request in cases])
    assert [(r.method, r.url, r.protocol) for r in rows] == list(cases.values())


def test_nginx_latency_and_clf(spark):
    (row,) = parsed(
        spark, "nginx_access",
        '198.51.100.20 - - [01/Jul/2022:00:00:59 +0000] "PATCH /v2/things/4 HTTP/1.1" 202 17 "-" "Thing-Client/0.3" 1.25',
    )
    assert (row.status_code, row.response_time_ms, row.referrer, row.user_agent) == (202, 1250.0, None, "Thing-Client/0.3")
    (row,) = parsed(spark, "clf", '198.51.100.21 - ana [01/Jul/2022:00:00:59 +0000] "GET /m.css HTTP/1.1" 200 88')
    assert (row.url, row.bytes_sent, row.user_agent) == ("/m.css", 88, None)


def test_error_logs(spark):
    plain, micros, padded = parsed(
        spark, "apache_error",
        "[Fri Jul 15 23:59:01 2022] [warn] [client 198.51.100.3] certificate is about to expire",
        "[Fri Jul 15 23:59:01.000042 2022] [warn] [client 198.51.100.3] y",
        "[Fri Jul  1 23:59:01 2022] [warn] [client 198.51.100.3] y",
    )
    assert naive(plain.timestamp) == naive(micros.timestamp) == "2022-07-15 23:59:01"
    assert naive(padded.timestamp) == "2022-07-01 23:59:01"
    assert (plain.ip, plain.method, plain.url, plain.status_code, plain.bytes_sent) == ("198.51.100.3", "-", "-", 500, 0)
    full, bare = parsed(
        spark, "nginx_error",
        '2022/07/15 23:59:01 [crit] 42#7: *99 connect() failed (111: Refused), client: 198.51.100.4, '
        'server: shop, request: "POST /pay%20now?t=9 HTTP/1.1", host: "shop.example.net"',
        "2022/07/15 23:59:01 [notice] 3#3: reloaded",
    )
    assert (full.ip, full.method, full.url, full.query_string, full.host) == (
        "198.51.100.4", "POST", "/pay%20now", "t=9", "shop.example.net")
    assert (full.protocol, full.status_code) == ("HTTP/1.1", 500)
    assert (bare.ip, bare.method, bare.url, bare.host, bare.protocol) == ("-", "-", "-", None, None)


def test_iis(spark):
    rows = parsed(
        spark, "iis_w3c",
        "#Version: 1.0",
        "2022-07-15 23:59:01 192.0.2.1 POST /app/save.aspx - 443 - 198.51.100.5 "
        "Client/9+(Test;One+Two) - 201 0 0 33",
    )
    (row,) = rows
    assert (row.ip, row.url, row.query_string, row.user_agent) == (
        "198.51.100.5", "/app/save.aspx", None, "Client/9 (Test;One Two)")
    assert (row.response_time_ms, naive(row.timestamp), row.bytes_sent) == (33.0, "2022-07-15 23:59:01", 0)


def test_unknown_and_json(spark):
    json, aliases, text, dated, latin, none = parsed(
        spark, p.UNKNOWN_FORMAT,
        '{"ip": "192.0.2.8", "method": "GET", "url": "/feed", "status": 200, "bytes": 64, "timestamp": "2022-07-15T23:59:01Z"}',
        '{"ip": "1.1.1.1", "client_ip": "2.2.2.2", "url": "/a", "path": "/b", "status": 1, "status_code": "404"}',
        'at 1.2.3.4 did GET /path/x?y=1 200 123 "Mozilla/5.0" 12ms',
        "zz [05/Mar/2024:10:00:00 +0200] 3s",
        '"Opera/9" "other" 250µs',
        "nothing here",
    )
    assert (json.ip, json.url, json.bytes_sent, naive(json.timestamp)) == ("192.0.2.8", "/feed", 64, "2022-07-15 23:59:01")
    assert (aliases.ip, aliases.url, aliases.status_code) == ("2.2.2.2", "/b", 404)
    assert (text.ip, text.method, text.url, text.query_string) == ("1.2.3.4", "GET", "/path/x", "y=1")
    assert (text.status_code, text.bytes_sent, text.response_time_ms, text.user_agent) == (200, 123, 12.0, "Mozilla/5.0")
    assert (naive(dated.timestamp), dated.response_time_ms) == ("2024-03-05 10:00:00", 3000.0)
    assert (latin.user_agent, latin.response_time_ms) == ("Opera/9", 0.25)
    assert (none.ip, none.method, none.url, none.status_code, none.user_agent) == ("0.0.0.0", "UNKNOWN", "/", 200, "Unknown")
    assert naive(none.timestamp) == "2024-01-01 00:00:00"


def test_stored_entry_is_decoded_twice(spark):
    line = '1.1.1.1 - - [17/Sep/2019:21:07:45 +0000] "GET /a%252Fb/7?q=%253Cb%253E HTTP/1.1" 200 1'
    frame = spark.createDataFrame([(line,)], "value string")
    row = p.entries(p.parse_lines(frame, "clf")).first()
    assert (row.url, row.query_string, row.normalized_url) == ("/a/b/7", "q=<b>", "/a%2Fb/{id}")


def test_rejects_are_kept(spark):
    good = '1.1.1.1 - - [17/Sep/2019:21:07:45 +0000] "GET / HTTP/1.1" 200 1'
    frame = spark.createDataFrame([(good,), ("bad",), ("  ",)], "value string")
    result = p.parse_lines(frame, "clf")
    assert [r.value for r in p.quarantine(result).collect()] == ["bad"]
    assert tuple(p.parse_stats(result).first()) == (2, 1, 1)


def test_detection(spark):
    lines = {
        "apache": ['1.1.1.1 - - [17/Sep/2019:21:07:45 +0000] "GET / HTTP/1.1" 200 1 "-" "x" 900'],
        "nginx": ['1.1.1.1 - - [17/Sep/2019:21:07:45 +0000] "GET / HTTP/1.1" 200 1 "-" "x" 0.9'],
        "clf": ['1.1.1.1 - - [17/Sep/2019:21:07:45 +0000] "GET / HTTP/1.1" 200 1', "bad"],
        "garbage": ["neither one nor the other"],
    }
    frame = spark.createDataFrame(
        [(f, i, v) for f, values in lines.items() for i, v in enumerate(values)], "file string, at int, value string"
    )
    got = {r.file: (r.format, r.confidence) for r in detect_formats(sample_lines(frame, "file", "at"), "file").collect()}
    assert got == {
        "apache": ("apache_access", 1.0), "nginx": ("nginx_access", 1.0), "clf": ("clf", 0.5),
        "garbage": ("UNKNOWN_FORMAT", 0.0),
    }


def test_sample_size(spark):
    frame = spark.range(250).selectExpr("'f' AS file", "id AS at", "concat('line ', id) AS value")
    assert sorted(r.at for r in sample_lines(frame, "file", "at").collect()) == list(range(100))
