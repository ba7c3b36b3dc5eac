import pytest
from pyspark.sql import functions as F

from loghelm.functions.agents import bot_class, browser_family, os_family
from loghelm.functions.net import in_network
from loghelm.functions.text import ilike_any
from loghelm.functions.urls import percent_decode, target_path, target_query, url_template


def one(spark, column, *values, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_url_template(spark):
    got = one(
        spark, url_template(F.col("v")), "/shop/4711/cart", "/room/9", "/about",
        "/file/0f8fad5b-d9cb-469f-a165-70867728950e/raw", "/key/zyxwvu9876543210/use", "/documentation",
        "9/8", "/x/10/20/30",
    )
    assert got == [
        "/shop/{id}/cart", "/room/{id}", "/about", "/file/{id}/raw", "/key/{id}/use", "/{id}", "9/{id}", "/x/{id}/{id}/{id}",
    ]


def test_percent_decode(spark):
    got = one(spark, percent_decode(F.col("v")), "a+b%20c%zz%", "%3Cscript%3e", "plain", None, "%E4%BD%A0", "%2520")
    assert got == ["a+b c%zz%", "<script>", "plain", None, "你", "%20"]


def test_target_split(spark):
    rows = spark.createDataFrame([("/a?b=1?c",), ("/a",), ("/a?",)], "v string")
    got = [tuple(r) for r in rows.select(target_path(F.col("v")), target_query(F.col("v"))).collect()]
    assert got == [("/a", "b=1?c"), ("/a", None), ("/a", "")]


@pytest.mark.parametrize(
    "agent, expected",
    [
        ("Mozilla/5.0 (compatible; GoogleBot/9)", "search_engine_bot"),
        ("some crawler 1", "crawler"),
        ("my scraper", "crawler"),
        ("PINGDOM probe", "monitoring_bot"),
        ("Mozilla/5.0 (X11; Plan9) Gecko/1 Firefox/2", "human"),
        ("fetch/3", "unknown"), ("-", "unknown"), ("", "unknown"), (None, "unknown"),
    ],
)
def test_bot_class(spark, agent, expected):
    assert one(spark, bot_class("v"), agent) == [expected]


def test_families(spark):
    agents = ["X Chrome/1 Safari", "Y Chrome Edg/1", "Safari iPhone Mac OS X", "FIREFOX Linux", "Android Linux", None, "curl"]
    assert one(spark, browser_family(F.col("v")), *agents) == [
        "Chrome", "Edge", "Safari", "Firefox", "Unknown", "Unknown", "cURL"]
    assert one(spark, os_family(F.col("v")), *agents) == [
        "Unknown", "Unknown", "Mac OS", "Linux", "Android", "Unknown", "Unknown"]


def test_network(spark):
    values = ["10.0.0.1", "10.1.0.0", "11.0.0.1", "x", None, "2001:db8::1", "999.1"]
    assert one(spark, in_network("v", "10.0.0.0/8"), *values) == [True, True, False, None, None, None, None]


@pytest.mark.parametrize("network", ["fc00::/7", "fe80::/10", "::1/128", "2001:db8::/32", "::ffff:10.0.0.0/104", "::/0", "1:2:3:4::/63"])
def test_network_v6(spark, network):
    import ipaddress

    values = ["fd12:3456::1", "fe81::1", "fe80::1%eth0", "::1", "::2", "2001:0db8::1", "2001:DB8:0:0:0:0:0:1", "2001:db9::1",
              "::ffff:10.1.2.3", "::ffff:11.1.2.3", "::", "1:2:3:4:5:6:7:8", "1:2:3:5::", "1:2:3:6::", "[fc00::9]", "10.0.0.1", "x:y", None]
    got = one(spark, in_network("v", network), *values)
    for value, found in zip(values, got):
        try:
            address = ipaddress.ip_address((value or "").strip("[]").split("%")[0])
        except ValueError:
            assert found is None
        else:
            assert found == (address in ipaddress.ip_network(network) if address.version == 6 else None), value


def test_ilike_any_does_not_span_fields(spark):
    rows = spark.createDataFrame(
        [("union", "20select"), ("UNION%20SELECT", None), (None, None), ("a", "informationXschema"), ("or", " 1=1")],
        "a string, b string",
    )
    test = ilike_any(["a", "b"], ["%UNION%20SELECT%", "%OR 1=1%", "%information_schema%"])
    assert [r[0] for r in rows.select(test).collect()] == [False, True, False, True, False]
