"""User-agent classification: bot class, browser family, operating system."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from loghelm.functions.text import contains_sql

# Words per bot class, classes in order of precedence.
BOT_WORDS = {
    "search_engine_bot": ["googlebot", "bingbot", "yandex", "baiduspider", "duckduckbot", "slurp"],
    "monitoring_bot": ["pingdom", "uptimerobot", "statuscake", "datadog", "newrelic"],
    "crawler": ["ahrefs", "semrush", "mj12bot", "dotbot", "rogerbot", "bot", "spider", "crawler", "scraper"],
    "human": ["mozilla", "chrome", "safari", "edge", "opera", "firefox"],
}


def bot_class(agent: str) -> Column:
    """Class of the first word list that has a hit in the column, ``unknown`` otherwise."""
    cases = " ".join(f"WHEN {contains_sql(agent, words)} THEN '{name}'" for name, words in BOT_WORDS.items())
    return F.expr(f"CASE WHEN {agent} IS NULL OR {agent} IN ('', '-') THEN 'unknown' {cases} ELSE 'unknown' END")


def browser_family(agent: Column) -> Column:
    low = F.lower(agent)
    chrome, edge = low.contains("chrome"), low.contains("edg")
    return (
        F.when(chrome & ~edge, "Chrome")
        .when(low.contains("safari") & ~chrome, "Safari")
        .when(low.contains("firefox"), "Firefox")
        .when(edge, "Edge")
        .when(low.contains("googlebot"), "Googlebot")
        .when(low.contains("curl"), "cURL")
        .otherwise("Unknown")
    )


def os_family(agent: Column) -> Column:
    low = F.lower(agent)
    android = low.contains("android")
    return (
        F.when(low.contains("windows"), "Windows")
        .when(low.contains("mac os x"), "Mac OS")
        .when(low.contains("linux") & ~android, "Linux")
        .when(android, "Android")
        .when(low.contains("iphone") | low.contains("ipad"), "iOS")
        .otherwise("Unknown")
    )
