import datetime as dt
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from loghelm.operators.parse import entries  # noqa: E402
from loghelm.schema import LOG_SCHEMA, conform  # noqa: E402
from loghelm.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "loghelm-tests", "local[8]",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="8", spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)


def naive(value: dt.datetime) -> str:
    return value.strftime("%Y-%m-%d %H:%M:%S")


@pytest.fixture(scope="session")
def make_log(spark):
    """Log rows from dictionaries; what is not given gets a plain value."""

    def make(*rows: dict):
        names = LOG_SCHEMA.fieldNames()
        given = [
            {
                "upload_id": 1, "timestamp": at("2023-01-01 12:00:00"), "ip": "1.1.1.1", "method": "GET",
                "url": "/", "status_code": 200, "bytes_sent": 100, "user_agent": "Mozilla/5.0",
                "protocol": "HTTP/1.1", "normalized_url": "", "bot_classification": "", **row,
            }
            for row in rows
        ]
        frame = spark.createDataFrame([tuple(r.get(n) for n in names) for r in given], LOG_SCHEMA)
        from pyspark.sql import functions as F

        parsed = frame.drop("normalized_url", "bot_classification").withColumn("parsed", F.lit(True))
        return conform(entries(parsed))

    return make
