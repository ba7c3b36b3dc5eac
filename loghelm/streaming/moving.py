"""Risk per address over a moving period: findings count until the period after their day has passed.

Each task folds its findings to one row per address and day before the shuffle, so an address with a third of all findings
sends a row per Arrow batch and day. State is a list of totals per day of an address, so it is read and written in one call each; one timer, of the first
day's end, drops all days whose time has come and sets the next, so the state holds a period and no more. Changed totals are
emitted, also when findings leave, down to a score of 0.
"""

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loghelm.operators.risk import MAX_SCORE, risk_class, severity_points

DAY_MS = 86_400_000
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, on disk and not on the heap; later ones as before."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        days = batch.groupby(["ip", "day"], sort=False).agg(timestamp=("timestamp", "max"), score=("points", "sum"), findings=("points", "size"))
        yield days.reset_index()[["ip", "day", "timestamp", "score", "findings"]]


class _DayTotals(StatefulProcessor):
    """Totals per day of one address. While there are any, a timer not later than the first day's end is set."""

    def __init__(self, period_ms: int) -> None:
        self._period_ms = period_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._days = handle.getListState("days", "day bigint, score bigint, findings bigint")

    def _ends(self, day: int) -> int:
        return (day + 1) * DAY_MS + self._period_ms

    def _store(self, key: tuple, days: dict[int, list[int]], now: int) -> tuple[dict[int, list[int]], pd.DataFrame]:
        """Keep the days whose time has not come, as timers count it, and give them and their total."""
        kept = {day: total for day, total in days.items() if self._ends(day) >= now}
        if kept:
            self._days.put([(day, *total) for day, total in sorted(kept.items())])
        else:
            self._days.clear()
        score, findings = (sum(total[i] for total in kept.values()) for i in (0, 1))
        return kept, pd.DataFrame({"ip": [key[0]], "score": [score], "findings": [findings]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        days = {day: [score, findings] for day, score, findings in self._days.get()}
        first = min(days, default=None)
        for batch in rows:  # at most one entry per day of the period
            for day, score, findings in zip(batch["day"], batch["score"], batch["findings"]):
                total = days.setdefault(int(day), [0, 0])
                total[0] += int(score)
                total[1] += int(findings)
        kept, total = self._store(key, days, timerValues.getCurrentWatermarkInMs())
        # The timer of a first day that has gone comes later in this batch, and sets the next.
        if kept and (first is None or min(kept) < first):
            self._handle.registerTimer(self._ends(min(kept)))
        yield total

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        days = {day: [score, findings] for day, score, findings in self._days.get()}
        kept, total = self._store(key, days, timerValues.getCurrentWatermarkInMs())
        if kept:
            self._handle.registerTimer(self._ends(min(kept)))
        yield total

    def close(self) -> None:
        pass


def moving_risk(findings: DataFrame, period: dt.timedelta, watermark: str = "1 day") -> DataFrame:
    """Score and class per address over the findings whose day (UTC) ended at most ``period`` before the watermark.

    Update mode: the newest row of an address holds, and a score of 0 says that all its findings have left. It
    has to start inside ``rocksdb_state``. Findings without an address or time take no part.
    """
    day = F.floor(F.unix_millis("timestamp") / F.lit(DAY_MS))
    points = findings.where("ip IS NOT NULL AND timestamp IS NOT NULL").select(
        "ip", day.alias("day"), F.col("timestamp").cast("timestamp").alias("timestamp"), severity_points().cast("bigint").alias("points")
    )
    folded = points.mapInPandas(_folded, "ip string, day bigint, timestamp timestamp, score bigint, findings bigint")
    totals = folded.withWatermark("timestamp", watermark).groupBy("ip").transformWithStateInPandas(
        statefulProcessor=_DayTotals(int(period.total_seconds() * 1000)),
        outputStructType="ip string, score bigint, findings bigint", outputMode="Update", timeMode="EventTime",
    )
    risk = F.least(F.col("score"), F.lit(MAX_SCORE).cast("bigint"))
    return totals.select("ip", "score", risk.alias("risk_score"), risk_class(risk).alias("severity"), "findings")
