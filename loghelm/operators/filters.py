"""The nine optional report filters, combined by AND."""

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.schema import LOG_DAY, utc_day


@dataclass(frozen=True)
class Filters:
    upload_id: int | None = None
    dataset_id: int | None = None  # alias, used when upload_id is not given
    start_date: str | None = None
    end_date: str | None = None
    ip: str | None = None
    url: str | None = None
    normalized_url: str | None = None
    status_code: int | None = None
    user_agent: str | None = None
    bot_classification: str | None = None

    def conditions(self) -> list[Column]:
        found = []
        dataset = self.upload_id if self.upload_id is not None else self.dataset_id
        if dataset is not None:
            found.append(F.col("upload_id") == dataset)
        start, end = self._range()
        if start is not None:
            found.append(F.col("timestamp") >= start)
        if end is not None:
            found.append(F.col("timestamp") <= end)
        for name in ("ip", "url", "normalized_url", "status_code", "bot_classification"):
            value = getattr(self, name)
            if value:
                found.append(F.col(name) == value)
        if self.user_agent:
            found.append(F.col("user_agent").contains(self.user_agent))
        return found

    def _range(self) -> tuple[Column | None, Column | None]:
        """First and last time. A bare end date takes in its whole day."""
        whole_day = " 23:59:59.999999" if self.end_date and len(self.end_date) == 10 else ""
        return (
            F.lit(self.start_date).cast("timestamp") if self.start_date else None,
            F.lit(self.end_date + whole_day).cast("timestamp") if self.end_date else None,
        )

    def day_conditions(self) -> list[Column]:
        """What the range of dates says of the stored log's days; folders of other days are never listed as input."""
        start, end = self._range()
        found = [] if start is None else [F.col(LOG_DAY) >= utc_day(start)]
        return found if end is None else [*found, F.col(LOG_DAY) <= utc_day(end)]

    def condition(self) -> Column | None:
        """One conjunction, or None when no filter is set."""
        found = self.conditions()
        return reduce(and_, found) if found else None


def apply_filters(df: DataFrame, filters: Filters | None) -> DataFrame:
    condition = filters.condition() if filters else None
    if filters and LOG_DAY in df.columns:
        for day in filters.day_conditions():
            df = df.where(day)
    return df if condition is None else df.where(condition)
