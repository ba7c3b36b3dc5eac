"""Compare a Spark query with its SQL: column names, types by kind, and all rows."""

import datetime as dt
from pathlib import Path

import duckdb


def open_tables(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in Path(directory).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(cells, key=lambda r: [(v is not None, str(v)) for v in r])


def kinds(values: list[tuple]) -> list[set]:
    return [{type(v).__name__ for v in column if v is not None} for column in zip(*values)]


def compare(spark_df, connection, sql: str) -> str | None:
    """None when both agree, otherwise what differs."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    want = rows_of(names, cursor.fetchall())
    got = rows_of(spark_df.columns, spark_df.collect())
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ, first {wrong[0]}"
    if kinds(got) != kinds(want):
        return f"types {kinds(got)} and {kinds(want)}"
    return None
