"""Row-by-row comparison of a Spark result with its SQL twin."""

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb


def open_tables(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return type(value).__name__
    return type(value).__name__


def _shown(value) -> str:
    if isinstance(value, float) and math.isfinite(value):
        # Sums of doubles depend on their order in the last digits only.
        return f"{value:.11e}"
    return f"{_kind(value)}:{value}"


def differences(spark_result, connection, statement: str, limit: int = 5) -> list:
    """Empty when both sides have the same columns and the same rows."""
    columns = sorted(spark_result.columns)
    expected = connection.execute(statement)
    names = [entry[0] for entry in expected.description]
    if sorted(names) != columns:
        return [f"columns {columns} against {sorted(names)}"]
    order = [names.index(column) for column in columns]
    theirs = Counter(tuple(_shown(row[i]) for i in order) for row in expected.fetchall())
    ours = Counter(
        tuple(_shown(row[column]) for column in columns) for row in spark_result.collect()
    )
    found = [f"only in Spark: {row}" for row in list((ours - theirs).elements())[:limit]]
    found += [f"only in SQL: {row}" for row in list((theirs - ours).elements())[:limit]]
    return found
