"""Registry of runnable queries, each next to the SQL that states the expected result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded value for comparison across engines; the name of a plain column is kept."""
    named = isinstance(column, str)
    out = F.round(F.col(column) if named else column, digits)
    return out.alias(column) if named else out


def us(column: str = "ts", name: str | None = None) -> Column:
    """Instant as epoch microseconds, free of session time zones."""
    return F.unix_micros(column).alias(name or f"{column}_us")
