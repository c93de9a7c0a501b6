"""Registration helpers of the query catalogue."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its check.

    The tables hold times without a zone, which both sides read as UTC.
    """

    def wrap(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def rd(col: str | Column, digits: int = 6) -> Column:
    """Floor-rounded double, alike in both engines."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def t() -> Column:
    return F.unix_seconds("ts").alias("t")


def flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)
