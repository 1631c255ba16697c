"""Where query modules register what they offer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None):
    """Register a function of (table reader, spark) under ``name`` with its SQL; the reader takes a table's name."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def r6(x: Column | str, digits: int = DIGITS) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


def half_up(x: Column | str, digits: int = DIGITS) -> Column:
    """:func:`r6` of a double that isn't negative, as the SQL rounds, and without a decimal for each of very many rows."""
    y = (F.col(x) if isinstance(x, str) else x) * 10.0**digits
    return (F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1).otherwise(0)) / 10.0**digits


def sr(x: str, digits: int = DIGITS) -> str:
    """SQL twin of :func:`r6` (adding 0 turns -0.0 into 0.0)."""
    return f"(round({x}, {digits}) + 0.0)"


def rounded(df: DataFrame, *names: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({n: r6(n, digits) for n in names})
