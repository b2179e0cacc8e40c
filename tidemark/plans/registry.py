"""Where queries and the SQL they are held against are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def q(x, name: str | None = None) -> Column:
    """Six decimals by floor, at the very end: engines add doubles in different orders."""
    x = F.col(x) if isinstance(x, str) else x
    out = F.floor(x * 1e6 + 0.5) / 1e6
    return out.alias(name) if name else out


def sq(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"
