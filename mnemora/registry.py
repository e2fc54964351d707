"""Where queries are registered, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapters import Memory

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table_query(name: str, oracle: str | None = None):
    """Register a function of (spark, folder) under `name`."""

    def add(fn: Query):
        QUERIES[name] = fn
        if oracle:
            SQL[name] = oracle
        return fn

    return add


def query(name: str, oracle: str | None = None):
    """Register a function of the memory tables under `name`."""

    def add(fn: Callable[[Memory], DataFrame]):
        table_query(name, oracle)(lambda spark, folder: fn(Memory(spark, folder)))
        return fn

    return add
