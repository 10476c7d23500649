"""Where query modules register: name, Spark job, and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lotscope.bindings import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``job(tables) -> DataFrame`` under ``name``; leave ``sql`` out when SQL cannot state the result."""
    def add(job: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: job(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return job
    return add
