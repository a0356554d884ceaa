"""Named queries: a (spark, sf_dir) function each, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function under ``name``; ``sql`` may use the common table expressions of ``gridloom.plans.sqlbase``."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            from gridloom.plans.sqlbase import complete

            ORACLE_SQL[name] = complete(sql)
        return f

    return put
