"""Registry of queries: each runs an operator over the fixture views, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Register `f(v1, v2, ...)`, called with the named views, under `name`; `sql` may use the views by name."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        if sql:
            ORACLE_SQL[name] = with_views(sql, *views)
        return f

    return wrap
