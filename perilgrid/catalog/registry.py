"""Registered queries and the SQL each one is checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from perilgrid.sources.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, views: list[str] | None = None, sql: str | None = None):
    """Register ``fn(load)`` under ``name``, where ``load(view)`` gives a domain table.

    ``sql`` is the same question for DuckDB, over the named views.
    """

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda v: view(spark, sf_dir, v))

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = with_views(views or [], sql)
        return fn

    return add
