"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eoframe.plans.views import Tables

RUNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under its name, with its check SQL."""

    def register(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__
        if key in RUNS:
            raise ValueError(f"query {key} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        RUNS[key] = run
        if sql is not None:
            SQL[key] = sql
        return fn

    return register
