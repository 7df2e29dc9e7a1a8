"""Registered queries: every operator bound to the given tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The given tables of one folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    """Register a function of the tables under its name; `sql` gives the same rows."""

    def register(function: Callable[[Tables], DataFrame]) -> Query:
        from threadshelf.session import configure

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Tables(configure(spark), folder))

        name = function.__name__
        run.__module__ = function.__module__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def load() -> None:
    """Import the modules that register queries."""
    from threadshelf.checks import catalog, changes, mentions, resolve, threads, vectors  # noqa: F401
