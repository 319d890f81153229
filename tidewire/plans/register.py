"""Queries with DuckDB texts that are written apart from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewire.sources.newsroom import Newsroom, with_views


class Register:
    """Named queries over the newsroom, and their DuckDB texts."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f: Callable[[Newsroom], DataFrame]):
            self.queries[f.__name__] = lambda spark, folder: f(Newsroom(spark, folder))
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add

    def oracle_sql(self) -> dict[str, str]:
        return {name: with_views(sql) for name, sql in self.oracles.items()}
