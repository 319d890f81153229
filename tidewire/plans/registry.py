"""Names of the registered queries and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewire.plans import agent, audit, cards, changes, derived, desk, memory, processing, reports, rulebook, stored, streams, topics
from tidewire.sources.newsroom import Newsroom, with_views


def _report(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: Newsroom(spark, folder).sql(sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _report(sql) for name, sql in reports.all_reports().items()} | derived.QUERIES | desk.QUERIES | changes.QUERIES | rulebook.QUERIES | agent.QUERIES | memory.QUERIES | streams.QUERIES | cards.QUERIES | topics.QUERIES | stored.QUERIES | processing.QUERIES | audit.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in reports.all_reports().items()} | derived.oracle_sql() | desk.oracle_sql() | changes.oracle_sql() | rulebook.oracle_sql() | agent.oracle_sql() | memory.oracle_sql() | streams.oracle_sql() | cards.oracle_sql() | topics.oracle_sql() | stored.oracle_sql() | processing.oracle_sql() | audit.oracle_sql()
