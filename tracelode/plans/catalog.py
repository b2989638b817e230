"""The named queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelode.plans import calibration, command_queries, deliveries, drift, episode_queries, evaluation, gates, policy_queries, store_queries, text_queries

_MODULES = (deliveries, drift, episode_queries, gates, text_queries, command_queries, policy_queries, evaluation, calibration, store_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of the core by name."""
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """The SQL of each query that SQL can express."""
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
