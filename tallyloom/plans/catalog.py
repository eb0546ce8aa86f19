"""Registered queries over the reference's own operators, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.plans import queries_data, queries_model, queries_runs

flagship = queries_model.flagship
assert queries_data.query is queries_runs.query is queries_model.query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(queries_model.QUERIES)  # queries_data adds its own on import


def oracle_sql() -> dict[str, str]:
    return dict(queries_model.SQL)
