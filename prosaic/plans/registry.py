"""All queries of the library, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prosaic.plans import brief_queries, edit_queries, feedback_queries, file_queries, score_queries, text_queries

_ALL = {**score_queries.QUERIES, **text_queries.QUERIES, **feedback_queries.QUERIES, **edit_queries.QUERIES, **brief_queries.QUERIES, **file_queries.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
