"""The library's queries over the test tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from icupanel.queries import evaluation, jobs, panels, resampling
from icupanel.queries.base import ORACLE, QUERIES

__all__ = ["evaluation", "jobs", "oracle_sql", "panels", "queries", "resampling"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
