"""The queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, credentials, leakage, mixing, near_duplicates, nearest_time, pairs, similar_vectors, subjects

_MODULES = [credentials, similar_vectors, near_duplicates, nearest_time, conversations, pairs, leakage, mixing, subjects]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
