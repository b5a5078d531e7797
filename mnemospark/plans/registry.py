"""The core query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import index, memory, times

_MODULES = [memory, index, times]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that stands for the engine."""
    return memory.lexical_topk(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
