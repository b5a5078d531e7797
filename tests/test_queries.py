"""Every registered query that has SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from mnemospark.plans import registry

SQL = registry.oracle_sql()


def rows(df):
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    got = registry.queries()[name](spark, sf)
    got = got.select(*sorted(got.columns)).toPandas()
    want = con.sql(SQL[name]).df()
    want = want[sorted(want.columns)]
    assert list(got.columns) == list(want.columns)
    assert rows(got) == rows(want)


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "score", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_imports_nothing_of_llm():
    import pathlib
    import re

    root = pathlib.Path(registry.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text()), p
