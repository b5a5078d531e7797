"""Every query of the subpackage that has SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from mnemospark.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    got = registry.queries()[name](spark, sf)
    want = con.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).toPandas().itertuples(index=False)))) == sorted(map(repr, (tuple(r) for r in want[columns].itertuples(index=False))))
