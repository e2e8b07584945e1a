"""Registered queries against their SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    con.execute("set memory_limit = '4GB'")
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cur = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([dict(zip(names, r))[c] for c in sorted(names)]) for r in cur.fetchall())
    assert sorted(repr([r[c] for c in sorted(names)]) for r in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_returns_rows(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0
