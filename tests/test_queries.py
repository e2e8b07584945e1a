"""Every query with SQL agrees with DuckDB; the others return rows; plans keep to their partitions."""

import math
import os

import duckdb
import pytest

from tidemark.plans import catalogue

SF = os.environ.get("TIDEMARK_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Q, SQL = catalogue.queries(), catalogue.oracle_sql()

@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, int, str)):
        return v
    try:
        v = float(v)
    except (TypeError, ValueError):
        return str(v)
    return "nan" if math.isnan(v) else v + 0.0


def table(columns, rows):
    return sorted(repr([(c, plain(r[c])) for c in sorted(columns)]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, name):
    df = Q[name](spark, SF)
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = table(df.columns, [r.asDict() for r in df.collect()])
    assert got == table(names, [dict(zip(names, r)) for r in cur.fetchall()])


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_returns_rows(spark, name):
    rows = Q[name](spark, SF)
    assert rows.count() > 0 and len(set(rows.columns)) == len(rows.columns)
