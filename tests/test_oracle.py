"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import collections
import datetime
import decimal
import math

import duckdb
import pytest

from tessella import catalog, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in catalog.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = collections.Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert mine == theirs


def test_flagship(spark):
    rows = registry.flagship(spark, SF).collect()
    assert 0 < len(rows) <= 10
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
