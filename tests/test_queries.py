"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__
from lectern.plans import bind, catalog, more  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in bind.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v if not isinstance(v, datetime.datetime) else v.replace(tzinfo=None))
    return f"{float(v):.9g}"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in catalog.ORACLE_SQL:
        out = duck.execute(catalog.ORACLE_SQL[name])
        assert got == rows([d[0] for d in out.description], out.fetchall())


def test_entry_and_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
