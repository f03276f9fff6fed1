"""Every registered reference query against its SQL twin in DuckDB."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from pixelspark.plans.queries import ORACLE_SQL, QUERIES
from pixelspark.plans import telemetry_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(tuple(plain(v) for v in r) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_entry_has_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["topic", "ts_us", "type", "value"]
    assert df.count() > 0


def test_registries_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
