"""Every query with SQL gives DuckDB's rows on the smallest tables; the rest run."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 5) + 0.0
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    result = duck.sql(ORACLES[name])
    assert sorted(result.columns) == sorted(df.columns)
    order = [result.columns.index(c) for c in sorted(result.columns)]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)


def test_entry_and_keys(spark):
    assert entry.entry(spark).count() == 27
    assert set(entry.oracle_sql()) <= set(entry.queries())
