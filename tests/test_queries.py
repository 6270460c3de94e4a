"""Every registered query against its SQL at the smallest scale."""

import collections
import datetime as dt
import decimal
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in pathlib.Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, list):
        return tuple(map(plain, value))
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    return value.isoformat() if isinstance(value, dt.datetime) else value


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in entry.oracle_sql():
        assert got
        return
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = collections.Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["question_id", "id", "score", "rank"]
