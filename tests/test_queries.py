"""Every registered query against its checking SQL on the smallest tables."""

import math
from datetime import datetime
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        connection.sql(f"create view {file.stem} as select * from read_parquet('{file}')")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, float):
        return repr(round(value, 6))
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    if name not in CHECKS:
        assert got
        return
    check = duck.sql(CHECKS[name])
    assert sorted(check.columns) == columns
    order = [check.columns.index(c) for c in columns]
    want = sorted(tuple(plain(row[i]) for i in order) for row in check.fetchall())
    assert got == want


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
