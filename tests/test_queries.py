"""Every query with an SQL form against it on the smallest tables, and the entry points."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as driver

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    base = duckdb.connect()
    for name in os.listdir(SMALL):
        base.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return base


def plain(row):
    return tuple(x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x for x in row)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    sql = driver.oracle_sql()[name]
    names = sorted(r[0] for r in duck.execute(f"DESCRIBE {sql}").fetchall())
    got = driver.queries()[name](spark, SMALL)
    assert sorted(got.columns) == names
    listed = ", ".join(f'"{n}"' for n in names)
    want = duck.execute(f"SELECT {listed} FROM ({sql})").fetchall()
    assert sorted(map(repr, map(plain, want))) == sorted(repr(plain(r)) for r in got.select(*[f"`{n}`" for n in names]).collect())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
