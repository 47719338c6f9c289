"""Every registered query against its SQL on the smallest given tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as registered

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = registered.queries(), registered.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return None if value != value else round(float(value), 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = ordered([r[i] for i in at] for r in result.fetchall())
    assert ordered(df.select(*columns).collect()) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"learning_table", "loono_cv"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).columns


def test_entry(spark):
    assert registered.entry(spark).count() > 0
