"""Every query with SQL against DuckDB on the smallest tables; every other one runs."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry


def plain(x):
    if isinstance(x, float):
        return "inf" if math.isinf(x) else round(x, 7)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for name in os.listdir(small):
        con.execute(f"create view {name.split('.')[0]} as select * from '{small}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, small, db, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = db.execute(entry.oracle_sql()[name])
    names = [x[0] for x in result.description]
    want = sorted((tuple(plain(dict(zip(names, row))[c]) for c in columns) for row in result.fetchall()), key=repr)
    assert sorted(names) == columns and got == want


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry.oracle_sql() and not re.match(r"p\d+_", n)))
def test_runs(spark, small, name):
    assert entry.queries()[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
