"""Every named query runs; those with SQL give the same rows in DuckDB."""

import math

import duckdb
import pytest

from tablefit.catalogue import QUERIES, SQL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
SLOW = {"before_after", "fraction_sweep"}


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in SQL:
        assert rows
        return
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    assert rows == want
