"""Every registered query against its SQL in DuckDB on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from fernloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


#: Queries that find nothing in the smallest tables; at scale 0.01 their SQL gives rows.
EMPTY = {"a_due_reminders", "j_url_owner", "w_keyset_sql", "x_tag_having"}


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return None if math.isnan(x) else float(f"{float(x):.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return tuple(plain(y) for y in x.values()) if isinstance(x, dict) else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got or name in EMPTY, "a query without rows proves nothing"
    if name not in catalog.ORACLE_SQL:
        return
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted(names) == columns
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
