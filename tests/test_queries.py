"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from wearlens.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = ("lineitem", "events", "embeddings", "orders")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return float(value) if not isinstance(value, (str, bool)) else value


def sorted_rows(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert got
    if name in catalog.SQL:
        found = con.execute(catalog.SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        want = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
        assert sorted_rows(got) == sorted_rows(want)
