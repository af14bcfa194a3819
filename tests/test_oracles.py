"""Every query with SQL beside it gives the rows of that SQL on the smallest tables."""

import os

import duckdb
import pytest

from graphloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return connection


def plain(value):
    return round(value, 5) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    found = db.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    want = sorted(repr([plain(v) for v in r]) for r in found.fetchall())
    assert got == want
