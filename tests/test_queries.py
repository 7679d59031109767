"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def names():
    import __spark_entry__

    return sorted(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, duck, name):
    import __spark_entry__

    df = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(__spark_entry__.oracle_sql()[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    assert got == sorted((tuple(r[at.index(c)] for c in columns) for r in found.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "path", "size", "nfiles"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
