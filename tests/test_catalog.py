import math

import duckdb
import pytest

from scoreloom.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: ("nan" if math.isnan(v) else round(v, 9) + 0.0) if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(map(tuple, df.collect()), df.columns) == plain(want.fetchall(), list(want.columns))


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert QUERIES.keys() <= entry.queries().keys()
