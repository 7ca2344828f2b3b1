"""Every market query against its SQL in DuckDB, values and column types."""


import duckdb
import pytest

from tidemark import oracle, queries

TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_rows(spark, sf_dir, duck, name):
    want = duck.sql(oracle.SQL[name])
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda data, names: sorted([tuple(str(dict(zip(names, r, strict=True))[k]) for k in sorted(names)) for r in data])
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)
    assert {k: TYPES[t] for k, t in got.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))


def test_every_query_is_checked():
    assert set(queries.QUERIES) - set(oracle.SQL) == {"logistic_baseline"}  # an optimiser's result


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).filter("target_h1_direction = 'UP'").count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
