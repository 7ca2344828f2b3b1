"""The queries that SQL can express against DuckDB, values and column types."""

import duckdb
import pytest

from tests.test_oracle import TYPES
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, sf_dir, name):
    c = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want, got = c.sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, sf_dir)
    order = sorted(want.columns)
    assert order == sorted(got.columns)
    assert {tuple(r) for r in got.select(order).collect()} == {tuple(dict(zip(want.columns, r, strict=True))[k] for k in order) for r in want.fetchall()}
    assert {k: (TYPES | {"int": "INTEGER"})[t] for k, t in got.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
