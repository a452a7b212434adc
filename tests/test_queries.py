"""Registered queries against their DuckDB SQL on a small table."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from tidemark.queries import ORACLE_SQL, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("events", "lineitem", "orders", "customer", "nation")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def normal(rows):
    return sorted(repr(tuple(round(v, 3) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    expected = duck.sql(ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    found = [tuple(r) for r in df.select(*columns).collect()]
    assert normal(found) == normal(expected.select(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
