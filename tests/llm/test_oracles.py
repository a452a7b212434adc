"""Corpus queries against their DuckDB SQL on a small table."""

from __future__ import annotations

import os

import duckdb
import pytest

from tidemark.llm.queries import ORACLE_SQL, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    expected = duck.sql(ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    rows = expected.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, rows))
