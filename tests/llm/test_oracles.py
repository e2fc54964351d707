"""The operators that SQL can express, against DuckDB over the smallest driver tables."""

import duckdb
import pytest

from mnemora.llm import queries as q
from tests.test_queries import FOLDER, rows_of


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_like_duckdb(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute(q.SQL[name])
    names = [d[0] for d in want.description]
    got = q.QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())
