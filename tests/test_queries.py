"""Every registered query against its SQL in DuckDB, over the smallest driver tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from mnemora import queries as q
from mnemora import queries_sources, queries_views  # noqa: F401

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that have rows only over more than the smallest tables.
EMPTY = {"recent_errors_since"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_like_duckdb(spark, duck, name):
    got = q.QUERIES[name](spark, FOLDER)
    want = duck.execute(q.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = want.fetchall()
    assert rows_of(got.columns, got.collect()) == rows_of(names, rows)
    assert rows or name in EMPTY, "a comparison of nothing with nothing shows nothing"


def test_every_query_has_sql():
    assert set(q.SQL) == set(q.QUERIES)
