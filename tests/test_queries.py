"""Every core query that has SQL gives the same rows as the SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from docloom.plans import core_problems, search_queries, state_queries, text_queries
from tools_compare import rows_of

DATA = "/root/testdata/sf0.001"
MODULES = [search_queries, text_queries, state_queries, core_problems]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cur = con.execute(ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())


def test_normalize_same_bits_as_sql(spark, con):
    """rows_of takes -0.0 for 0.0; here the signs count."""
    mine = [repr(tuple(r)) for r in QUERIES["vector_normalize"](spark, DATA).select("chunk_id", "unit").collect()]
    assert sorted(mine) == sorted(map(repr, con.execute(f"SELECT chunk_id, unit FROM ({ORACLE['vector_normalize']})").fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
