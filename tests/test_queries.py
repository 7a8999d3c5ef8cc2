"""Every base query against its DuckDB oracle on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from lectern.plans.oracles import oracle_sql
from lectern.plans.queries import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, sf_dir, duck, name):
    df = queries()[name](spark, sf_dir)
    duck.execute(oracle_sql()[name])
    columns = [c[0] for c in duck.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in duck.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == want and want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(oracle_sql()) <= set(__spark_entry__.queries())
