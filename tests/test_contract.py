"""The driver contract: names, schemas, and results against SQL at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidelog.plans.oracles import ORACLE_SQL
from tidelog.plans.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(x):
    return float(f"{x:.9g}") if isinstance(x, float) and math.isfinite(x) else x


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    want = db.sql(ORACLE_SQL[name])
    order = sorted(want.columns)
    rows = sorted((tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall()), key=str)
    got = entry.queries()[name](spark, str(DATA))
    assert sorted(got.columns) == order
    assert sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=str) == rows


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
