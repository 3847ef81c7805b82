"""Every signal query against its DuckDB SQL on the smallest tables, and the entry module's contract."""

import math
from collections import Counter

import duckdb
import pytest

from pulsegrid.plans import oracle, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) & set(oracle.ORACLE_SQL)))
def test_matches_sql(spark, duck, sf, name):
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(tuple(canon(v) for v in r) for r in df.select(*columns).collect())
    rows = duck.sql(oracle.ORACLE_SQL[name])
    assert sorted(rows.columns) == columns
    at = [rows.columns.index(c) for c in columns]
    want = Counter(tuple(canon(r[i]) for i in at) for r in rows.fetchall())
    assert got == want


def test_sql_has_no_stray_names():
    assert set(oracle.ORACLE_SQL) <= set(queries.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
