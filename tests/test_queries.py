"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import functools
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from siloway.plans.detail_oracle import SQL
from siloway.plans.detail_queries import QUERIES

SF = "/root/testdata/sf0.001"
#: Queries that the smallest tables give no rows for.
LARGER = {"simultaneous_episodes": "/root/testdata/sf0.01", "detail_marker_buckets": "/root/testdata/sf0.01"}


@functools.cache
def duck(folder):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return int(v) if hasattr(v, "__int__") and not isinstance(v, (str, bool)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    folder = LARGER.get(name, SF)
    df = QUERIES[name](spark, folder)
    rel = duck(folder).sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    theirs = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: kinds[t] for c, t in df.dtypes} == theirs
    mine, other = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    assert mine == other
    assert mine, "no rows to compare"


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 3


def test_plan_reads_few_columns(spark):
    plan = QUERIES["daily_stay_mean"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[-1]
