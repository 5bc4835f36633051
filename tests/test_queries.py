"""Every registered query runs; those with SQL give its rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.plans.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 8)
    return value


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    frame = queries()[name](spark, DATA)
    names = sorted(frame.columns)
    rows = sorted(repr([plain(r[c]) for c in names]) for r in frame.collect())
    if name in oracle_sql():
        found = duck.execute(oracle_sql()[name])
        order = [d[0] for d in found.description]
        assert sorted(order) == names
        assert rows == sorted(repr([plain(r[order.index(c)]) for c in names]) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_selection_reads_few_columns(spark):
    plan = queries()["top_orders"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_no_cartesian_products(spark):
    for name, fn in queries().items():
        if name.startswith("stream"):
            continue
        plan = fn(spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
