"""Every query with an oracle against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from loomgraph.plans import registry

SMALL = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())


def value(v):
    return None if v is None else "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    rows = sorted([tuple(value(r[c]) for c in columns) for r in df.collect()], key=str)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    expected = duck.sql(sql)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    assert rows == sorted([tuple(value(r[i]) for i in at) for r in expected.fetchall()], key=str)


def test_same_result_whatever_the_partitions(spark):
    first = sorted(map(str, registry.queries()["change_patterns"](spark, SMALL).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert first == sorted(map(str, registry.queries()["change_patterns"](spark, SMALL).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
