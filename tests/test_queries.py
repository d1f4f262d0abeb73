"""Every core query against its SQL on the smallest data, and the form of those without SQL."""

import os

import duckdb
import pytest

from spanloom.plans.registry import core_queries, core_sql

DATA = "/root/testdata/sf0.001"


def normal(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}"
        c.sql(f"create view {f.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


@pytest.mark.parametrize("name", sorted(core_queries()))
def test_query(spark, sql, name):
    df = core_queries()[name](spark, DATA)
    found = sorted((tuple(normal(v) for v in r) for r in df.collect()), key=str)
    text = core_sql().get(name)
    if text is None:
        assert len(set(df.columns)) == len(df.columns)
        return
    relation = sql.sql(text)
    at = [relation.columns.index(c) for c in df.columns]
    assert sorted(relation.columns) == sorted(df.columns)
    assert found == sorted((tuple(normal(r[i]) for i in at) for r in relation.fetchall()), key=str)


def test_every_sql_has_a_query():
    assert set(core_sql()) <= set(core_queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
