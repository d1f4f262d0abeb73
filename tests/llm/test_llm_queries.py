"""Every llm query on the smallest data: against SQL where there is some, else for its form."""

import os

import duckdb
import pytest

from spanloom.llm.registry import llm_queries, llm_sql

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm_queries()))
def test_query(spark, name):
    df = llm_queries()[name](spark, DATA)
    found = sorted((tuple(r) for r in df.collect()), key=str)
    if name not in llm_sql():
        assert df.columns
        return
    c = duckdb.connect()
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}"
        c.sql(f"create view {f.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    relation = c.sql(llm_sql()[name])
    at = [relation.columns.index(x) for x in df.columns]
    assert found == sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=str)
