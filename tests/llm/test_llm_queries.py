"""The llm queries that have SQL against DuckDB, over the smallest tables; the others run."""

import os

import duckdb
import pytest

from newsweir.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    got = QUERIES[name](spark, DATA)
    if name not in ORACLE:
        assert got.count() >= 0
        return
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    want = con.execute(ORACLE[name]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, want[names].itertuples(index=False)))
