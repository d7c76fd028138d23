"""Every core query that has SQL against DuckDB, over the smallest tables."""

import importlib
import os

import duckdb
import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"
PLANS = [importlib.import_module(f"newsweir.plans.{n}") for n in ("reference", "files", "general")]
NAMES = [n for m in PLANS for n in m.ORACLE]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(df: pd.DataFrame) -> list:
    def text(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
            return ""
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    plan = next(m for m in PLANS if name in m.ORACLE)
    got, want = plan.QUERIES[name](spark, DATA).toPandas(), duck.execute(plan.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
