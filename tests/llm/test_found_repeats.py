"""p3_found where one record repeats a rare term heavily, and in small collections."""

import duckdb
import pytest

from newsweir.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("articles, counts", [(1000, (3, 40)), (10, (1, 1, 1, 1, 1, 3))])
def test_heavy_repeats_lose_no_holder(spark, tmp_path, articles, counts):
    rows = [(f"N{i}", "plain news", "rare " * counts[i] if i < len(counts) else None) for i in range(articles)]
    spark.createDataFrame(rows, "article_id string, title string, abstract string").write.parquet(f"{tmp_path}/articles.parquet")
    got = {tuple(r) for r in QUERIES["p3_found"](spark, str(tmp_path)).select("article_id", "term").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW articles AS SELECT * FROM '{tmp_path}/articles.parquet/*.parquet'")
    assert got == set(con.execute(ORACLE["p3_found"]).fetchall()) == {(f"N{i}", "rare") for i, n in enumerate(counts) if n >= 3}
