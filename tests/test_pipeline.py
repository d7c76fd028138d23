"""The entry points from raw files to reports and submissions, settings, and plugged-in models."""

import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweir.operators.embed import embed, hashed_terms, mean_pooled, transformer
from newsweir.operators.split import assert_no_leakage, temporal_split
from newsweir.plans import pipeline
from newsweir.plans.pipeline import Settings, compared, settings
from newsweir.sources import raw, sinks


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Raw tab-separated logs of 60 articles and 120 impressions, in train and dev parts."""
    at, rng = tmp_path_factory.mktemp("raw"), random.Random(3)
    words = "storm harbour school budget match bridge winter museum ferry garden".split()
    for part, days in (("train", range(1, 9)), ("dev", range(9, 11))):
        (at / part).mkdir()
        news = [f"N{i}\t{'sport' if i % 3 else 'news'}\tx\t{' '.join(rng.sample(words, 3))}\t{rng.choice(words)}\tu\t[]\t[]" for i in range(60)]
        (at / part / "news.tsv").write_text("\n".join(news) + "\n")
        lines = []
        for day in days:
            for k in range(12):
                shown = rng.sample(range(60), 6)
                history = " ".join(f"N{i}" for i in rng.sample(range(60), 4)) if k else ""
                marks = " ".join(f"N{i}-{int(j == 0)}" for j, i in enumerate(shown))
                lines.append(f"{day * 100 + k}\tU{k}\t11/{day}/2019 {k + 1}:00:00 {'AM' if k < 11 else 'PM'}\t{history}\t{marks}")
        (at / part / "behaviors.tsv").write_text("\n".join(lines) + "\n")
    return at


@pytest.fixture(scope="module")
def given(folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    return Settings(dataset="mind", raw_dir=str(folder), store=f"{out}/store", out=f"{out}/out", replicates=50, top=20)


def test_build_and_evaluate(spark, given):
    store = pipeline.build(spark, given)
    parts = spark.read.parquet(f"{store}/impressions.parquet")
    assert {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()} == {"train": 84, "val": 18, "test": 18}
    for method in ("bm25", "popularity"):
        report = pipeline.evaluate(spark, Settings(**{**given.__dict__, "method": method}))
        rows = {(r["slice"], r["metric"]): r for r in report.collect()}
        assert {m for _, m in rows} == {*pipeline.MEASURES, "coverage"} and {s for s, _ in rows} == {"all", "cold", "warm"}
        assert rows["all", "auc"]["n"] == 18 == rows["cold", "auc"]["n"] + rows["warm", "auc"]["n"]
        assert all(r["ci_low"] <= r["mean"] + 1e-9 and r["mean"] <= r["ci_high"] + 1e-9 for (s, m), r in rows.items() if m != "coverage")
        assert 0 < rows["all", "coverage"]["mean"] <= 1 and rows["all", "diversity"]["mean"] <= 1
        told = raw.metric_reports(spark, f"{given.out}/{method}/eval_test.json")
        assert told.count() == len(rows)
        lists = spark.read.parquet(f"{given.out}/{method}/lists_test.parquet")
        assert lists.select(F.max(F.size("retrieved_article_ids"))).first()[0] <= 20
    some = pipeline.evaluate(spark, Settings(**{**given.__dict__, "limit": 5}))
    assert some.filter("slice = 'all' AND metric = 'mrr'").first()["n"] == 5


def test_submit_keeps_the_raw_order(spark, given):
    path = pipeline.submit(spark, given)
    with zipfile.ZipFile(path) as z:
        lines = z.read("prediction.txt").decode().strip().split("\n")
    assert [int(x.split()[0]) for x in lines] == [d * 100 + k for d in range(1, 11) for k in range(12)]
    assert all(sorted(json.loads(x.split()[1])) == [1, 2, 3, 4, 5, 6] for x in lines)


def test_a_scorer_of_ones_own(spark, given):
    """Whatever has users, score and top is a method."""

    class Longest:
        def users(self, recent):
            return recent

        def score(self, pairs, users):
            return pairs.withColumn("score", F.length("article_id").cast("double"))

    tables = pipeline.read_raw(spark, given)
    known = tables["history"].select("user_id", F.col("history_article_ids").alias("ids"), F.lit(None).cast("array<timestamp_ntz>").alias("times"))
    rows = pipeline.asked(tables["impressions"].filter("impression_id = '100'"), known, 10)
    shown = rows.first()["candidates"]
    want = sorted(range(6), key=lambda i: (-len(shown[i]), i))
    line = pipeline.submission_lines(rows, Longest()).first()["line"]
    assert json.loads(line.split()[1]) == [want.index(i) + 1 for i in range(6)]
    with pytest.raises(ValueError):
        pipeline.scorer(Settings(method="oracle"), tables["articles"])


def test_settings_by_precedence(spark, tmp_path):
    config = {"dataset": "mind", "mind": {"raw_dir": "m"}, "ebnerd": {"raw_dir": "e"}, "split": {"test_frac": 0.2}, "top": 50}
    assert settings(config).raw_dir == "m" and settings(config).test_frac == 0.2
    assert settings(config, dataset="ebnerd").raw_dir == "e" and settings(config, raw_dir="x", top=None) == Settings("mind", "x", test_frac=0.2, top=50)
    assert settings(None, test_frac=0.0).test_frac == 0.0 and settings() == Settings()
    with pytest.raises(ValueError):
        settings({"colour": 1})
    (tmp_path / "c.json").write_text(json.dumps(config))
    assert pipeline.load_config(spark, str(tmp_path / "c.json")) == config


def test_comparison(spark):
    rows = [("d", "a", "recall_5", 0.5, 10, 1), ("d", "b", "recall_5", 0.4, 10, 3), ("d", "a", "recall_9", 0.7, 10, 1), ("d", "b", "recall_9", 0.7, 10, 3)]
    rows += [("e", "a", "recall_5", 0.1, 4, 0), ("e", "b", "recall_5", 0.2, 5, 0), ("e", "b", "recall_1", 0.2, 5, 0)]
    df = spark.createDataFrame(rows, "dataset string, method string, measure string, mean double, n long, cold long")
    got = {(r["dataset"], r["measure"]): r for r in compared(df, "a").collect()}
    assert got["d", "recall_5"]["best"] == "a" and got["d", "recall_9"]["best"] == "tie" and not got["d", "recall_9"]["different_counts"]
    assert got["d", "cold_start"]["means"] == {"a": 0.1, "b": 0.3} and got["d", "cold_start"]["best"] is None
    assert got["e", "recall_5"]["different_counts"] and ("e", "recall_1") not in got


def test_split_checks_itself(spark):
    df = spark.createDataFrame([("g", i) for i in range(100)], "g string, i int").withColumn("t", F.timestamp_seconds("i").cast("timestamp_ntz"))
    split = temporal_split(df, "t", "g", 0.2, 0.2)
    assert_no_leakage(split, "t", "g")
    with pytest.raises(AssertionError):
        assert_no_leakage(split.withColumn("split", F.when(F.col("i") == 5, "test").otherwise(F.col("split"))).withColumn("t", F.col("t")), "t", "g")


def test_embedding_by_a_plugged_in_model(spark, tmp_path):
    states = np.arange(12.0).reshape(2, 3, 2)
    assert mean_pooled(states, np.array([[1, 1, 0], [0, 0, 0]])).tolist() == [[1, 2], [0, 0]]
    df = spark.createDataFrame([("a", "storm harbour"), ("b", None), ("c", "Storm"), ("d", "")], "article_id string, title string")
    got = embed(df, "article_id", F.col("title"), hashed_terms(4), batch=2)
    sinks.write_embeddings(got, f"{tmp_path}/e")
    v = {r["article_id"]: r["embedding"] for r in spark.read.parquet(f"{tmp_path}/e").collect()}
    one = hashed_terms(4)()
    both = np.mean([one(["storm"])[0][0, 0], one(["harbour"])[0][0, 0]], 0)
    assert v["a"] == pytest.approx(both, abs=1e-6) and v["b"] == v["d"] == [0, 0, 0, 0] and v["c"] == pytest.approx(one(["storm"])[0][0, 0], abs=1e-6)
    with pytest.raises(ImportError):
        transformer("any")()


def test_order_of_many_files(spark, tmp_path):
    """The first and last rows of a folder, whose larger files and splits a scan may take first."""
    (tmp_path / "f").mkdir()
    for k in range(9):
        n = 3000 if k == 7 else 40
        (tmp_path / "f" / f"part-{k:05}").write_text("".join(f"{k}\t{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        rows = raw.in_file_order(raw.tsv(spark, f"{tmp_path}/f", "file int, line int"), 0)
        assert [(r["file"], r["line"]) for r in raw.first_rows(rows, 90).collect()] == [(k, i) for k in range(3) for i in range(40)][:90]
        last = rows.orderBy(F.desc("row_idx")).limit(3).collect()
        assert [(r["file"], r["line"]) for r in last] == [(8, 39), (8, 38), (8, 37)]
        big = [r["line"] for r in rows.filter("file = 7").orderBy("row_idx").collect()]
        assert big == list(range(3000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    counts = {r["file"][-1]: r["lines"] for r in raw.line_counts(spark, f"{tmp_path}/f").collect()}
    assert counts["7"] == 3000 and counts["1"] == 40
