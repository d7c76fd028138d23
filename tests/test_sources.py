import datetime as dt
import json
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from newsweir.sources import raw, sinks
from newsweir.sources.tables import clicks
from newsweir.streaming.popularity import click_stream, hourly_clicks, windowed_popularity


def test_tsv_logs(spark, tmp_path):
    good = json.dumps([{"Label": "Ann"}, {"Label": ""}, {"Other": 1}])
    news = ['N1\tsport\tx\tA "quoted\ttitle"\tu\t' + good + "\t[]", "N2\tnews\tx\tT\t\tu\tbroken\t"]
    (tmp_path / "n1").write_text("\n".join(news) + "\n")
    (tmp_path / "n2").write_text("N1\tnews\tx\tlater\tlater\tu\t[]\t[]\n")
    (tmp_path / "b1").write_text("1\tU1\t11/11/2019 9:05:58 AM\tN1 N2\tN55-1 N35-0\n2\tU2\t11/11/2019 12:05:58 PM\t\tN1 N2\n")
    (tmp_path / "b2").write_text("3\tU1\t1/1/2020 1:00:00 AM\tN9\t\n")
    got = raw.read_tsv_logs(spark, [str(tmp_path / "n1"), str(tmp_path / "n2")], [str(tmp_path / "b1"), str(tmp_path / "b2")])
    a = {r["article_id"]: r for r in got["articles"].collect()}
    assert a["N1"]["title"] == 'A "quoted' and a["N1"]["entities"] == ["Ann"] and a["N2"]["entities"] == [] and a["N2"]["abstract"] is None
    i = {r["impression_id"]: r for r in got["impressions"].collect()}
    assert (i["1"]["candidates"], i["1"]["clicked"]) == (["N55", "N35"], ["N55"])
    assert (i["2"]["candidates"], i["2"]["clicked"]) == (["N1", "N2"], [])
    assert i["3"]["candidates"] == [] and i["2"]["timestamp"] == dt.datetime(2019, 11, 11, 12, 5, 58)
    h = {r["user_id"]: r for r in got["history"].collect()}
    assert h["U1"]["history_article_ids"] == ["N1", "N2"] and h["U2"]["history_length"] == 0 and h["U1"]["history_timestamps"] is None
    assert got["articles"].columns == [f.split()[0] for f in raw.ARTICLES.split(", ")]


def test_parquet_logs(spark, tmp_path):
    t = dt.datetime(2023, 5, 1)
    articles = pd.DataFrame(
        [(1, "t", "s", "b", "c", ["E"], t, 0.5, "Positive")],
        columns="article_id title subtitle body category_str ner_clusters published_time sentiment_score sentiment_label".split(),
    )
    spark.createDataFrame(articles).write.parquet(f"{tmp_path}/a")
    b = spark.createDataFrame([(7, 5, t, [1, 2], [2], 1)], "impression_id int, user_id int, impression_time timestamp_ntz, article_ids_inview array<int>, article_ids_clicked array<int>, device_type int")
    b.write.parquet(f"{tmp_path}/b")
    for k, ids in enumerate(([1], [1, 2])):
        h = spark.createDataFrame([(5, ids, [t] * len(ids))], "user_id int, article_id_fixed array<int>, impression_time_fixed array<timestamp_ntz>")
        h.write.parquet(f"{tmp_path}/h{k}")
    got = raw.read_parquet_logs(spark, f"{tmp_path}/a", [f"{tmp_path}/b"], [f"{tmp_path}/h0", f"{tmp_path}/h1"])
    assert got["history"].first()["history_article_ids"] == ["1", "2"] and got["history"].first()["last_history_time"] == t
    i = got["impressions"].first()
    assert i["candidates"] == ["1", "2"] and i["clicked"] == ["2"] and i["user_id"] == "5"
    assert got["articles"].first()["abstract"] == "s" and got["articles"].first()["embedding"] is None


def test_vectors_and_shapes(spark, tmp_path):
    (tmp_path / "v").write_text("Q1\t" + "\t".join(["0.5"] * 3) + "\n")
    assert raw.vectors(spark, str(tmp_path / "v"), 3).first()["vector"] == [0.5] * 3
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/p")
    part = next(p for p in (tmp_path / "p").iterdir() if p.name.endswith(".parquet"))
    assert raw.parquet_shape(str(part))["rows"] == 5
    spark.range(7).repartition(3).write.parquet(f"{tmp_path}/parts")
    shape = raw.parquet_shape(f"{tmp_path}/parts")
    assert (shape["rows"], shape["columns"], shape["row_groups"], shape["schema"]) == (7, 1, 3, [("id", "int64")])
    a, b = spark.range(1), spark.range(1).withColumn("x", F.lit("s"))
    assert raw.schema_difference(a, b) == {"first_only": set(), "second_only": {("x", "string")}, "both": {("id", "bigint")}}


def test_sinks(spark, tmp_path):
    top = spark.createDataFrame([("q", "b", 1.0, 2), ("q", "a", 2.0, 1)], "query string, article_id string, score double, rank int")
    assert sinks.retrieved_lists(top, "query").first()["retrieved_article_ids"] == ["a", "b"]
    lines = spark.createDataFrame([(i, f"{i} [1]") for i in range(50)], "row_idx int, line string").repartition(5)
    path = sinks.write_submission(lines, "row_idx", f"{tmp_path}/out")
    with zipfile.ZipFile(path) as z:
        assert z.read("predictions.txt").decode().split("\n")[:50] == [f"{i} [1]" for i in range(50)]
    sinks.write_report(top, f"{tmp_path}/r.json")
    assert len(json.load(open(f"{tmp_path}/r.json"))) == 2
    part = spark.createDataFrame([("i", "train"), ("j", "test")], "impression_id string, split string")
    sinks.write_feature_store({"articles": top, "history": top}, part, f"{tmp_path}/store")
    assert spark.read.parquet(f"{tmp_path}/store/impressions.parquet").filter("split = 'test'").count() == 1


ROW = "dataset string, impression_id string, user_id string, timestamp timestamp_ntz, candidates array<string>, clicked array<string>, device_type string"


def test_clicks_and_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 10, 30)
    rows = [
        ("d", "1", "u", t, ["a"], ["a", "a", None, " "], None),
        ("d", "1", "u", t, ["a"], ["a"], None),
        ("d", None, "u", t, ["a"], ["a"], None),
        ("d", "2", None, None, None, None, None),
        ("d", "3", "u", t, [], [], None),
    ]
    df = spark.createDataFrame(rows, ROW)
    assert [tuple(r) for r in clicks(df).collect()] == [("1", "a")]
    df.coalesce(1).write.parquet(f"{tmp_path}/impressions.parquet")
    for path in (f"{tmp_path}/impressions.parquet", next(str(p) for p in (tmp_path / "impressions.parquet").iterdir() if p.name.endswith(".parquet"))):
        assert [tuple(r) for r in hourly_clicks(spark, path).collect()] == [(t.replace(minute=0), "a", 4)]
    late = windowed_popularity(click_stream(spark, f"{tmp_path}/impressions.parquet"))
    run = late.writeStream.outputMode("append").format("memory").queryName("late").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("late").columns == ["hour", "article_id", "clicks"]
