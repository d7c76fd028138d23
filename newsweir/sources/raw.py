"""Readers of the two raw formats, into one schema of articles, impressions and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweir.operators.dedupe import keep_first

ARTICLES = (
    "dataset string, article_id string, title string, abstract string, body string, category string, entities array<string>, "
    "published_time timestamp_ntz, sentiment_score float, sentiment_label string, embedding array<float>"
)
IMPRESSIONS = (
    "dataset string, impression_id string, user_id string, timestamp timestamp_ntz, candidates array<string>, clicked array<string>, device_type string"
)
HISTORY = (
    "dataset string, user_id string, history_article_ids array<string>, history_timestamps array<timestamp_ntz>, "
    "history_length bigint, last_history_time timestamp_ntz"
)
_NEWS = "news_id string, category string, subcategory string, title string, abstract string, url string, title_entities string, abstract_entities string"
_BEHAVIORS = "impression_id string, user_id string, time string, history string, impressions string"


def _conform(df: DataFrame, schema: str) -> DataFrame:
    """`df` with exactly the schema's columns and types, null where it has none."""
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def in_file_order(df: DataFrame, source: int) -> DataFrame:
    """`df`, read straight from files, with `source_rank` and `row_idx`, which rises in the files' order.

    Files follow each other by path, splits of a file by their start, rows of a split as they are read; a
    scan may take files and splits in any order.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return df.withColumn("source_rank", F.lit(source)).withColumn("row_idx", at)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of in_file_order: the head of the files, wherever they are read."""
    return df.orderBy("source_rank", "row_idx").limit(n)


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines, bytes) of text files, their lines counted where they lie."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return rows.groupBy("file", "bytes").agg(F.count(F.lit(1)).alias("lines")).select("file", "lines", "bytes")


def metric_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports of metrics written by sinks.write_report, read back: a row per object."""
    return spark.read.option("multiLine", True).json(path)


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table without header or quoting, separated by tabs; empty fields are null, quotes are data."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("escape", "").csv(path)


def vectors(spark: SparkSession, path: str, dims: int = 100) -> DataFrame:
    """(id, vector) from a tab-separated file of an id and `dims` numbers a line."""
    names = [f"_{i}" for i in range(dims)]
    t = tsv(spark, path, ", ".join(["id string", *[f"{n} double" for n in names]]))
    return t.select("id", F.array(*names).alias("vector"))


def entity_labels(text: Column) -> Column:
    """The non-empty labels in a JSON list of entities; null and malformed text has none."""
    parsed = F.transform(F.from_json(text, "array<struct<Label:string>>"), lambda e: e["Label"])
    return F.coalesce(F.filter(parsed, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def labelled_impressions(text: Column) -> tuple[Column, Column]:
    """(candidates, clicked) of 'id-1 id-0 id' text: the label follows the last hyphen, 1 is a click."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")
    ids = F.transform(tokens, lambda x: F.regexp_replace(x, "-[^-]*$", ""))
    clicked = F.filter(tokens, lambda x: x.endswith("-1"))
    return ids, F.transform(clicked, lambda x: F.regexp_replace(x, "-1$", ""))


def latest_history(rows: DataFrame) -> DataFrame:
    """The unified history of raw rows in file order: of a user's rows the last counts."""
    h = keep_first(rows, ["user_id"], [F.desc("source_rank"), F.desc("row_idx")])
    ids, times = F.col("article_id_fixed"), F.col("impression_time_fixed")
    return h.select(
        F.lit("ebnerd").alias("dataset"),
        "user_id",
        ids.alias("history_article_ids"),
        times.alias("history_timestamps"),
        F.size(ids).alias("history_length"),
        F.array_max(times).alias("last_history_time"),
    )


def read_parquet_logs(spark: SparkSession, articles: str, behaviors: list[str], histories: list[str]) -> dict[str, DataFrame]:
    """The Parquet dataset: articles, and behaviors and histories of several snapshots in order.

    Snapshots' behaviors are put together; of a user's histories that of the latest snapshot counts.
    """
    a = spark.read.parquet(articles).select(
        F.lit("ebnerd").alias("dataset"),
        "article_id",
        "title",
        F.col("subtitle").alias("abstract"),
        "body",
        F.col("category_str").alias("category"),
        F.col("ner_clusters").alias("entities"),
        "published_time",
        "sentiment_score",
        "sentiment_label",
    )
    b = None
    for path in behaviors:
        one = spark.read.parquet(path).select(
            F.lit("ebnerd").alias("dataset"),
            "impression_id",
            "user_id",
            F.col("impression_time").alias("timestamp"),
            F.col("article_ids_inview").alias("candidates"),
            F.col("article_ids_clicked").alias("clicked"),
            "device_type",
        )
        b = one if b is None else b.unionByName(one)
    h = None
    for k, path in enumerate(histories):
        one = in_file_order(spark.read.parquet(path).select("user_id", "article_id_fixed", "impression_time_fixed"), k)
        h = one if h is None else h.unionByName(one)
    h = latest_history(h)
    return {"articles": _conform(a, ARTICLES), "impressions": _conform(b, IMPRESSIONS), "history": _conform(h, HISTORY)}


def read_tsv_logs(spark: SparkSession, news: list[str], behaviors: list[str]) -> dict[str, DataFrame]:
    """The TSV dataset, its parts in order: the first row of an article and of a user's history counts."""

    def together(paths: list[str], schema: str) -> DataFrame:
        out = None
        for k, path in enumerate(paths):
            one = in_file_order(tsv(spark, path, schema), k)
            out = one if out is None else out.unionByName(one)
        return out

    first = [F.col("source_rank"), F.col("row_idx")]
    n = keep_first(together(news, _NEWS), ["news_id"], first)
    entities = F.concat(entity_labels(F.col("title_entities")), entity_labels(F.col("abstract_entities")))
    a = n.select(F.lit("mind").alias("dataset"), F.col("news_id").alias("article_id"), "title", "abstract", "category", entities.alias("entities"))
    rows = together(behaviors, _BEHAVIORS)
    candidates, clicked = labelled_impressions(F.col("impressions"))
    b = rows.select(
        F.lit("mind").alias("dataset"),
        "impression_id",
        "user_id",
        F.to_timestamp_ntz("time", F.lit("M/d/yyyy h:mm:ss a")).alias("timestamp"),
        candidates.alias("candidates"),
        clicked.alias("clicked"),
    )
    ids = F.filter(F.split(F.coalesce("history", F.lit("")), r"\s+"), lambda x: x != "")
    h = keep_first(rows, ["user_id"], first).select(
        F.lit("mind").alias("dataset"), "user_id", ids.alias("history_article_ids"), F.size(ids).alias("history_length")
    )
    return {"articles": _conform(a, ARTICLES), "impressions": _conform(b, IMPRESSIONS), "history": _conform(h, HISTORY)}


def parquet_shape(path: str) -> dict:
    """Rows, columns, row groups and schema of a Parquet file, or of a folder of them, from the footers."""
    import pyarrow.dataset as ds

    whole = ds.dataset(path, format="parquet", partitioning="hive")
    footers = [f.metadata for f in whole.get_fragments()]
    schema = [(f.name, str(f.type)) for f in whole.schema]
    return {"rows": sum(m.num_rows for m in footers), "columns": len(schema), "row_groups": sum(m.num_row_groups for m in footers), "schema": schema}


def schema_difference(a: DataFrame, b: DataFrame) -> dict[str, set]:
    """Columns, as (name, type), of one table only and of both."""
    x, y = set(a.dtypes), set(b.dtypes)
    return {"first_only": x - y, "second_only": y - x, "both": x & y}
