"""The four ways into the engine: build a feature store, evaluate, compare, and write a submission.

Each takes Settings, which a file and a command line fill; `python -m newsweir.plans.pipeline --help`.
"""

from __future__ import annotations

import argparse
import dataclasses
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweir.operators import metrics
from newsweir.operators.durable import stored
from newsweir.operators.history import recent_history
from newsweir.operators.scorers import Lexical, Popular, Scorer, Semantic
from newsweir.operators.skew import lookup
from newsweir.operators.split import temporal_split
from newsweir.sources import raw, sinks
from newsweir.sources.tables import clean_ids, filled

MEASURES = ["auc", "mrr", "ndcg5", "ndcg10", "diversity", "novelty"]
# The names that the two competitions ask for inside a zip.
INNER = {"ebnerd": "predictions.txt", "mind": "prediction.txt"}


@dataclasses.dataclass(frozen=True)
class Settings:
    dataset: str = "ebnerd"
    raw_dir: str = "data/raw"
    store: str = "data/processed"
    out: str = "data/out"
    method: str = "bm25"
    part: str = "test"
    test_frac: float = 0.15
    val_frac: float = 0.15
    n_recent: int = 10
    top: int = 200
    cold_percentile: float = 25.0
    replicates: int = 1000
    dims: int = 64
    limit: int | None = None


def settings(config: dict | None = None, **given) -> Settings:
    """Settings by precedence: what is given, None standing for nothing, then the config's, then the defaults.

    A config may nest its values by dataset and task; those of the dataset count before general ones. A
    name that isn't a setting raises.
    """
    names = {f.name for f in dataclasses.fields(Settings)}
    given = {k: v for k, v in given.items() if v is not None}
    config = dict(config or {})
    dataset = given.get("dataset", config.get("dataset", Settings.dataset))
    flat: dict = {}
    for group in ("split", "eval", dataset):
        flat |= config.pop(group, {}) if isinstance(config.get(group), dict) else {}
    plain = {k: v for k, v in config.items() if not isinstance(v, dict)}
    found = {**plain, **flat, **given}
    if unknown := set(found) - names:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Settings(**found)


def load_config(spark: SparkSession, path: str) -> dict:
    """A config file: JSON, or YAML where a reader of it is installed."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def read_raw(spark: SparkSession, s: Settings) -> dict[str, DataFrame]:
    """The tables of a raw folder: train and validation snapshots in the order that lets the later one count."""
    d = s.raw_dir
    if s.dataset == "ebnerd":
        parts = ("train", "validation")
        return raw.read_parquet_logs(spark, f"{d}/articles.parquet", [f"{d}/{p}/behaviors.parquet" for p in parts], [f"{d}/{p}/history.parquet" for p in parts])
    parts = ("train", "dev")
    return raw.read_tsv_logs(spark, [f"{d}/{p}/news.tsv" for p in parts], [f"{d}/{p}/behaviors.tsv" for p in parts])


def build(spark: SparkSession, s: Settings) -> str:
    """Raw files to a feature store: cleaned tables, impressions by part of the split, which checks itself."""
    tables = read_raw(spark, s)
    split = temporal_split(stored(tables["impressions"]), "timestamp", "dataset", s.test_frac, s.val_frac)
    sinks.write_feature_store(tables, split, f"{s.store}/{s.dataset}")
    return f"{s.store}/{s.dataset}"


def scorer(s: Settings, articles: DataFrame, train: DataFrame | None = None) -> Scorer:
    """The method by its name; another object with a Scorer's methods serves as well."""
    if s.method == "bm25":
        return Lexical(articles)
    if s.method == "embedding":
        return Semantic(articles, s.dims)
    if s.method == "popularity" and train is not None:
        return Popular(metrics.popularity(train.select(F.explode(clean_ids("clicked")).alias("article_id"))), articles)
    raise ValueError(f"no method {s.method}")


def asked(impressions: DataFrame, history: DataFrame, n: int) -> DataFrame:
    """`impressions` with recent, what their users had read, and query, which impressions of the same recent articles share."""
    got = recent_history(impressions, history, n)
    return got.withColumn("query", F.array_join("recent", " "))


def shown(rows: DataFrame) -> DataFrame:
    """(dataset, impression_id, query, pos, article_id, label) of each candidate."""
    long = rows.select("dataset", "impression_id", "query", "clicked", F.posexplode("candidates").alias("pos", "article_id"))
    label = F.coalesce(F.array_contains("clicked", F.col("article_id")), F.lit(False)).cast("int")
    return long.filter(filled(F.col("article_id"))).select("dataset", "impression_id", "query", "pos", "article_id", label.alias("label"))


def sliced_report(
    rows: DataFrame, scored: DataFrame, top: DataFrame, articles: DataFrame, popularity: DataFrame, lengths: DataFrame, threshold: DataFrame, replicates: int
) -> DataFrame:
    """(dataset, slice, metric, mean, ci_low, ci_high, n): all measures of a method for cold, warm and all impressions.

    `rows` has dataset, impression_id, user_id and query of each impression, `scored` its candidates with
    score and label, `top` the queries' retrieved lists, `popularity` (article_id, n) of the training
    clicks, `lengths` (user_id, length) and `threshold` (dataset, threshold), a row a dataset. Diversity and
    novelty are those of the impression's retrieved list, coverage that of all lists of the slice.
    """
    clicks = popularity.agg(F.sum("n")).first()[0] or 0
    lists = top.select("query", "article_id")
    per_list = metrics.diversity(lists, articles.select("article_id", "category"), "query").join(metrics.novelty(lists, popularity, clicks, "query"), "query", "full")
    # Stored, as a lookup reads its tables several times.
    per_list = stored(per_list, tidy=True)
    known = lookup(rows.select("dataset", "impression_id", "user_id", "query"), lengths, ["user_id"], "left").join(F.broadcast(threshold), "dataset")
    known = known.withColumn("slice", metrics.cold_or_warm(F.col("length"), F.col("threshold")))
    known = known.select("dataset", "impression_id", "query", F.explode(F.array("slice", F.lit("all"))).alias("slice"))
    ranked = metrics.ranking_metrics(scored, ["impression_id"])
    each = lookup(stored(known.join(ranked, "impression_id", "left"), tidy=True), per_list, ["query"], "left")
    long = each.unpivot(["dataset", "slice", "impression_id"], MEASURES, "metric", "x")
    means = metrics.bootstrap_means(long, ["dataset", "slice", "metric"], "impression_id", "x", replicates)
    # Coverage by slice: one label for both.
    both = F.concat_ws("/", "dataset", "slice")
    slices = articles.groupBy("dataset").agg(F.count(F.lit(1)).alias("articles")).select(
        F.explode(F.transform(F.array(*map(F.lit, ("all", "cold", "warm"))), lambda x: F.concat_ws("/", F.col("dataset"), x))).alias("_part"), "articles"
    )
    listed = known.filter(F.col("query") != "").withColumn("_part", both)
    cover = metrics.coverage_interval(listed, lists, "_part", "impression_id", "query", slices, replicates)
    cover = cover.select(
        F.substring_index("_part", "/", 1).alias("dataset"), F.substring_index("_part", "/", -1).alias("slice"), F.lit("coverage").alias("metric"), "mean", "ci_low", "ci_high", "n"
    )
    return means.select("dataset", "slice", "metric", "mean", "ci_low", "ci_high", "n").unionByName(cover)


def evaluate(spark: SparkSession, s: Settings) -> DataFrame:
    """The sliced report of a method over a part of a feature store, written as JSON beside its retrieved lists."""
    d = f"{s.store}/{s.dataset}"
    articles, parts = spark.read.parquet(f"{d}/articles.parquet"), spark.read.parquet(f"{d}/impressions.parquet")
    history = spark.read.parquet(f"{d}/user_history.parquet")
    train, part = parts.filter(F.col("split") == "train"), parts.filter(F.col("split") == s.part)
    if s.limit:
        part = part.orderBy("timestamp", "impression_id").limit(s.limit)
    known = history.select("user_id", F.col("history_article_ids").alias("ids"), F.col("history_timestamps").alias("times"))
    rows = stored(asked(part, known, s.n_recent))
    method = scorer(s, articles, train)
    users = method.users(rows.filter(F.size("recent") > 0).select("dataset", "query", "recent").distinct())
    scored, top = method.score(shown(rows), users), stored(method.top(users, s.top))
    popularity = metrics.popularity(train.select(F.explode(clean_ids("clicked")).alias("article_id")))
    lengths = history.select("user_id", F.col("history_length").alias("length"))
    threshold = metrics.cold_threshold(history, "dataset", "history_length", s.cold_percentile)
    report = stored(sliced_report(rows, scored, top, articles, popularity, lengths, threshold, s.replicates).withColumn("method", F.lit(s.method)))
    sinks.retrieved_lists(top, "query").write.mode("overwrite").parquet(f"{s.out}/{s.method}/lists_{s.part}.parquet")
    sinks.write_report(report, f"{s.out}/{s.method}/eval_{s.part}.json")
    return report


def compared(recalls: DataFrame, first: str) -> DataFrame:
    """(dataset, measure, best, best_mean, <a column per method>, different_counts): methods side by side.

    `recalls` has dataset, method, measure, mean, n and cold, the impressions of a method and those without
    anything to ask for. best is the method with the greatest mean to 5 places, "tie" if there are several;
    different_counts warns of methods measured over different numbers of impressions. The share of cold
    ones comes as a measure of its own, without a best. `first` is the method that decides which measures
    are compared.
    """
    shares = recalls.select("dataset", "method", F.lit("cold_start").alias("measure"), (F.col("cold") / F.col("n")).alias("mean"), "n").distinct()
    rows = recalls.select("dataset", "method", "measure", "mean", "n").unionByName(shares).withColumn("mean", F.round("mean", 5))
    of = rows.groupBy("dataset", "measure").agg(
        F.max("mean").alias("best_mean"),
        F.collect_list(F.struct("method", "mean")).alias("_all"),
        (F.count_distinct("n") > 1).alias("different_counts"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "mean")))).alias("means"),
    )
    best = F.filter("_all", lambda x: x["mean"] == F.col("best_mean"))
    named = F.when(F.size(best) > 1, "tie").otherwise(best[0]["method"])
    cold = F.col("measure") == "cold_start"
    out = of.filter(F.map_contains_key("means", first))
    return out.select(
        "dataset", "measure", "means", F.when(~cold, named).alias("best"), F.when(~cold, F.col("best_mean")).alias("best_mean"), "different_counts"
    )


def compare(spark: SparkSession, paths: dict[str, str], first: str) -> DataFrame:
    """`compared` over reports of recall that were written as JSON, by method."""
    rows = None
    for method, path in paths.items():
        one = raw.metric_reports(spark, path).withColumn("method", F.lit(method)).select("dataset", "method", "measure", "mean", "n", "cold")
        rows = one if rows is None else rows.unionByName(one)
    return compared(rows, first)


def submission_lines(rows: DataFrame, method: Scorer) -> DataFrame:
    """(impression_id, line): the ranks of each impression's candidates by a method, in the order shown."""
    users = method.users(rows.filter(F.size("recent") > 0).select("dataset", "query", "recent").distinct())
    return sinks.submission(method.score(shown(rows), users), "impression_id")


def submit(spark: SparkSession, s: Settings) -> str:
    """Raw files to a zip of ranks in the order of the raw impressions; all that is known of a user counts."""
    tables = read_raw(spark, s)
    rows = tables["impressions"]
    if s.limit:
        rows = rows.orderBy("timestamp", "impression_id").limit(s.limit)
    known = tables["history"].select("user_id", F.col("history_article_ids").alias("ids"), F.lit(None).cast("array<timestamp_ntz>").alias("times"))
    rows = stored(asked(rows, known, s.n_recent))
    lines = submission_lines(rows, scorer(s, tables["articles"]))
    order: Column = F.col("impression_id").cast("long")
    return sinks.write_submission(lines.withColumn("_order", order), "_order", f"{s.out}/{s.dataset}_{s.method}", INNER[s.dataset])


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Build a feature store, evaluate a method over it, or write a submission.")
    parser.add_argument("task", choices=["build", "evaluate", "submit"])
    parser.add_argument("--config")
    for f in dataclasses.fields(Settings):
        parser.add_argument(f"--{f.name.replace('_', '-')}", type={"int": int, "float": float, "int | None": int}.get(f.type, str))
    given = vars(parser.parse_args(argv))
    task, config = given.pop("task"), given.pop("config")
    spark = SparkSession.builder.appName("newsweir").getOrCreate()
    s = settings(load_config(spark, config) if config else None, **given)
    got = {"build": build, "evaluate": evaluate, "submit": submit}[task](spark, s)
    if isinstance(got, DataFrame):
        got.show(200, truncate=False)
    else:
        print(got)


if __name__ == "__main__":
    main()
