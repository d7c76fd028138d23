"""The reference's queries over the whole tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsweir.operators import bm25, metrics, vectors
from newsweir.operators.dedupe import keep_first
from newsweir.operators.history import history_asof
from newsweir.operators.partitions import spread
from newsweir.operators.skew import hot_keys, lookup, skew_join
from newsweir.plans import views as v
from newsweir.plans.views import sql
from newsweir.sources.raw import labelled_impressions, entity_labels
from newsweir.sources.tables import clean_ids, filled, table
from newsweir.streaming.popularity import closed_hours, hourly_clicks

KS = [50, 100, 200]
REPLICATES = 1000
METRICS = ["auc", "mrr", "ndcg5", "ndcg10"]
QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return add


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(
    "temporal_split_counts",
    sql("sp", "SELECT dataset, split, count(*) AS rows, min(timestamp) AS first_time, max(timestamp) AS last_time FROM sp GROUP BY ALL"),
)
def temporal_split_counts(spark: SparkSession, d: str) -> DataFrame:
    by = v.split(spark, d).groupBy("dataset", "split")
    return by.agg(F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"))


@query("recent_history_asof", sql("rec", "SELECT impression_id, array_to_string(recent, ' ') AS recent FROM rec"))
def recent_history_asof(spark: SparkSession, d: str) -> DataFrame:
    return v.recent(spark, d).select("impression_id", F.array_join("recent", " ").alias("recent"))


@query(
    "history_asof_counts",
    sql(
        "imp hist",
        """SELECT i.impression_id, coalesce(CASE WHEN h.times IS NULL THEN len(h.ids)
            ELSE len(list_filter(list_zip(h.ids, h.times), lambda x: x[2] < i.timestamp)) END, 0)::BIGINT AS known
        FROM imp i JOIN hist h USING (user_id) WHERE i.timestamp IS NOT NULL""",
    ),
)
def history_asof_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many clicks of the user are known before each impression of any part."""
    imp = v.impressions(spark, d).filter(F.col("timestamp").isNotNull()).select("impression_id", "user_id", "timestamp")
    h = v.kept(spark, d, "history", v.history)
    joined = skew_join(imp, h.select("user_id", "ids", "times"), ["user_id"], hot_keys(imp, ["user_id"], imp.count()))
    known = F.size(history_asof(F.col("ids"), F.col("times"), F.col("timestamp")))
    return joined.select("impression_id", F.coalesce(known, F.lit(0)).cast("long").alias("known"))


@query("tokenize_docs", sql("doc", "SELECT article_id, array_to_string(terms, ' ') AS terms FROM doc"))
def tokenize_docs(spark: SparkSession, d: str) -> DataFrame:
    return bm25.document_terms(v.articles(spark, d)).select("article_id", F.array_join("terms", " ").alias("terms"))


@query("bm25_term_weights", sql("w", "SELECT dataset, term, article_id, tf, df, round(weight, 6) AS weight FROM w"))
def bm25_term_weights(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(v.weights(spark, d), ["weight"])


@query("bm25_candidate_scores", sql("bs", "SELECT impression_id, pos, article_id, label, score FROM bs"))
def bm25_candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    return v.bm25_scored(spark, d).select("impression_id", "pos", "article_id", "label", "score")


@query("bm25_topk", sql("bt", "SELECT query, article_id, score, rank FROM bt"))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return v.bm25_top(spark, d).select("query", "article_id", "score", "rank")


def _recall_sql(top: str) -> str:
    parts = ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}" for k in KS)
    return f"SELECT dataset, impression_id, {parts} FROM cl LEFT JOIN {top} t USING (query, article_id) GROUP BY ALL"


def _recall(spark: SparkSession, d: str, top: DataFrame) -> DataFrame:
    clicked = v.clicked(spark, d, v.recent(spark, d).select("dataset", "impression_id", "query", "clicked"))
    return _rounded(metrics.recall_at(clicked, top, ["dataset", "impression_id"], "query", KS), [f"recall_{k}" for k in KS])


@query("bm25_recall_at_k", sql("cl bt", _recall_sql("bt")))
def bm25_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d, v.bm25_top(spark, d))


@query("embedding_recall_at_k", sql("cl et", _recall_sql("et")))
def embedding_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d, v.embedding_top(spark, d))


@query("popularity_counts", sql("pop", "SELECT article_id, n FROM pop"))
def popularity_counts(spark: SparkSession, d: str) -> DataFrame:
    def build(s: SparkSession, at: str) -> DataFrame:
        return metrics.popularity(v.clicked(s, at, v.split(s, at).filter(F.col("split") == "train").select("clicked")))

    return v.kept(spark, d, "popularity", build)


def _all_popularity(spark: SparkSession, d: str) -> DataFrame:
    return v.kept(spark, d, "all_popularity", lambda s, at: metrics.popularity(v.clicked(s, at, v.split(s, at).select("clicked"))))


@query(
    "popularity_rank_baseline",
    sql(
        "cand pop",
        """SELECT impression_id, array_to_string(list(rank ORDER BY pos), ',') AS ranks FROM (
            SELECT impression_id, pos, row_number() OVER (PARTITION BY impression_id ORDER BY coalesce(n, 0) DESC, pos) AS rank
            FROM cand LEFT JOIN pop USING (article_id)) GROUP BY impression_id""",
    ),
)
def popularity_rank_baseline(spark: SparkSession, d: str) -> DataFrame:
    shown = lookup(v.candidates(spark, d), popularity_counts(spark, d), ["article_id"], "left")
    rank = F.row_number().over(W.partitionBy("impression_id").orderBy(F.desc(F.coalesce("n", F.lit(0))), "pos"))
    return _rank_lists(shown.withColumn("rank", rank), "ranks")


def _rank_lists(ranked: DataFrame, name: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("pos", "rank")))
    return ranked.groupBy("impression_id").agg(F.array_join(F.transform(pairs, lambda x: x["rank"].cast("string")), ",").alias(name))


@query("user_mean_embedding", sql("qv", "SELECT query, unnest(range(64))::INT AS i, round(unnest(v), 6) AS x FROM qv"))
def user_mean_embedding(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(v.query_vectors(spark, d).select("query", F.posexplode("vector").alias("i", "x")), ["x"])


@query("embedding_candidate_scores", sql("es", "SELECT impression_id, pos, article_id, label, score FROM es"))
def embedding_candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    return v.embedding_scored(spark, d).select("impression_id", "pos", "article_id", "label", "score")


@query("embedding_topk", sql("et", "SELECT query, article_id, score, rank FROM et"))
def embedding_topk(spark: SparkSession, d: str) -> DataFrame:
    return v.embedding_top(spark, d).select("query", "article_id", "score", "rank")


def _metrics_cte(source: str, by: str = "dataset, impression_id") -> str:
    """A subquery of the ranking metrics by list over `source`, rounded to 6 places."""
    gain = "sum(good / (tied * tied) * ((SELECT d FROM disc WHERE place = least(before + tied, {k})) - (SELECT d FROM disc WHERE place = least(before, {k}))))"
    return f"""(SELECT {by},
            round(CASE WHEN p > 0 AND p < n THEN (up - p * (p + 1) / 2) / (p * (n - p)) END, 6) AS auc,
            round(1 / first, 6) AS mrr,
            round(CASE WHEN p > 0 THEN g5 / (SELECT d FROM disc WHERE place = least(p, 5)) END, 6) AS ndcg5,
            round(CASE WHEN p > 0 THEN g10 / (SELECT d FROM disc WHERE place = least(p, 10)) END, 6) AS ndcg10
        FROM (SELECT {by}, sum(label)::BIGINT AS p, count(*) AS n, min(CASE WHEN label = 1 THEN place END) AS first,
                sum(CASE WHEN label = 1 THEN total - before - (tied - 1) / 2 END) AS up, {gain.format(k=5)} AS g5, {gain.format(k=10)} AS g10
            FROM (SELECT {by}, label, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, pos) AS place,
                    rank() OVER (PARTITION BY {by} ORDER BY score DESC) - 1 AS before, count(*) OVER (PARTITION BY {by}, score) AS tied,
                    sum(label) OVER (PARTITION BY {by}, score) AS good, count(*) OVER (PARTITION BY {by}) AS total FROM {source})
            GROUP BY ALL))"""


def _ranking(scored: DataFrame) -> DataFrame:
    return _rounded(metrics.ranking_metrics(scored, ["dataset", "impression_id"]), METRICS)


@query("ranking_metrics_bm25", sql("bs disc", f"SELECT * FROM {_metrics_cte('bs')}"))
def ranking_metrics_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(v.bm25_scored(spark, d))


@query("ranking_metrics_embedding", sql("es disc", f"SELECT * FROM {_metrics_cte('es')}"))
def ranking_metrics_embedding(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(v.embedding_scored(spark, d))


@query(
    "list_diversity",
    sql(
        "bt art",
        """SELECT query, round(count(DISTINCT category) / count(category), 6) AS diversity FROM bt JOIN art USING (article_id)
        WHERE category IS NOT NULL GROUP BY query""",
    ),
)
def list_diversity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.diversity(v.bm25_top(spark, d), v.articles(spark, d).select("article_id", "category"), "query"), ["diversity"])


@query(
    "list_novelty",
    sql(
        "bt pop",
        """SELECT query, round(avg(-log2((coalesce(n, 0) + 1) / ((SELECT sum(n) FROM pop) + 1.0))), 6) AS novelty
        FROM bt LEFT JOIN pop USING (article_id) GROUP BY query""",
    ),
)
def list_novelty(spark: SparkSession, d: str) -> DataFrame:
    pop = popularity_counts(spark, d)
    clicks = pop.agg(F.sum("n")).first()[0] or 0
    return _rounded(metrics.novelty(v.bm25_top(spark, d), pop, clicks, "query"), ["novelty"])


@query(
    "catalog_coverage",
    sql(
        "bt art",
        """SELECT dataset, round(count(DISTINCT bt.article_id) / any_value(c.articles), 6) AS coverage
        FROM bt JOIN art USING (article_id) JOIN (SELECT dataset, count(*) AS articles FROM art GROUP BY dataset) c USING (dataset) GROUP BY dataset""",
    ),
)
def catalog_coverage(spark: SparkSession, d: str) -> DataFrame:
    catalog = v.articles(spark, d).select("dataset", "article_id")
    used = v.bm25_top(spark, d).select("article_id").distinct().withColumn("used", F.lit(1))
    share = F.round(F.count("used") / F.count(F.lit(1)), 6)
    covered = catalog.join(used, "article_id", "left").groupBy("dataset").agg(F.count("used").alias("_used"), share.alias("coverage"))
    return covered.filter(F.col("_used") > 0).drop("_used")


@query("cold_warm_threshold", sql("thr", "SELECT dataset, round(threshold, 6) AS threshold FROM thr"))
def cold_warm_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.cold_threshold(v.kept(spark, d, "history", v.history), "dataset", "n"), ["threshold"])


_MEANS = ", ".join(f"round(avg({m}), 5) AS {m}" for m in METRICS)


@query(
    "metrics_by_slice",
    sql(
        "bs disc hist thr",
        f"""SELECT m.dataset, coalesce(slice, 'all') AS slice, {_MEANS}, count(*) AS n
        FROM (SELECT m.*, CASE WHEN coalesce(h.n, 0) < threshold THEN 'cold' ELSE 'warm' END AS slice
            FROM {_metrics_cte('bs')} m JOIN (SELECT impression_id, user_id FROM rec) r USING (impression_id)
            LEFT JOIN hist h USING (user_id) JOIN thr ON thr.dataset = m.dataset) m
        GROUP BY GROUPING SETS ((m.dataset, slice), (m.dataset))""",
    ),
)
def metrics_by_slice(spark: SparkSession, d: str) -> DataFrame:
    """Mean ranking metrics of cold, warm and all impressions."""
    history = v.kept(spark, d, "history", v.history)
    threshold = metrics.cold_threshold(history, "dataset", "n")
    lengths = v.recent(spark, d).select("impression_id", "user_id")
    rows = ranking_metrics_bm25(spark, d).join(lengths, "impression_id")
    rows = lookup(rows, history.select("user_id", F.col("n").alias("length")), ["user_id"], "left").join(F.broadcast(threshold), "dataset")
    rows = rows.withColumn("slice", metrics.cold_or_warm(F.col("length"), F.col("threshold")))
    means = [F.round(F.avg(m), 5).alias(m) for m in METRICS]
    out = rows.rollup("dataset", "slice").agg(*means, F.count(F.lit(1)).alias("n"), F.grouping("dataset").alias("_g"))
    return out.filter(F.col("_g") == 0).drop("_g").withColumn("slice", F.coalesce("slice", F.lit("all")))


def _weight_sql(key: str, replicate: str) -> str:
    """metrics.poisson_weights in SQL."""
    step, (one, two) = metrics._STEP, metrics._MIX
    seed = f"('0x' || substr(md5({key}::VARCHAR), 1, 8))::UBIGINT"
    x = f"xor({seed}, ((({replicate} + 1)::UBIGINT * {step}) & 4294967295))"
    for shift, by in ((16, one), (15, two)):
        x = f"list_transform([{x}], lambda z: (xor(z, z >> {shift}) * {by}) & 4294967295)[1]"
    u = f"list_transform([{x}], lambda z: xor(z, z >> 16))[1]"
    return f"list_transform([{u}], lambda z: " + " + ".join(f"(z >= {int(c * 2**32)})::INT" for c in metrics._POISSON) + ")[1]"


@query(
    "bootstrap_metric_ci",
    sql(
        "bs disc",
        f"""SELECT dataset, metric, round(any_value(mean), 5) AS mean, round(quantile_cont(boot, 0.025), 5) AS ci_low,
            round(quantile_cont(boot, 0.975), 5) AS ci_high, any_value(n) AS n
        FROM (SELECT dataset, metric, b, sum(w * x) / nullif(sum(w), 0) AS boot FROM (
                SELECT dataset, metric, b, x, {_weight_sql("impression_id", "b")} AS w
                FROM (UNPIVOT {_metrics_cte('bs')} ON {", ".join(METRICS)} INTO NAME metric VALUE x), range({REPLICATES}) r(b)) GROUP BY ALL)
        JOIN (SELECT dataset, metric, avg(x) AS mean, count(*) AS n
            FROM (UNPIVOT {_metrics_cte('bs')} ON {", ".join(METRICS)} INTO NAME metric VALUE x) GROUP BY ALL) USING (dataset, metric)
        GROUP BY ALL""",
    ),
)
def bootstrap_metric_ci(spark: SparkSession, d: str) -> DataFrame:
    long = ranking_metrics_bm25(spark, d).unpivot(["dataset", "impression_id"], METRICS, "metric", "x")
    found = metrics.bootstrap_means(long, ["dataset", "metric"], "impression_id", "x", REPLICATES)
    return found.withColumns({c: F.round(c, 5) for c in ("mean", "ci_low", "ci_high")})


@query(
    "bootstrap_coverage_ci",
    sql(
        "bt rec art",
        f"""SELECT dataset, round(any_value(mean), 5) AS mean, round(avg(boot), 5) AS boot_mean, round(quantile_cont(boot, 0.025), 5) AS ci_low,
            round(quantile_cont(boot, 0.975), 5) AS ci_high, any_value(n) AS n
        FROM (SELECT x.dataset, b, count(DISTINCT article_id) / any_value(articles) AS boot
            FROM (SELECT dataset, query, b FROM rec, range({REPLICATES}) r(b) WHERE {_weight_sql("impression_id", "b")} > 0 GROUP BY ALL) x
            JOIN bt USING (query) JOIN (SELECT dataset, count(*) AS articles FROM art GROUP BY dataset) c ON c.dataset = x.dataset GROUP BY ALL)
        JOIN (SELECT rec.dataset, count(DISTINCT article_id) / any_value(articles) AS mean, count(DISTINCT impression_id) AS n
            FROM rec JOIN bt USING (query) JOIN (SELECT dataset, count(*) AS articles FROM art GROUP BY dataset) c ON c.dataset = rec.dataset
            GROUP BY ALL) USING (dataset) GROUP BY dataset""",
    ),
)
def bootstrap_coverage_ci(spark: SparkSession, d: str) -> DataFrame:
    impressions = spread(v.recent(spark, d).filter(F.size("recent") > 0).select("dataset", "impression_id", "query"))
    lists = v.bm25_top(spark, d).select("query", "article_id")
    catalog = v.articles(spark, d).groupBy("dataset").agg(F.count(F.lit(1)).alias("articles"))
    found = metrics.coverage_interval(impressions, lists, "dataset", "impression_id", "query", catalog, REPLICATES)
    return found.withColumns({c: F.round(c, 5) for c in ("mean", "boot_mean", "ci_low", "ci_high")})


_VARIANTS = """(SELECT variant, dataset, impression_id, pos, label, CASE variant WHEN 'bm25_only' THEN score
        WHEN 'bm25_plus_safe_popularity' THEN round(score + ln(1 + coalesce(p.n, 0)), 6)
        ELSE round(score + ln(1 + coalesce(a.n, 0)), 6) END AS score
    FROM bs LEFT JOIN pop p USING (article_id) LEFT JOIN pop_all a ON a.article_id = bs.article_id,
    (SELECT unnest(['bm25_only', 'bm25_plus_safe_popularity', 'bm25_plus_leaky_popularity']) AS variant))"""


@query(
    "leakage_ablation",
    sql(
        "bs pop pop_all disc",
        f"SELECT dataset, variant, {_MEANS}, count(*) AS n FROM {_metrics_cte(_VARIANTS, 'dataset, variant, impression_id')} GROUP BY ALL",
    ),
)
def leakage_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Ranking metrics of BM25 alone, with clicks of the training part, and with clicks of the test part too."""
    safe = popularity_counts(spark, d).withColumnRenamed("n", "_safe")
    leaky = _all_popularity(spark, d).withColumnRenamed("n", "_leaky")
    rows = lookup(lookup(v.bm25_scored(spark, d), safe, ["article_id"], "left"), leaky, ["article_id"], "left")

    def plus(name: str):
        return F.round(F.col("score") + F.log1p(F.coalesce(name, F.lit(0))), 6)

    variants = F.array(
        F.struct(F.lit("bm25_only").alias("variant"), F.col("score").alias("s")),
        F.struct(F.lit("bm25_plus_safe_popularity").alias("variant"), plus("_safe").alias("s")),
        F.struct(F.lit("bm25_plus_leaky_popularity").alias("variant"), plus("_leaky").alias("s")),
    )
    grid = rows.select("dataset", "impression_id", "pos", "label", F.inline(variants)).withColumnRenamed("s", "score")
    each = _rounded(metrics.ranking_metrics(grid, ["dataset", "impression_id", "variant"]), METRICS)
    return each.groupBy("dataset", "variant").agg(*[F.round(F.avg(m), 5).alias(m) for m in METRICS], F.count(F.lit(1)).alias("n"))


@query(
    "submission_lines",
    sql(
        "bs",
        """SELECT impression_id || ' [' || array_to_string(list(rank ORDER BY pos), ',') || ']' AS line FROM (
            SELECT impression_id, pos, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, pos) AS rank FROM bs)
        GROUP BY impression_id""",
    ),
)
def submission_lines(spark: SparkSession, d: str) -> DataFrame:
    from newsweir.sources.sinks import submission

    return submission(v.bm25_scored(spark, d), "impression_id").select("line")


@query(
    "method_comparison",
    sql(
        "cl bt et",
        f"""SELECT dataset, k, bm25, embedding, CASE WHEN bm25 = embedding THEN 'tie' WHEN bm25 > embedding THEN 'bm25' ELSE 'embedding' END AS best
        FROM (SELECT dataset, k, round(avg(b), 5) AS bm25, round(avg(e), 5) AS embedding FROM (
            SELECT cl.dataset, impression_id, k, avg(CASE WHEN bt.rank <= k THEN 1.0 ELSE 0.0 END) AS b,
                avg(CASE WHEN et.rank <= k THEN 1.0 ELSE 0.0 END) AS e
            FROM cl LEFT JOIN bt USING (query, article_id) LEFT JOIN et ON et.query = cl.query AND et.article_id = cl.article_id,
                (SELECT unnest({KS}) AS k) GROUP BY ALL) GROUP BY ALL)""",
    ),
)
def method_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Mean recall of both retrieval methods side by side, with the better one."""
    names = [f"recall_{k}" for k in KS]
    long = None
    for method, f in (("bm25", bm25_recall_at_k), ("embedding", embedding_recall_at_k)):
        one = f(spark, d).groupBy("dataset").agg(*[F.avg(n).alias(n) for n in names]).unpivot(["dataset"], names, "k", "recall")
        one = one.withColumn("method", F.lit(method))
        long = one if long is None else long.unionByName(one)
    wide = long.groupBy("dataset", "k").pivot("method", ["bm25", "embedding"]).agg(F.round(F.first("recall"), 5))
    best = F.when(F.col("bm25") == F.col("embedding"), "tie").when(F.col("bm25") > F.col("embedding"), "bm25").otherwise("embedding")
    return wide.withColumn("k", F.substring_index("k", "_", -1).cast("int")).withColumn("best", best)


@query(
    "cold_start_counts",
    sql(
        "rec qv",
        """SELECT rec.dataset, count(*) AS impressions, count_if(len(recent) = 0) AS without_recent, count_if(qv.query IS NULL) AS without_vector
        FROM rec LEFT JOIN qv USING (query) GROUP BY rec.dataset""",
    ),
)
def cold_start_counts(spark: SparkSession, d: str) -> DataFrame:
    known = v.query_vectors(spark, d).select("query", F.lit(1).alias("_known"))
    rows = lookup(v.recent(spark, d).select("dataset", "query", "recent"), known, ["query"], "left")
    return rows.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("impressions"),
        F.count_if(F.size("recent") == 0).alias("without_recent"),
        F.count_if(F.col("_known").isNull()).alias("without_vector"),
    )


_PROFILED = ["dataset", "impression_id", "user_id", "timestamp", "candidates", "clicked", "device_type"]


@query("profile_nulls", "SELECT " + ", ".join(f"count_if({c} IS NULL) AS {c}" for c in _PROFILED) + ", count(*) AS rows FROM impressions")
def profile_nulls(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "impressions")
    return t.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in _PROFILED], F.count(F.lit(1)).alias("rows"))


@query(
    "profile_distinct",
    """SELECT dataset, count(DISTINCT user_id) + max((user_id IS NULL)::INT) AS users, count(DISTINCT impression_id) AS impressions,
        min(timestamp) AS first_time, max(timestamp) AS last_time, round(avg(len(candidates)), 6) AS mean_shown,
        median(len(candidates))::DOUBLE AS median_shown, round(avg((len(clicked) > 1)::INT), 6) AS several_clicks
    FROM impressions GROUP BY dataset""",
)
def profile_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct counts (null users as one), time range and list lengths of the raw impressions."""
    return table(spark, d, "impressions").groupBy("dataset").agg(
        (F.count_distinct("user_id") + F.max(F.col("user_id").isNull().cast("int"))).alias("users"),
        F.count_distinct("impression_id").alias("impressions"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
        F.round(F.avg(F.size("candidates")), 6).alias("mean_shown"),
        F.percentile(F.size("candidates"), F.lit(0.5)).alias("median_shown"),
        F.round(F.avg((F.size("clicked") > 1).cast("int")), 6).alias("several_clicks"),
    )


@query("value_counts", "SELECT device_type, count(*) AS n FROM impressions GROUP BY device_type")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "impressions").groupBy("device_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "device_type")


@query(
    "clicks_per_impression",
    """SELECT dataset, clicks, count(*) AS impressions FROM (
        SELECT dataset, coalesce(len(list_filter(clicked, lambda x: x IS NOT NULL AND length(trim(x)) > 0)), 0) AS clicks FROM impressions) GROUP BY ALL""",
)
def clicks_per_impression(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "impressions").select("dataset", F.coalesce(F.size(clean_ids("clicked")), F.lit(0)).cast("long").alias("clicks"))
    return t.groupBy("dataset", "clicks").agg(F.count(F.lit(1)).alias("impressions"))


@query("dedupe_keep_last", sql("hist", "SELECT dataset, user_id, array_to_string(ids, ' ') AS ids, coalesce(n, 0) AS n FROM hist"))
def dedupe_keep_last(spark: SparkSession, d: str) -> DataFrame:
    """One history per user, that of the later snapshot."""
    return v.history(spark, d).select("dataset", "user_id", F.array_join("ids", " ").alias("ids"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(
    "dedupe_keep_first",
    """SELECT impression_id, user_id, timestamp FROM impressions WHERE impression_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY impression_id ORDER BY timestamp NULLS LAST, user_id NULLS LAST) = 1""",
)
def dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """One row per impression, the earliest."""
    t = table(spark, d, "impressions").filter(F.col("impression_id").isNotNull()).select("impression_id", "user_id", "timestamp")
    return keep_first(t, ["impression_id"], [F.asc_nulls_last("timestamp"), F.asc_nulls_last("user_id")])


@query(
    "parse_labelled_impressions",
    sql(
        "imp",
        """SELECT impression_id, array_to_string(list_filter(candidates, lambda x: x IS NOT NULL AND length(trim(x)) > 0), ' ') AS candidates,
            array_to_string(list_filter(candidates, lambda x: x IS NOT NULL AND length(trim(x)) > 0 AND coalesce(list_contains(clicked, x), false)), ' ') AS clicked
        FROM imp WHERE candidates IS NOT NULL""",
    ),
)
def parse_labelled_impressions(spark: SparkSession, d: str) -> DataFrame:
    """Impressions written as labelled text and parsed again."""
    imp = v.impressions(spark, d).filter(F.col("candidates").isNotNull())
    mark = F.transform(
        F.filter("candidates", filled), lambda x: F.concat(x, F.when(F.coalesce(F.array_contains("clicked", x), F.lit(False)), "-1").otherwise("-0"))
    )
    parsed = labelled_impressions(F.array_join(mark, " "))
    return imp.select("impression_id", *[F.array_join(c, " ").alias(n) for c, n in zip(parsed, ("candidates", "clicked"))])


@query(
    "json_entity_labels",
    """SELECT dataset, article_id, coalesce(array_to_string(list_filter(entities, lambda x: x IS NOT NULL AND x <> ''), '|'), '') AS labels
    FROM articles WHERE article_id IS NOT NULL""",
)
def json_entity_labels(spark: SparkSession, d: str) -> DataFrame:
    """Entity labels read from JSON text."""
    t = table(spark, d, "articles").filter(F.col("article_id").isNotNull())
    text = F.to_json(F.transform("entities", lambda e: F.struct(e.alias("Label"), F.lit("P").alias("Type"))))
    return t.select("dataset", "article_id", F.array_join(entity_labels(text), "|").alias("labels"))


@query(
    "click_subset_invariant",
    sql(
        "imp",
        """SELECT dataset, count(*) AS impressions, count_if(len(list_filter(clicked, lambda x: x IS NOT NULL AND length(trim(x)) > 0
            AND NOT coalesce(list_contains(candidates, x), false))) > 0) AS broken FROM imp GROUP BY dataset""",
    ),
)
def click_subset_invariant(spark: SparkSession, d: str) -> DataFrame:
    outside = F.size(F.filter(clean_ids("clicked"), lambda x: ~F.coalesce(F.array_contains("candidates", x), F.lit(False)))) > 0
    return v.impressions(spark, d).groupBy("dataset").agg(F.count(F.lit(1)).alias("impressions"), F.count_if(outside).alias("broken"))


@query(
    "two_stage_rerank",
    sql(
        "bt qv",
        """SELECT query, article_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, article_id) AS rank FROM (
            SELECT bt.query, bt.article_id, round(coalesce(list_dot_product(vec.v, qv.v) / (greatest(sqrt(list_dot_product(vec.v, vec.v)), 1e-9)
                * greatest(sqrt(list_dot_product(qv.v, qv.v)), 1e-9)), 0), 6) AS score
            FROM bt LEFT JOIN vec USING (article_id) LEFT JOIN qv ON qv.query = bt.query) QUALIFY rank <= 50""",
    ),
)
def two_stage_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The 50 best of the lexical candidates by cosine."""
    return vectors.reranked(v.bm25_top(spark, d), v.query_vectors(spark, d), v.article_vectors(spark, d), 50).select("query", "article_id", "score", "rank")


@query(
    "streaming_hourly_clicks",
    """SELECT date_trunc('hour', timestamp) AS hour, article_id, count(*) AS clicks FROM (
        SELECT timestamp, unnest(clicked) AS article_id FROM impressions) WHERE timestamp IS NOT NULL AND length(trim(article_id)) > 0 GROUP BY ALL""",
)
def streaming_hourly_clicks(spark: SparkSession, d: str) -> DataFrame:
    """Click counts by hour and article, from the impressions as a stream."""
    return hourly_clicks(spark, f"{d}/impressions.parquet")


@query(
    "streaming_closed_hours",
    """WITH c AS (SELECT date_trunc('hour', timestamp) AS hour, timestamp, article_id FROM (SELECT timestamp, unnest(clicked) AS article_id FROM impressions)
        WHERE timestamp IS NOT NULL AND length(trim(article_id)) > 0)
    SELECT hour, article_id, count(*) AS clicks FROM c WHERE hour + INTERVAL 1 HOUR <= (SELECT max(timestamp) - INTERVAL 10 MINUTE FROM c) GROUP BY ALL""",
)
def streaming_closed_hours(spark: SparkSession, d: str) -> DataFrame:
    """Click counts of the hours that a watermark has closed, each emitted once, with bounded state."""
    return closed_hours(spark, f"{d}/impressions.parquet")
