"""Queries over raw files, sinks, reports and plugged-in models, with their oracle SQL.

The raw formats are written from the tables first, to the shared folder, and read back by the readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweir.functions.text import title_and_abstract
from newsweir.operators import embed as em
from newsweir.operators import metrics
from newsweir.operators.durable import shared_path
from newsweir.operators.scorers import Popular
from newsweir.plans import pipeline, reference
from newsweir.plans import views as v
from newsweir.plans.reference import METRICS, REPLICATES, _metrics_cte, _weight_sql
from newsweir.plans.views import sql
from newsweir.sources import raw, sinks
from newsweir.sources.tables import clean_ids, filled, table

QUERIES, ORACLE = {}, {}
HEAD = 100


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return add


def _text(c: str):
    """A text as one field of a line: no tabs or line ends, blanks at its ends kept."""
    return F.regexp_replace(c, r"[\t\r\n]", " ")


def _written(df: DataFrame, *order: str) -> str:
    """Lines of tab-separated fields in several files, in an order that holds across them; null fields are empty."""
    path = shared_path(df.sparkSession, "raw")
    fields = [c for c in df.columns if c not in order]
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])
    df.repartitionByRange(4, *order).sortWithinPartitions(*order).select(line).write.text(path)
    return path


def _news(spark: SparkSession, d: str) -> str:
    """The articles of the tab-separated dataset as raw news, every copy a line."""
    t = table(spark, d, "articles").filter((F.col("dataset") == "mind") & F.col("article_id").isNotNull())
    labels = F.to_json(F.transform(F.coalesce("entities", F.array().cast("array<string>")), lambda e: F.struct(e.alias("Label"))))
    empty = F.lit("")
    title, abstract = _text("title"), _text("abstract")
    return _written(
        t.select(
            F.col("article_id").alias("_1"), F.coalesce(title, empty).alias("_2"), F.coalesce(abstract, empty).alias("_3"),
            "article_id", _text("category").alias("category"), empty.alias("subcategory"), title.alias("title"), abstract.alias("abstract"),
            empty.alias("url"), _text(F.regexp_replace(labels, "\\\\t", " ")).alias("title_entities"), F.lit("[]").alias("abstract_entities"),
        ),
        "_1", "_2", "_3",
    )


def _behaviors(spark: SparkSession, d: str) -> str:
    """The impressions of the tab-separated dataset as raw behaviors, with the user's history on each line."""
    imp = v.impressions(spark, d).filter((F.col("dataset") == "mind") & F.col("timestamp").isNotNull())
    h = v.kept(spark, d, "history", v.history).select("user_id", F.array_join(clean_ids("ids"), " ").alias("history"))
    rows = imp.join(h, "user_id", "left")
    mark = F.transform(
        F.filter("candidates", filled), lambda x: F.concat(x, F.when(F.coalesce(F.array_contains("clicked", x), F.lit(False)), "-1").otherwise("-0"))
    )
    time = F.date_format("timestamp", "M/d/yyyy h:mm:ss a")
    return _written(
        rows.select(F.col("impression_id").alias("_1"), "impression_id", "user_id", time.alias("time"), "history", F.array_join(mark, " ").alias("impressions")), "_1"
    )


def _tsv(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    def build(s: SparkSession, at: str) -> DataFrame:
        return s.createDataFrame([(_news(s, at), _behaviors(s, at))], "news string, behaviors string")

    paths = v.kept(spark, d, "raw_tsv", build).first()
    return raw.read_tsv_logs(spark, [paths["news"]], [paths["behaviors"]])


_PLAIN = r"regexp_replace({}, '[\t\r\n]', ' ', 'g')"


@query(
    "raw_tsv_articles",
    f"""SELECT article_id, nullif({_PLAIN.format("title")}, '') AS title, nullif({_PLAIN.format("abstract")}, '') AS abstract,
        nullif({_PLAIN.format("category")}, '') AS category FROM articles WHERE dataset = 'mind' AND article_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY coalesce({_PLAIN.format("title")}, ''), coalesce({_PLAIN.format("abstract")}, '')) = 1""",
)
def raw_tsv_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles of raw news, the first line of each in the order of the files."""
    return _tsv(spark, d)["articles"].select("article_id", "title", "abstract", "category")


@query(
    "raw_tsv_impressions",
    sql(
        "imp",
        """SELECT impression_id, user_id, date_trunc('second', timestamp) AS timestamp,
            array_to_string(list_filter(candidates, lambda x: x IS NOT NULL AND length(trim(x)) > 0), ' ') AS candidates,
            array_to_string(list_filter(candidates, lambda x: x IS NOT NULL AND length(trim(x)) > 0 AND coalesce(list_contains(clicked, x), false)), ' ') AS clicked
        FROM imp WHERE dataset = 'mind' AND timestamp IS NOT NULL""",
    ),
)
def raw_tsv_impressions(spark: SparkSession, d: str) -> DataFrame:
    """Impressions of raw behaviors: times of text, labels of shown ids."""
    t = _tsv(spark, d)["impressions"]
    return t.select("impression_id", "user_id", "timestamp", *[F.coalesce(F.array_join(c, " "), F.lit("")).alias(c) for c in ("candidates", "clicked")])


@query(
    "raw_tsv_history",
    sql(
        "imp hist",
        """SELECT i.user_id, coalesce(array_to_string(list_filter(ids, lambda x: x IS NOT NULL AND length(trim(x)) > 0), ' '), '') AS ids,
            coalesce(len(list_filter(ids, lambda x: x IS NOT NULL AND length(trim(x)) > 0)), 0) AS history_length
        FROM (SELECT DISTINCT user_id FROM imp WHERE dataset = 'mind' AND timestamp IS NOT NULL) i LEFT JOIN hist ON hist.user_id = i.user_id""",
    ),
)
def raw_tsv_history(spark: SparkSession, d: str) -> DataFrame:
    """A history per user, that of the user's first line."""
    return _tsv(spark, d)["history"].select("user_id", F.array_join("history_article_ids", " ").alias("ids"), "history_length")


@query(
    "raw_parquet_history",
    """SELECT user_id, coalesce(array_to_string(history_article_ids, ' '), '') AS ids, list_max(history_timestamps) AS last_history_time
    FROM user_history WHERE user_id IS NOT NULL AND dataset = 'ebnerd'
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY coalesce(last_history_time, TIMESTAMP '1900-01-01') DESC,
        coalesce(array_to_string(history_article_ids, ' '), '') DESC, coalesce(list_max(history_timestamps), TIMESTAMP '1900-01-01') DESC) = 1""",
)
def raw_parquet_history(spark: SparkSession, d: str) -> DataFrame:
    """Histories of raw snapshots in several Parquet files: of a user's rows the last in the files' order."""

    def build(s: SparkSession, at: str) -> DataFrame:
        t = table(s, at, "user_history").filter(F.col("user_id").isNotNull() & (F.col("dataset") == "ebnerd"))
        never = F.lit("1900-01-01").cast("timestamp_ntz")
        ids, times = F.col("history_article_ids"), F.col("history_timestamps")
        t = t.select("user_id", ids.alias("article_id_fixed"), times.alias("impression_time_fixed"), F.coalesce("last_history_time", never).alias("_1"))
        t = t.withColumn("_2", F.coalesce(F.array_join("article_id_fixed", " "), F.lit(""))).withColumn("_3", F.coalesce(F.array_max("impression_time_fixed"), never))
        path = shared_path(s, "raw")
        t.repartitionByRange(3, "_1", "_2", "_3").sortWithinPartitions("_1", "_2", "_3").drop("_1", "_2", "_3").write.parquet(path)
        empty = shared_path(s, "raw")
        t.select("user_id", "article_id_fixed", "impression_time_fixed").limit(0).write.parquet(empty)
        return s.createDataFrame([(path, empty)], "path string, empty string")

    at = v.kept(spark, d, "raw_parquet", build).first()
    h = raw.in_file_order(spark.read.parquet(at["empty"]), 0).unionByName(raw.in_file_order(spark.read.parquet(at["path"]), 1))
    h = raw.latest_history(h)
    return h.select("user_id", F.coalesce(F.array_join("history_article_ids", " "), F.lit("")).alias("ids"), "last_history_time")


@query(
    "raw_line_counts",
    """SELECT 'behaviors' AS kind, count(*) AS lines FROM (SELECT DISTINCT dataset, impression_id, user_id, timestamp, candidates, clicked FROM impressions
        WHERE impression_id IS NOT NULL AND dataset = 'mind' AND timestamp IS NOT NULL)
    UNION ALL SELECT 'news', count(*) FROM articles WHERE dataset = 'mind' AND article_id IS NOT NULL""",
)
def raw_line_counts(spark: SparkSession, d: str) -> DataFrame:
    _tsv(spark, d)
    paths = v.kept(spark, d, "raw_tsv", lambda s, at: None).first()
    out = None
    for kind in ("news", "behaviors"):
        one = raw.line_counts(spark, paths[kind]).agg(F.sum("lines").alias("lines")).select(F.lit(kind).alias("kind"), "lines")
        out = one if out is None else out.unionByName(one)
    return out


@query("parquet_shapes", "SELECT 'impressions' AS name, count(*) AS rows, 7 AS columns FROM impressions UNION ALL SELECT 'documents', count(*), 8 FROM documents")
def parquet_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Rows and columns of files by their footers."""
    shapes = [(n, raw.parquet_shape(f"{d}/{n}.parquet")) for n in ("impressions", "documents")]
    return spark.createDataFrame([(n, s["rows"], s["columns"]) for n, s in shapes], "name string, rows long, columns int")


@query(
    "schema_differences",
    "SELECT unnest(['dataset', 'user_id']) AS name, 'both' AS side UNION ALL SELECT unnest(['history_article_ids', 'history_timestamps', 'history_length', 'last_history_time']), 'first_only' "
    "UNION ALL SELECT unnest(['impression_id', 'timestamp', 'candidates', 'clicked', 'device_type']), 'second_only'",
)
def schema_differences(spark: SparkSession, d: str) -> DataFrame:
    found = raw.schema_difference(table(spark, d, "user_history"), table(spark, d, "impressions"))
    return spark.createDataFrame([(name, side) for side, some in found.items() for name, _ in sorted(some)], "name string, side string")


@query(
    "feature_store_parts",
    sql("sp", "SELECT split, count(*) AS impressions, count(DISTINCT user_id) AS users FROM sp GROUP BY split"),
)
def feature_store_parts(spark: SparkSession, d: str) -> DataFrame:
    """Impressions of a written feature store, read back part by part: only one part's folder is scanned for each."""
    out = shared_path(spark, "store")
    sinks.write_feature_store({"articles": v.articles(spark, d), "history": v.kept(spark, d, "history", v.history)}, v.split(spark, d), out)
    t = spark.read.parquet(f"{out}/impressions.parquet")
    return t.groupBy("split").agg(F.count(F.lit(1)).alias("impressions"), F.count_distinct("user_id").alias("users"))


@query(
    "retrieved_lists",
    sql("bt", "SELECT query, array_to_string(list(article_id ORDER BY rank), ' ') AS articles, round(list_max(list(score)), 6) AS best, count(*) AS n FROM bt GROUP BY query"),
)
def retrieved_lists(spark: SparkSession, d: str) -> DataFrame:
    lists = sinks.retrieved_lists(v.bm25_top(spark, d), "query")
    return lists.select(
        "query", F.array_join("retrieved_article_ids", " ").alias("articles"), F.round(F.array_max("retrieved_scores"), 6).alias("best"), F.size("retrieved_scores").cast("long").alias("n")
    )


@query("submission_is_valid", sql("cand", "SELECT impression_id, count(*) AS ranks, true AS valid FROM cand GROUP BY impression_id"))
def submission_is_valid(spark: SparkSession, d: str) -> DataFrame:
    """Each line of a submission holds every rank of its impression's candidates once."""
    lines = sinks.submission(v.bm25_scored(spark, d), "impression_id")
    ranks = F.split(F.regexp_extract("line", r"\[(.*)\]$", 1), ",").cast("array<int>")
    return lines.select("impression_id", F.size(ranks).cast("long").alias("ranks"), sinks.is_permutation(ranks).alias("valid"))


@query("first_impressions", sql("imp", f"SELECT impression_id, timestamp FROM imp WHERE timestamp IS NOT NULL ORDER BY timestamp, impression_id LIMIT {HEAD}"))
def first_impressions(spark: SparkSession, d: str) -> DataFrame:
    """The head of the impressions in the order of time."""
    t = v.impressions(spark, d).filter(F.col("timestamp").isNotNull()).select("impression_id", "timestamp")
    return t.orderBy("timestamp", "impression_id").limit(HEAD)


@query("most_popular_articles", sql("pop_all", f"SELECT article_id, n FROM pop_all ORDER BY n DESC, article_id LIMIT {HEAD}"))
def most_popular_articles(spark: SparkSession, d: str) -> DataFrame:
    """The head of the articles by clicks."""
    return reference._all_popularity(spark, d).orderBy(F.desc("n"), "article_id").limit(HEAD)


@query(
    "title_profile",
    """SELECT dataset, round(avg(length(title)), 6) AS mean_chars, max(length(title)) AS most_chars, round(avg(len(string_split(title, ' '))), 6) AS mean_pieces,
        count_if(len(list_filter(string_split(title, ' '), lambda x: x = '')) > 0)::BIGINT AS with_empty_pieces FROM articles WHERE title IS NOT NULL GROUP BY dataset""",
)
def title_profile(spark: SparkSession, d: str) -> DataFrame:
    """Characters of titles, and pieces between single blanks, empty ones kept."""
    t = table(spark, d, "articles").filter(F.col("title").isNotNull())
    pieces = F.split("title", " ", -1)
    return t.groupBy("dataset").agg(
        F.round(F.avg(F.char_length("title")), 6).alias("mean_chars"),
        F.max(F.char_length("title")).cast("long").alias("most_chars"),
        F.round(F.avg(F.size(pieces)), 6).alias("mean_pieces"),
        F.count_if(F.exists(pieces, lambda x: x == "")).alias("with_empty_pieces"),
    )


_DIMS = 8


@query(
    "embedded_articles",
    sql(
        "art",
        f"""SELECT article_id, i, round(avg(x) + 1e-7, 2) + 0.0 AS x FROM (
            SELECT article_id, unnest(range({_DIMS}))::INT AS i, unnest(list_transform(range({_DIMS}),
                lambda j: ('0x' || substr(md5(term), 2 * j::INT + 1, 2))::INT / 255 - 0.5)) AS x
            FROM (SELECT article_id, unnest(list_slice(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '[\\p{{L}}]+'), 1, 64)) AS term FROM art))
        GROUP BY ALL""",
    ),
)
def embedded_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles embedded by a plugged-in model, here one without weights, and mean-pooled over their terms; read back from a sink.

    Half of a last digit is rounded up, as numbers in single precision may lie on either side of it.
    """

    def build(s: SparkSession, at: str) -> DataFrame:
        out = shared_path(s, "embeddings")
        sinks.write_embeddings(em.embed(v.articles(s, at), "article_id", title_and_abstract(), em.hashed_terms(_DIMS)), out)
        return s.read.parquet(out)

    vectors = v.kept(spark, d, "embedded", build).filter(F.exists("embedding", lambda x: x != 0))
    return vectors.select("article_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round(F.col("x").cast("double") + 1e-7, 2) + 0.0)


@query(
    "popularity_topk",
    sql("q pop art", """SELECT query, article_id, n::DOUBLE AS score, rank FROM q JOIN (SELECT dataset, article_id, n, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, article_id) AS rank
        FROM pop JOIN art USING (article_id)) p ON p.dataset = q.dataset WHERE rank <= 50"""),
)
def popularity_topk(spark: SparkSession, d: str) -> DataFrame:
    """The most clicked articles as every query's list, by the same interface as the other methods."""
    method = Popular(reference.popularity_counts(spark, d), v.articles(spark, d))
    return method.top(method.users(v.queries(spark, d)), 50)


def _recalls(spark: SparkSession, d: str) -> DataFrame:
    """(dataset, method, measure, mean, n, cold) of both methods, as a report."""
    starts = reference.cold_start_counts(spark, d)
    out = None
    for method, f, cold in (("bm25", reference.bm25_recall_at_k, "without_recent"), ("embedding", reference.embedding_recall_at_k, "without_vector")):
        names = [f"recall_{k}" for k in reference.KS]
        one = f(spark, d).groupBy("dataset").agg(*[F.avg(n).alias(n) for n in names]).unpivot(["dataset"], names, "measure", "mean")
        one = one.join(starts.select("dataset", F.col("impressions").alias("n"), F.col(cold).alias("cold")), "dataset").withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "comparison_report",
    sql(
        "rec qv cl bt et",
        f"""SELECT dataset, measure, bm25, embedding, CASE WHEN measure <> 'cold_start' THEN
            CASE WHEN bm25 = embedding THEN 'tie' WHEN bm25 > embedding THEN 'bm25' ELSE 'embedding' END END AS best, false AS different_counts
        FROM (SELECT dataset, 'recall_' || k AS measure, round(avg(b), 5) AS bm25, round(avg(e), 5) AS embedding FROM (
            SELECT cl.dataset, impression_id, k, avg(CASE WHEN bt.rank <= k THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN et.rank <= k THEN 1.0 ELSE 0.0 END) AS e
            FROM cl LEFT JOIN bt USING (query, article_id) LEFT JOIN et ON et.query = cl.query AND et.article_id = cl.article_id,
                (SELECT unnest({reference.KS}) AS k) GROUP BY ALL) GROUP BY ALL
        UNION ALL SELECT rec.dataset, 'cold_start', round(count_if(len(recent) = 0) / count(*), 5), round(count_if(qv.query IS NULL) / count(*), 5)
            FROM rec LEFT JOIN qv USING (query) GROUP BY rec.dataset)""",
    ),
)
def comparison_report(spark: SparkSession, d: str) -> DataFrame:
    """Both methods' recalls written as JSON reports, read back and compared, with cold-start rates and a warning of unequal counts."""
    rows, paths = _recalls(spark, d), {}
    for method in ("bm25", "embedding"):
        paths[method] = f"{shared_path(spark, method)}.json"
        sinks.write_report(rows.filter(F.col("method") == method), paths[method])
    found = pipeline.compare(spark, paths, "bm25")
    return found.select("dataset", "measure", F.col("means")["bm25"].alias("bm25"), F.col("means")["embedding"].alias("embedding"), "best", "different_counts")


def _report(spark: SparkSession, d: str, scored: DataFrame, top: DataFrame) -> DataFrame:
    history = v.kept(spark, d, "history", v.history)
    found = pipeline.sliced_report(
        v.recent(spark, d), scored, top, v.articles(spark, d), reference.popularity_counts(spark, d), history.select("user_id", F.col("n").alias("length")),
        metrics.cold_threshold(history, "dataset", "n"), REPLICATES,
    )
    return found.withColumns({c: F.round(c, 5) for c in ("mean", "ci_low", "ci_high")})


def _report_sql(scored: str, top: str) -> str:
    n = REPLICATES
    return f"""SELECT dataset, slice, metric, round(any_value(mean), 5) AS mean, round(quantile_cont(boot, 0.025), 5) AS ci_low, round(quantile_cont(boot, 0.975), 5) AS ci_high,
            any_value(n) AS n
        FROM (SELECT dataset, slice, metric, b, sum(w * x) / nullif(sum(w), 0) AS boot FROM (SELECT *, {_weight_sql("impression_id", "b")} AS w FROM long, range({n}) r(b)) GROUP BY ALL)
        JOIN (SELECT dataset, slice, metric, avg(x) AS mean, count(*) AS n FROM long GROUP BY ALL) USING (dataset, slice, metric) GROUP BY ALL
        UNION ALL
        SELECT dataset, slice, 'coverage', round(any_value(mean), 5), round(quantile_cont(boot, 0.025), 5), round(quantile_cont(boot, 0.975), 5), any_value(n)
        FROM (SELECT dataset, slice, b, count(*) / any_value(articles) AS boot FROM (SELECT DISTINCT dataset, slice, b, article_id
                FROM (SELECT DISTINCT dataset, slice, query, b FROM known, range({n}) r(b) WHERE query <> '' AND {_weight_sql("impression_id", "b")} > 0) JOIN {top} USING (query))
            JOIN size USING (dataset) GROUP BY ALL)
        JOIN (SELECT dataset, slice, count(DISTINCT article_id) / any_value(articles) AS mean, count(DISTINCT impression_id) AS n
            FROM known JOIN {top} USING (query) JOIN size USING (dataset) GROUP BY ALL) USING (dataset, slice) GROUP BY ALL"""


def _report_ctes(scored: str, top: str) -> str:
    return f""",
    size AS (SELECT dataset, count(*) AS articles FROM art GROUP BY dataset),
    known AS MATERIALIZED (SELECT r.dataset, r.impression_id, r.query, unnest([CASE WHEN coalesce(h.n, 0) < threshold THEN 'cold' ELSE 'warm' END, 'all']) AS slice
        FROM rec r LEFT JOIN hist h USING (user_id) JOIN thr ON thr.dataset = r.dataset),
    lists AS MATERIALIZED (SELECT query, count(DISTINCT category) / nullif(count(category), 0) AS diversity,
            avg(-log2((coalesce(n, 0) + 1) / ((SELECT sum(n) FROM pop) + 1.0))) AS novelty
        FROM {top} LEFT JOIN art USING (article_id) LEFT JOIN pop USING (article_id) GROUP BY query),
    long AS MATERIALIZED (SELECT * FROM (UNPIVOT (SELECT k.dataset, k.slice, k.impression_id, m.auc, m.mrr, m.ndcg5, m.ndcg10, l.diversity, l.novelty
        FROM known k LEFT JOIN {_metrics_cte(scored)} m USING (impression_id) LEFT JOIN lists l USING (query))
        ON {", ".join([*METRICS, "diversity", "novelty"])} INTO NAME metric VALUE x))
"""


def _sliced_oracle(scored: str, top: str) -> str:
    whole = sql(f"{scored} {top} rec art pop hist thr disc", "")
    return whole.rstrip() + _report_ctes(scored, top) + _report_sql(scored, top)


@query("sliced_report_bm25", _sliced_oracle("bs", "bt"))
def sliced_report_bm25(spark: SparkSession, d: str) -> DataFrame:
    """All seven measures of BM25 by cold, warm and all impressions, with bootstrap intervals."""
    return _report(spark, d, v.bm25_scored(spark, d), v.bm25_top(spark, d))


@query("sliced_report_embedding", _sliced_oracle("es", "et"))
def sliced_report_embedding(spark: SparkSession, d: str) -> DataFrame:
    """All seven measures of the embeddings by cold, warm and all impressions, with bootstrap intervals."""
    return _report(spark, d, v.embedding_scored(spark, d), v.embedding_top(spark, d))
