"""The cleaned tables the reference's queries start from, and their twins in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweir.operators import bm25, vectors
from newsweir.operators.dedupe import keep_first, one_per_id
from newsweir.operators.durable import file_system, release, stored
from newsweir.operators.history import recent_history
from newsweir.operators.partitions import spread
from newsweir.operators.split import temporal_split
from newsweir.sources.tables import clean_ids, filled, table

N_RECENT = 10
TOP = 200
_KEPT: dict[tuple[str, str, str], tuple[tuple, DataFrame]] = {}


def _files(spark: SparkSession, sf_dir: str) -> tuple:
    """Path, size and time of each table, a file or folder, under a folder: a table written anew is another one."""
    fs, at = file_system(spark, sf_dir)
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at))


def forget(spark: SparkSession) -> None:
    """Lets go of all stages kept for this application and deletes them."""
    for key in [k for k in _KEPT if k[0] == spark.sparkContext.applicationId]:
        del _KEPT[key]
    release(spark)


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """What `build` gives, written once per application and state of a directory, as the reference's stages write files."""
    key, files = (spark.sparkContext.applicationId, sf_dir, name), _files(spark, sf_dir)
    if key not in _KEPT or _KEPT[key][0] != files:
        _KEPT[key] = files, stored(build(spark, sf_dir), tidy=True)
    return _KEPT[key][1]


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per article id; of its copies the one that has an embedding."""
    columns = ["dataset", "title", "abstract", "category", "embedding"]
    return kept(spark, sf_dir, "articles", lambda s, d: one_per_id(table(s, d, "articles"), "article_id", columns))


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions with an id, copies once."""
    columns = ["dataset", "impression_id", "user_id", "timestamp", "candidates", "clicked"]

    def build(s: SparkSession, d: str) -> DataFrame:
        return table(s, d, "impressions").select(*columns).filter(F.col("impression_id").isNotNull()).distinct()

    return kept(spark, sf_dir, "impressions", build)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user, the latest and longest of the user's rows."""
    h = table(spark, sf_dir, "user_history").filter(F.col("user_id").isNotNull())
    order = [
        F.desc_nulls_last("last_history_time"),
        F.size("history_article_ids").desc_nulls_last(),
        F.array_join("history_article_ids", " ").desc_nulls_last(),
    ]
    one = keep_first(h, ["user_id"], order)
    return one.select(
        "dataset", "user_id", F.col("history_article_ids").alias("ids"), F.col("history_timestamps").alias("times"), F.size("history_article_ids").alias("n")
    )


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions with time and dataset, and their part of the dataset's split: an expression over the stored rows."""
    key, rows = (spark.sparkContext.applicationId, sf_dir, "split"), impressions(spark, sf_dir)
    if key not in _KEPT or _KEPT[key][0] is not rows:
        _KEPT[key] = rows, temporal_split(rows, "timestamp", "dataset")
    return _KEPT[key][1]


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test impressions with their users' recent articles; impressions of the same recent articles share a query."""

    def build(s: SparkSession, d: str) -> DataFrame:
        test = split(s, d).filter(F.col("split") == "test").drop("split")
        h = kept(s, d, "history", history)
        got = recent_history(test, h, N_RECENT)
        return got.withColumn("query", F.array_join("recent", " "))

    return kept(spark, sf_dir, "recent", build)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, query, recent): each distinct list of recent articles."""
    return recent(spark, sf_dir).filter(F.size("recent") > 0).select("dataset", "query", "recent").distinct()


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(impression_id, query, pos, article_id, label): what the test impressions showed."""
    shown = spread(recent(spark, sf_dir)).select("dataset", "impression_id", "query", "clicked", F.posexplode("candidates").alias("pos", "article_id"))
    label = F.coalesce(F.array_contains("clicked", F.col("article_id")), F.lit(False)).cast("int")
    return shown.filter(filled(F.col("article_id"))).select("dataset", "impression_id", "query", "pos", "article_id", label.alias("label"))


def clicked(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """`rows` with an article_id per element of their click lists."""
    return rows.withColumn("article_id", F.explode(clean_ids("clicked"))).drop("clicked")


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "weights", lambda s, d: bm25.term_weights(articles(s, d)))


def doc_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "doc_weights", lambda s, d: bm25.article_weights(weights(s, d)))


def bm25_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "bm25_queries", lambda s, d: bm25.query_terms(queries(s, d), articles(s, d)))


def bm25_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidates with their BM25 score."""

    def build(s: SparkSession, d: str) -> DataFrame:
        return bm25.candidate_scores(candidates(s, d), bm25_queries(s, d), doc_weights(s, d))

    return kept(spark, sf_dir, "bm25_scored", build)


def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "bm25_top", lambda s, d: bm25.top_articles(bm25_queries(s, d), doc_weights(s, d), TOP))


def article_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "vectors", lambda s, d: vectors.article_vectors(articles(s, d)))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "query_vectors", lambda s, d: vectors.query_vectors(queries(s, d), article_vectors(s, d)))


def embedding_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidates with the cosine of the user's vector and theirs."""

    def build(s: SparkSession, d: str) -> DataFrame:
        return vectors.candidate_cosines(candidates(s, d), query_vectors(s, d), article_vectors(s, d))

    return kept(spark, sf_dir, "embedding_scored", build)


def embedding_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "embedding_top", lambda s, d: vectors.top_articles(query_vectors(s, d), article_vectors(s, d), TOP))


TERM = r"'[\p{L}\p{Nl}\p{No}]+'"
#: Common table expressions by name, each with those it needs before it.
SQL = {
    "art": """SELECT max(dataset) AS dataset, article_id, max(title) AS title, max(abstract) AS abstract,
        max(category) AS category, max(embedding) AS embedding FROM articles WHERE article_id IS NOT NULL GROUP BY article_id""",
    "imp": """SELECT DISTINCT dataset, impression_id, user_id, timestamp, candidates, clicked FROM impressions
        WHERE impression_id IS NOT NULL""",
    "hist": """SELECT dataset, user_id, history_article_ids AS ids, history_timestamps AS times, len(history_article_ids) AS n
        FROM user_history WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id
            ORDER BY last_history_time DESC NULLS LAST, len(history_article_ids) DESC NULLS LAST,
            array_to_string(history_article_ids, ' ') DESC NULLS LAST) = 1""",
    "cuts": """SELECT dataset, t[1 + floor(n * 0.7::DOUBLE)::BIGINT] AS val_cut, t[1 + floor(n * 0.85::DOUBLE)::BIGINT] AS test_cut
        FROM (SELECT dataset, list_sort(list(timestamp)) AS t, count(*) AS n FROM imp
            WHERE timestamp IS NOT NULL AND dataset IS NOT NULL GROUP BY dataset)""",
    "sp": """SELECT imp.*, CASE WHEN timestamp < val_cut THEN 'train' WHEN timestamp < test_cut THEN 'val' ELSE 'test' END AS split
        FROM imp JOIN cuts USING (dataset) WHERE timestamp IS NOT NULL""",
    "rec": """SELECT * EXCLUDE (known), coalesce(list_slice(known, greatest(len(known) - 9, 1), len(known)), []) AS recent,
            coalesce(array_to_string(list_slice(known, greatest(len(known) - 9, 1), len(known)), ' '), '') AS query
        FROM (SELECT t.dataset, t.impression_id, t.user_id, t.timestamp, t.candidates, t.clicked,
            CASE WHEN h.times IS NULL THEN h.ids
                ELSE list_transform(list_filter(list_zip(h.ids, h.times), lambda x: x[2] < t.timestamp), lambda x: x[1]) END AS known
            FROM sp t LEFT JOIN hist h USING (user_id) WHERE t.split = 'test')""",
    "q": "SELECT DISTINCT dataset, query, recent FROM rec WHERE len(recent) > 0",
    "cand": """SELECT dataset, impression_id, query, pos, article_id, coalesce(list_contains(clicked, article_id), false)::INT AS label
        FROM (SELECT dataset, impression_id, query, clicked, unnest(candidates) AS article_id, unnest(range(len(candidates))) AS pos FROM rec)
        WHERE length(trim(article_id)) > 0""",
    "doc": f"""SELECT dataset, article_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), {TERM}) AS terms
        FROM art""",
    "tf": "SELECT dataset, article_id, term, count(*) AS tf FROM (SELECT dataset, article_id, unnest(terms) AS term FROM doc) GROUP BY ALL",
    "df": "SELECT dataset, term, count(*) AS df FROM tf GROUP BY ALL",
    "stats": "SELECT dataset, count(*) AS n, avg(len(terms)) AS mean FROM doc GROUP BY dataset",
    "w": """SELECT tf.dataset, tf.term, tf.article_id, tf, df,
            ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(terms) / mean)) AS weight
        FROM tf JOIN df USING (dataset, term) JOIN stats USING (dataset) JOIN doc USING (dataset, article_id)""",
    "qt": f"""SELECT DISTINCT x.dataset, query, unnest(regexp_extract_all(lower(title), {TERM})) AS term
        FROM (SELECT dataset, query, unnest(recent) AS article_id FROM q) x JOIN art USING (article_id)""",
    "bs": """SELECT c.*, coalesce(s.score, 0) AS score FROM cand c LEFT JOIN (
            SELECT p.query, p.article_id, round(sum(w.weight), 6) AS score FROM (SELECT DISTINCT dataset, query, article_id FROM cand) p
            JOIN w ON w.article_id = p.article_id JOIN qt ON qt.query = p.query AND qt.term = w.term GROUP BY ALL) s
        ON s.query = c.query AND s.article_id = c.article_id""",
    "bt": """SELECT query, article_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, article_id) AS rank
        FROM (SELECT qt.query, w.article_id, round(sum(w.weight), 6) AS score FROM qt JOIN w ON w.dataset = qt.dataset AND w.term = qt.term
            GROUP BY ALL) QUALIFY rank <= 200""",
    "vec": "SELECT dataset, article_id, embedding::DOUBLE[] AS v FROM art WHERE len(embedding) = 64",
    "qv": """SELECT dataset, query, list(m ORDER BY i) AS v FROM (SELECT dataset, query, i, avg(x) AS m FROM (
            SELECT x.dataset, query, unnest(vec.v) AS x, unnest(range(64)) AS i
            FROM (SELECT dataset, query, unnest(recent) AS article_id FROM q) x JOIN vec USING (article_id)) GROUP BY ALL) GROUP BY ALL""",
    "es": """SELECT c.*, round(coalesce(list_dot_product(vec.v, qv.v) / (greatest(sqrt(list_dot_product(vec.v, vec.v)), 1e-9)
            * greatest(sqrt(list_dot_product(qv.v, qv.v)), 1e-9)), 0), 6) AS score
        FROM cand c LEFT JOIN vec USING (article_id) LEFT JOIN qv ON qv.query = c.query""",
    "et": """SELECT query, article_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, article_id) AS rank
        FROM (SELECT query, vec.article_id, round(list_dot_product(vec.v, qv.v) / (CASE WHEN vv = 0 THEN 1 ELSE sqrt(vv) END
            * CASE WHEN qq = 0 THEN 1 ELSE sqrt(qq) END), 6) AS score
            FROM (SELECT *, list_dot_product(v, v) AS qq FROM qv) qv
            JOIN (SELECT *, list_dot_product(v, v) AS vv FROM vec) vec ON vec.dataset = qv.dataset) QUALIFY rank <= 200""",
    "pop": """SELECT article_id, count(*) AS n FROM (SELECT unnest(clicked) AS article_id FROM sp WHERE split = 'train')
        WHERE length(trim(article_id)) > 0 GROUP BY article_id""",
    "pop_all": """SELECT article_id, count(*) AS n FROM (SELECT unnest(clicked) AS article_id FROM sp)
        WHERE length(trim(article_id)) > 0 GROUP BY article_id""",
    "cl": """SELECT * FROM (SELECT dataset, impression_id, query, unnest(clicked) AS article_id FROM rec) WHERE length(trim(article_id)) > 0""",
    "thr": "SELECT dataset, coalesce(quantile_cont(n, 0.25), 0) AS threshold FROM hist GROUP BY dataset",
    "disc": "SELECT 0 AS place, 0::DOUBLE AS d UNION ALL SELECT r, sum(1 / log2(r + 1)) OVER (ORDER BY r) FROM range(1, 11) t(r)",
}
_NEEDS = {
    "cuts": ["imp"],
    "sp": ["cuts"],
    "rec": ["sp", "hist"],
    "q": ["rec"],
    "cand": ["rec"],
    "cl": ["rec"],
    "doc": ["art"],
    "tf": ["doc"],
    "df": ["tf"],
    "stats": ["doc"],
    "w": ["df", "stats"],
    "qt": ["q", "art"],
    "bs": ["cand", "w", "qt"],
    "bt": ["w", "qt"],
    "vec": ["art"],
    "qv": ["q", "vec"],
    "es": ["cand", "qv"],
    "et": ["qv"],
    "pop": ["sp"],
    "pop_all": ["sp"],
    "thr": ["hist"],
}


def sql(needs: str, select: str) -> str:
    """`select` with the named expressions, and those they need, before it."""
    found: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in found:
            found.append(name)

    for name in needs.split():
        add(name)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in found) + "\n" + select
