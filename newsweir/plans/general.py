"""Queries on skewed keys (p1) and on attributes as known at event time (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweir.operators.asof import ALWAYS, all_known, last_known, micros
from newsweir.operators.skew import heavy_share, keyed_counts
from newsweir.sources.tables import clean_ids, filled, table

HEAVY_SHARE = 0.02


def user_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions per user; those without user under null."""
    imp = table(spark, sf_dir, "impressions").select("impression_id", "user_id")
    return keyed_counts(imp, "impression_id", "user_id", "impressions")


def article_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks per article."""
    imp = table(spark, sf_dir, "impressions")
    one = imp.select("impression_id", F.explode(clean_ids("clicked")).alias("article_id"))
    return keyed_counts(one, "impression_id", "article_id", "clicks")


def heavy_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = user_impressions(spark, sf_dir).select(
        F.lit("user_id").alias("field_name"), F.col("user_id").alias("key_text"), F.col("impressions").alias("n")
    )
    articles = article_clicks(spark, sf_dir).select(
        F.lit("clicked").alias("field_name"), F.col("article_id").alias("key_text"), F.col("clicks").alias("n")
    )
    return heavy_share(users.unionByName(articles), "key_text", "n", HEAVY_SHARE, "field_name").select("field_name", "key_text")


def history_versions(history: DataFrame) -> DataFrame:
    """(user_id, known_at, article_id): when each entry of a history became known, in microseconds.

    Ids and timestamps match by position; an entry without a timestamp is not known. In a row whose
    whole timestamp list is null everything was always known, and its last element stands for it.
    """
    timed = history.filter(F.col("history_timestamps").isNotNull()).select(
        "user_id", F.inline(F.arrays_zip("history_article_ids", "history_timestamps"))
    )
    timed = timed.filter(filled(F.col("history_article_ids")) & F.col("history_timestamps").isNotNull()).select(
        "user_id", micros("history_timestamps").alias("known_at"), F.col("history_article_ids").alias("article_id")
    )
    ids = clean_ids("history_article_ids")
    untimed = history.filter(F.col("history_timestamps").isNull() & (F.size(ids) > 0)).select(
        "user_id", F.lit(ALWAYS).alias("known_at"), F.element_at(ids, -1).alias("article_id")
    )
    return timed.unionByName(untimed)


def history_entries(history: DataFrame) -> DataFrame:
    """As history_versions, but with every element of an untimed row."""
    timed = history.filter(F.col("history_timestamps").isNotNull())
    untimed = history.filter(F.col("history_timestamps").isNull())
    untimed = untimed.select(
        "user_id", F.lit(ALWAYS).alias("known_at"), F.explode(clean_ids("history_article_ids")).alias("article_id")
    )
    return history_versions(timed).unionByName(untimed)


def _asof(spark: SparkSession, sf_dir: str, operator, versions) -> DataFrame:
    imp = table(spark, sf_dir, "impressions").select("impression_id", "user_id", micros("timestamp").alias("at"))
    return operator(
        imp,
        versions(table(spark, sf_dir, "user_history")),
        entity="user_id",
        event_id="impression_id",
        event_time="at",
        version_time="known_at",
        value="article_id",
    )


def last_known_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, last_known, history_versions)


def known_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every impression with each article its user is known to have read before it."""
    return _asof(spark, sf_dir, all_known, history_entries)


QUERIES = {
    "p1_user_impressions": user_impressions,
    "p1_article_clicks": article_clicks,
    "p1_found": heavy_keys,
    "p6_known_history": known_history,
    "p6_found": last_known_article,
}

_CLICKS = """clicks AS (SELECT DISTINCT impression_id, article_id
    FROM (SELECT impression_id, unnest(clicked) AS article_id FROM impressions)
    WHERE impression_id IS NOT NULL AND length(trim(article_id)) > 0)"""
_VERSIONS = """versions AS (SELECT DISTINCT user_id, known_at, article_id FROM (
    SELECT user_id, unnest(history_article_ids) AS article_id,
        unnest(list_resize(history_timestamps, len(history_article_ids))) AS known_at
    FROM user_history WHERE history_timestamps IS NOT NULL
    UNION ALL
    SELECT user_id, %s AS article_id, TIMESTAMP '1800-01-01' AS known_at
    FROM user_history WHERE history_timestamps IS NULL AND len(history_article_ids) > 0)
    WHERE known_at IS NOT NULL AND length(trim(article_id)) > 0)"""

ORACLE = {
    "p1_user_impressions": """SELECT user_id, count(DISTINCT impression_id) AS impressions FROM impressions
        WHERE impression_id IS NOT NULL GROUP BY user_id""",
    "p1_article_clicks": f"WITH {_CLICKS} SELECT article_id, count(*) AS clicks FROM clicks GROUP BY article_id",
    "p1_found": f"""WITH {_CLICKS},
        n AS (SELECT 'user_id' AS field_name, user_id AS key_text, count(DISTINCT impression_id) AS n
            FROM impressions GROUP BY user_id
            UNION ALL SELECT 'clicked', article_id, count(*) FROM clicks GROUP BY article_id),
        t AS (SELECT *, sum(n) OVER (PARTITION BY field_name) AS whole FROM n)
        SELECT field_name, key_text FROM t WHERE n >= 0.02 * whole AND key_text IS NOT NULL""",
    "p6_found": f"""WITH {_VERSIONS % "history_article_ids[-1]"}
        SELECT i.impression_id, max_by(v.article_id, struct_pack(a := v.known_at, b := v.article_id)) AS article_id
        FROM (SELECT DISTINCT impression_id, user_id, timestamp FROM impressions) i
        JOIN versions v ON v.user_id = i.user_id AND v.known_at < i.timestamp
        WHERE i.impression_id IS NOT NULL GROUP BY i.impression_id""",
    "p6_known_history": f"""WITH {_VERSIONS % "unnest(history_article_ids)"}
        SELECT DISTINCT i.impression_id, v.article_id
        FROM impressions i JOIN versions v ON v.user_id = i.user_id AND v.known_at < i.timestamp
        WHERE i.impression_id IS NOT NULL""",
}
