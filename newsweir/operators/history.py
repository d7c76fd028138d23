"""What a user had read before an impression, in the order of the history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweir.operators.skew import hot_keys, skew_join


def history_asof(ids: Column, times: Column, cutoff: Column) -> Column:
    """Ids whose time lies strictly before the cutoff, in list order; all of them if there is no time list.

    Ids and times match by position; entries without time are dropped. A null id list stays null.
    """
    pairs = F.filter(F.arrays_zip(ids.alias("id"), times.alias("at")), lambda x: x["at"] < cutoff)
    return F.when(times.isNull(), ids).otherwise(F.transform(pairs, lambda x: x["id"]))


def tail(items: Column, n: int) -> Column:
    """The last n elements, all of them if there are fewer."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), n)


def recent_history(impressions: DataFrame, history: DataFrame, n: int = 10) -> DataFrame:
    """`impressions` with `recent`: the last n articles of the user's history known before it.

    `history` has one row per user (user_id, ids, times). No user, no history or nothing known gives an
    empty list. Users with many of the impressions get their history by broadcast.
    """
    hot = hot_keys(impressions, ["user_id"], impressions.count())
    joined = skew_join(impressions, history.select("user_id", "ids", "times"), ["user_id"], hot, "left")
    known = history_asof(F.col("ids"), F.col("times"), F.col("timestamp"))
    return joined.withColumn("recent", F.coalesce(tail(known, n), F.array().cast("array<string>"))).drop("ids", "times")
