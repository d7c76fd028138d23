import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newsweir.operators.history import history_asof, recent_history, tail
from newsweir.operators.split import assert_no_leakage, temporal_split

T = dt.datetime(2024, 1, 1)


def times(n, seed=0):
    rng = random.Random(seed)
    return [T + dt.timedelta(microseconds=rng.randrange(10**12) // 10**9 * 10**9 + rng.randrange(3)) for _ in range(n)]


def test_cuts_are_positions_of_the_sorted_times(spark):
    rows = [("a", t) for t in times(1000)] + [("b", t) for t in times(37, 1)] + [("a", None), (None, T)]
    got = temporal_split(spark.createDataFrame(rows, "g string, t timestamp_ntz"), "t", "g", 0.2, 0.2)
    assert got.count() == 1037
    assert_no_leakage(got, "t", "g")
    for g in "ab":
        mine = sorted(t for x, t in rows if x == g and t)
        cuts = mine[int(len(mine) * (1 - 0.2 - 0.2))], mine[int(len(mine) * 0.8)]
        want = {"train": sum(t < cuts[0] for t in mine), "val": sum(cuts[0] <= t < cuts[1] for t in mine), "test": sum(t >= cuts[1] for t in mine)}
        assert {r["split"]: r["count"] for r in got.filter(F.col("g") == g).groupBy("split").count().collect()} == want


def test_ties_at_a_cut_and_an_empty_table(spark):
    one = spark.createDataFrame([("a", T)] * 10, "g string, t timestamp_ntz")
    assert {r["split"] for r in temporal_split(one, "t", "g").collect()} == {"test"}
    assert temporal_split(one.limit(0), "t", "g").count() == 0


@pytest.mark.parametrize("fractions", [(0.6, 0.6), (0, 0.1), (0.5, 0.5), (1, 0.1)])
def test_bad_fractions(spark, fractions):
    with pytest.raises(ValueError):
        temporal_split(spark.createDataFrame([("a", T)], "g string, t timestamp_ntz"), "t", "g", *fractions)


def test_leakage_is_noticed(spark):
    rows = spark.createDataFrame([("a", T, "val"), ("a", T + dt.timedelta(1), "train")], "g string, t timestamp_ntz, split string")
    with pytest.raises(AssertionError):
        assert_no_leakage(rows, "t", "g")


def days(*n):
    return [T + dt.timedelta(i - 1) for i in n]


@pytest.mark.parametrize(
    "ids, at, cutoff, n, want",
    [
        (list("abcd"), days(1, 2, 3, 4), 3, 10, ["a", "b"]),
        (list("abcd"), None, 1, 10, list("abcd")),
        (list("abcde"), days(1, 2, 3, 4, 5), 5, 2, ["c", "d"]),
        (list("abcde"), days(1, 2, 3, 4, 5), 5, 10, list("abcd")),
        (list("abc"), days(1, 2), 5, 10, ["a", "b"]),
        (list("abc"), [T, None, T], 5, 10, ["a", "c"]),
        ([], [], 5, 10, []),
        (None, None, 5, 10, []),
    ],
)
def test_recent(spark, ids, at, cutoff, n, want):
    h = spark.createDataFrame([("u", ids, at)], "user_id string, ids array<string>, times array<timestamp_ntz>")
    imp = spark.createDataFrame([("i", "u", days(cutoff)[0]), ("j", None, T), ("k", "other", T)], "impression_id string, user_id string, timestamp timestamp_ntz")
    got = {r["impression_id"]: r["recent"] for r in recent_history(imp, h, n).collect()}
    assert got == {"i": want, "j": [], "k": []}


def test_no_tail_of_nothing():
    with pytest.raises(ValueError):
        tail(None, 0)


def test_history_asof_is_strict(spark):
    df = spark.createDataFrame([(["a"], [T], T)], "ids array<string>, times array<timestamp_ntz>, t timestamp_ntz")
    assert df.select(history_asof(F.col("ids"), F.col("times"), F.col("t")).alias("x")).first()["x"] == []
