import random
from collections import Counter

from pyspark.sql import functions as F

from newsweir.operators.skew import heavy_share, hot_keys, keyed_counts, lookup, salted_prefix, skew_join


def test_counts_are_exact_under_skew(spark):
    rng = random.Random(1)
    rows = [(f"r{i % 900}", rng.choice(["hot"] * 20 + [f"k{rng.randrange(50)}", None])) for i in range(2000)]
    df = spark.createDataFrame([(r, k, "x", 1) for r, k in rows], "id string, key string, n string, _n int")
    got = {r["key"]: r["count"] for r in keyed_counts(df, "id", "key", "count").collect()}
    assert got == Counter(k for _, k in set(rows))


def test_counts_of_nothing_and_of_records_without_id(spark):
    df = spark.createDataFrame([], "id string, key string")
    assert keyed_counts(df, "id", "key").count() == 0
    df = spark.createDataFrame([(None, "a"), ("r", None), ("r", None)], "id string, key string")
    assert [tuple(r) for r in keyed_counts(df, "id", "key").collect()] == [(None, 1)]


def test_heavy_share_counts_null_keys_in_the_total(spark):
    df = spark.createDataFrame([("f", "a", 2), ("f", "b", 1), ("f", None, 97), ("g", "a", 1)], "by string, key string, n long")
    got = {(r["by"], r["key"]) for r in heavy_share(df, "key", "n", 0.02, "by").collect()}
    assert got == {("f", "a"), ("g", "a")}


def test_skew_join_equals_a_plain_join(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else (None if i % 5 == 0 else f"k{i % 40}")) for i in range(3000)], "i int, key string")
    small = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 40, 2)], "key string, v int")
    hot = hot_keys(big, ["key"], big.count(), limit=4)
    assert [r["key"] for r in hot.collect()] == ["hot"]
    for how in ("inner", "left"):
        want = sorted(map(tuple, big.join(small, "key", how).select("i", "key", "v").collect()), key=str)
        got = sorted(map(tuple, skew_join(big, small, ["key"], hot, how).select("i", "key", "v").collect()), key=str)
        assert got == want
        for most in (1, 1000):
            assert sorted(map(tuple, lookup(big, small, ["key"], how, most).select("i", "key", "v").collect()), key=str) == want


def test_prefix_sums_over_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 4 else None, rng.randrange(2**32) // 2**20 * 2**20, rng.randrange(5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, key string, o long, size int")
    got = {r["id"]: r["before"] for r in salted_prefix(df, ["key"], "o", "id", F.col("size"), "before", 16).collect()}
    want, sums = {}, {}
    for i, k, _, s in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = sums.get(k, 0)
        sums[k] = want[i] + s
    assert got == want
    assert salted_prefix(df.limit(0), ["key"], "o", "id", F.col("size"), "before").count() == 0
