import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from newsweir.operators import metrics
from newsweir.sources.sinks import is_permutation, submission

S = "id string, pos int, label int, score double"


def brute(scores, labels):
    """Metrics as means over all orders of tied scores; the reciprocal rank by position."""
    n, p = len(labels), sum(labels)
    if not p:
        return None, None, None, None
    auc = None
    if p < n:
        pairs = [(a > b) + (a == b) / 2 for a, x in zip(scores, labels) if x for b, y in zip(scores, labels) if not y]
        auc = sum(pairs) / len(pairs)
    order = sorted(range(n), key=lambda i: (-scores[i], i))
    mrr = 1 / (1 + next(k for k, i in enumerate(order) if labels[i]))
    groups = [list(g) for _, g in itertools.groupby(order, key=lambda i: scores[i])]

    def ndcg(k):
        gain, place = 0.0, 0
        for g in groups:
            share = sum(labels[i] for i in g) / len(g)
            gain += share * sum(1 / math.log2(r + 2) for r in range(place, min(place + len(g), k)))
            place += len(g)
        return gain / sum(1 / math.log2(r + 2) for r in range(min(p, k)))

    return auc, mrr, ndcg(5), ndcg(10)


def test_ranking_metrics_against_brute_force(spark):
    rng = random.Random(5)
    lists = {"perfect": ([0.9, 0.5, 0.1], [1, 0, 0]), "worst": ([0.9, 0.5, 0.1], [0, 0, 1]), "none": ([1, 2], [0, 0]), "all": ([1, 2], [1, 1])}
    lists["one"] = ([1], [1])
    lists["tied"] = ([0] * 12, [0, 0, 0, 1] + [0] * 8)
    for i in range(60):
        n = rng.randrange(1, 15)
        lists[f"r{i}"] = ([rng.randrange(4) for _ in range(n)], [rng.randrange(2) for _ in range(n)])
    rows = [(k, i, y, float(s)) for k, (ss, ys) in lists.items() for i, (s, y) in enumerate(zip(ss, ys))]
    got = {r["id"]: r[1:] for r in metrics.ranking_metrics(spark.createDataFrame(rows, S), ["id"]).collect()}
    assert set(got) == set(lists)
    for k, (s, y) in lists.items():
        for a, b in zip(got[k], brute(s, y)):
            assert a == b or a == pytest.approx(b, abs=1e-9), k
    assert got["perfect"] == (1, 1, 1, 1)
    assert got["worst"][:2] == (0, pytest.approx(1 / 3))
    assert got["tied"][0] == 0.5 and got["tied"][2] == pytest.approx(0.2457049266)


def test_diversity_and_novelty(spark):
    cats = spark.createDataFrame([("a", "sport"), ("b", "sport"), ("c", "news"), ("n", None)], "article_id string, category string")
    lists = [("1", x) for x in "abc"] + [("2", "a"), ("2", "a"), ("3", "unknown"), ("4", "n")]
    df = spark.createDataFrame(lists, "id string, article_id string")
    assert {r["id"]: r["diversity"] for r in metrics.diversity(df, cats, "id").collect()} == {"1": pytest.approx(2 / 3), "2": 0.5}
    pop = spark.createDataFrame([("popular", 1000), ("rare", 1)], "article_id string, n long")
    df = spark.createDataFrame([(x, x) for x in ("popular", "rare", "unseen")], "id string, article_id string")
    got = {r["id"]: r["novelty"] for r in metrics.novelty(df, pop, 1000, "id").collect()}
    assert got["unseen"] > got["rare"] > got["popular"]


def test_bootstrap(spark):
    assert metrics.bootstrap_ci([])["n"] == 0 and math.isnan(metrics.bootstrap_ci([])["mean"])
    values = [random.Random(6).random() for _ in range(300)]
    local = metrics.bootstrap_ci(values)
    df = spark.createDataFrame([("g", f"k{i}", v) for i, v in enumerate(values)] + [("g", "null", None), ("h", "k", None)], "g string, k string, v double")
    got = metrics.bootstrap_means(df, ["g"], "k", "v", 200).collect()
    assert len(got) == 1 and got[0]["n"] == 300 and got[0]["mean"] == pytest.approx(local["mean"])
    assert got[0]["ci_low"] == pytest.approx(local["ci_low"], abs=0.01) and got[0]["ci_high"] == pytest.approx(local["ci_high"], abs=0.01)


def test_bootstrap_coverage(spark):
    imp = spark.createDataFrame([("g", f"i{i}", f"q{i % 30}") for i in range(60)] + [("g", "cold", "none")], "g string, k string, q string")
    lists = spark.createDataFrame([(f"q{i}", f"a{j}") for i in range(30) for j in (i, i + 1)], "q string, article_id string")
    catalog = spark.createDataFrame([("g", 62)], "g string, articles long")
    got = metrics.coverage_interval(imp, lists, "g", "k", "q", catalog, 40).first()
    assert got["mean"] == 0.5 and got["n"] == 60 and got["ci_low"] <= got["boot_mean"] <= got["ci_high"] <= got["mean"]


def test_cold_and_threshold(spark):
    df = spark.createDataFrame([("g", i) for i in range(1, 101)] + [("empty", None)], "g string, n int")
    got = {r["g"]: r["threshold"] for r in metrics.cold_threshold(df, "g", "n").collect()}
    assert got == {"g": 25.75, "empty": 0.0}
    df = spark.createDataFrame([(0,), (4,), (5,), (10,), (None,)], "n int")
    assert [r[0] for r in df.select(metrics.cold_or_warm(F.col("n"), F.lit(5))).collect()] == ["cold", "cold", "warm", "warm", "cold"]


def test_popularity_scopes(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("b",)], "article_id string")
    assert {r["article_id"]: r["n"] for r in metrics.popularity(df).collect()} == {"a": 2, "b": 2}


@pytest.mark.parametrize("scores, want", [([0.1, 0.9, 0.5], "[3,1,2]"), ([0, 0, 0], "[1,2,3]"), ([2, 9, 4, 3, 6, 8, 1, 5, 7], "[8,1,6,7,4,2,9,5,3]")])
def test_submission_lines(spark, scores, want):
    df = spark.createDataFrame([("6451339", i, float(s)) for i, s in enumerate(scores)], "id string, pos int, score double")
    assert submission(df, "id").first()["line"] == f"6451339 {want}"
    ok = spark.createDataFrame([([3, 1, 2],), ([1, 1, 2],)], "r array<int>").select(is_permutation(F.col("r")))
    assert [r[0] for r in ok.collect()] == [True, False]
