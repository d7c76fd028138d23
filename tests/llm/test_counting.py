import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweir.llm.distinctive import distinctive_terms, fit_two_poisson
from newsweir.llm.frequent import frequent_items, misra_gries
from newsweir.llm.together import fit_configuration, poisson_binomial_tail, together


def test_misra_gries_bounds(spark):
    rng = random.Random(1)
    values = [f"v{min(int(rng.paretovariate(0.6)), 3000)}" for _ in range(20000)]
    df = spark.createDataFrame([(v, "x", 1) for v in values] + [(None, "x", 1)], "v string, item string, part int").repartition(7)
    true, k = Counter(values), 40
    got = {r["item"]: r for r in misra_gries(df, "v", k).collect()}
    assert len(got) <= k and {r["total"] for r in got.values()} == {len(values)}
    for v, n in true.items():
        if n > len(values) / (k + 1):
            assert v in got
    for v, r in got.items():
        assert r["low"] <= true[v] <= r["high"] <= r["low"] + len(values) / (k + 1)
    for share in (0.01, 0.2):
        exact = {r["item"]: r["n"] for r in frequent_items(df, "v", share).collect()}
        assert exact == {v: n for v, n in true.items() if n >= share * len(values)}


def test_misra_gries_edges(spark):
    df = spark.createDataFrame([], "v string")
    assert misra_gries(df, "v", 3).count() == 0 and frequent_items(df, "v", 0.1).count() == 0
    df = spark.createDataFrame([(None,), (None,)], "v string")
    assert misra_gries(df, "v", 3).count() == 0
    ties = spark.createDataFrame([(f"v{i}",) for i in range(100)], "v string").repartition(3)
    assert frequent_items(ties, "v", 0.02).count() == 0
    assert frequent_items(ties, "v", 0.01).count() == 100


def test_two_poisson_separates():
    rng = np.random.default_rng(2)
    n = 5000
    x = np.where(rng.random(n) < 0.05, rng.poisson(4, n), rng.poisson(0.1, n))
    tf, counts = np.unique(x[x > 0], return_counts=True)
    weight, elite, base = fit_two_poisson(np.array([counts.sum()]), np.zeros(len(tf), int), tf.astype(float), counts.astype(float), n)
    assert weight[0] == pytest.approx(0.05, abs=0.015) and elite[0] == pytest.approx(4, abs=0.5) and base[0] == pytest.approx(0.1, abs=0.03)


def test_distinctive_terms(spark):
    rows = [(f"d{i}", "the the the " + ("rare " * 4 if i in (3, 4) else "") + ("once" if i == 5 else ""), "x") for i in range(40)]
    rows += [rows[3], ("null", None, "x"), (None, "the lost", "x"), ("long", "word " * 20000, "x"), ("empty", "", "x")]
    df = spark.createDataFrame(rows, "id string, text string, term string").withColumn("df", F.lit(1))
    got = {(r["id"], r["term"]): r for r in distinctive_terms(df, "id", F.col("text")).collect()}
    assert {k[0] for k in got} == {f"d{i}" for i in range(40)} | {"long"}
    assert got["d3", "rare"]["tf"] == 4 and got["d3", "rare"]["df"] == 2 and got["d0", "the"]["df"] == 40
    assert got["d3", "rare"]["p_elite"] > 0.99 and got["long", "word"]["tf"] == 20000
    assert got["d3", "rare"]["score"] > 5 * got["d3", "the"]["score"]
    assert all(0 <= r["p_elite"] <= 1 and math.isfinite(r["score"]) for r in got.values())
    assert distinctive_terms(df.limit(0), "id", F.col("text")).count() == 0


def pairs_by_hand(records):
    items = Counter(i for r in records.values() for i in r)
    both = Counter((a, b) for r in records.values() for a in r for b in r if a < b)
    return {p: (n, items[p[0]], items[p[1]], n * len(records) / (items[p[0]] * items[p[1]])) for p, n in both.items()}


def test_pairs_against_brute_force(spark, monkeypatch):
    import newsweir.llm.together as t

    monkeypatch.setattr(t, "_BLOCK", 8)
    rng = random.Random(3)
    records = {f"r{i}": {f"i{min(int(rng.paretovariate(0.8)), 60)}" for _ in range(rng.randrange(1, 7))} for i in range(300)}
    records["big"] = {f"i{i}" for i in range(1, 61)}
    rows = [(r, i, "x") for r, s in records.items() for i in s]
    rows += rows[:40] + [(None, "i1", "x"), ("r1", None, "x")]
    df = spark.createDataFrame(rows, "rec string, it string, item string")
    want = pairs_by_hand(records)
    got = {(r["a"], r["b"]): (r["n"], r["n_a"], r["n_b"], pytest.approx(r["lift"])) for r in together(df, "rec", "it").collect()}
    assert got == want
    some = {(r["a"], r["b"]) for r in together(df, "rec", "it", min_count=4, min_lift=2.0).collect()}
    assert some == {p for p, (n, _, _, lift) in want.items() if n >= 4 and lift >= 2.0}
    found = together(df, "rec", "it", rate=0.05).collect()
    assert {r["surprising"] for r in found} <= {True, False} and all(r["log10_p"] <= 0 for r in found)


def test_surprise_is_not_found_in_chance(spark):
    rng = random.Random(4)
    rows = [(f"r{r}", f"i{rng.randrange(40)}") for r in range(600) for _ in range(4)]
    rows += [(f"p{r}", x) for r in range(30) for x in ("twin1", "twin2")]
    rows += [(f"s{r}", rng.choice(["twin1", "twin2"])) for r in range(30)]
    found = {(r["a"], r["b"]) for r in together(spark.createDataFrame(rows, "r string, i string"), "r", "i", rate=0.01).filter("surprising").collect()}
    assert ("twin1", "twin2") in found and len(found) <= 3


def test_no_pairs(spark):
    df = spark.createDataFrame([], "r string, i string")
    assert together(df, "r", "i", rate=0.1).count() == 0
    assert together(spark.createDataFrame([("r", "i")], "r string, i string"), "r", "i").count() == 0


def test_configuration_meets_the_degrees():
    k, m, s, r = np.array([1, 3, 10]), np.array([50, 20, 2]), np.array([1, 2, 5]), np.array([40, 25, 8])
    x, y = fit_configuration(k, m, s, r)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert p @ r == pytest.approx(k, rel=1e-4) and m @ p == pytest.approx(s, rel=1e-4)


def test_tails_against_convolution():
    rng = np.random.default_rng(5)
    q, times = rng.random((6, 5)) * [0.5, 0.05, 0.3, 0.01, 0.1], np.array([30, 200, 60, 500, 20])
    for row in q:
        p = np.ones(1)
        for x, n in zip(row, times):
            for _ in range(n):
                p = np.convolve(p, [1 - x, x])
        for n in (1, 2, 5, 10, 20, 38, 45, 60, 90):
            want = math.log10(p[n:].sum()) if p[n:].sum() > 1e-12 else math.log10(max(p[n:].sum(), 1e-300))
            got = poisson_binomial_tail(np.array([n]), row[None], times)[0]
            assert got == pytest.approx(want, abs=0.05), (n, row)
