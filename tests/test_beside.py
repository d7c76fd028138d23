import numpy as np
import pytest

import newsweir.operators.beside as b
from newsweir.operators import metrics, vectors


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LISTS = [(f"q{i}", f"a{(i * j) % 17}") for i in range(9) for j in range(1, 6)]
LISTED = "query string, article_id string"


def test_novelty_leaves_lists_in_place(spark, monkeypatch):
    monkeypatch.setattr(b, "_ROWS", 4)
    clicks = {f"a{i}": i for i in range(1, 12)}
    pop = spark.createDataFrame(list(clicks.items()), "article_id string, n long")
    found = metrics.novelty(spark.createDataFrame(LISTS, LISTED), pop, 66, "query")
    assert "Join" not in plan(found)
    want = {q: np.mean([-np.log2((clicks.get(a, 0) + 1) / 67) for x, a in LISTS if x == q]) for q, _ in LISTS}
    assert {r["query"]: r["novelty"] for r in found.collect()} == pytest.approx(want)


def test_diversity_leaves_lists_in_place(spark, monkeypatch):
    monkeypatch.setattr(b, "_ROWS", 4)
    kinds = {f"a{i}": f"c{i % 3}" for i in range(1, 12)} | {"a0": None}
    found = metrics.diversity(spark.createDataFrame(LISTS, LISTED), spark.createDataFrame(list(kinds.items()), "article_id string, category string"), "query")
    assert "Join" not in plan(found)
    known = {q: [kinds[a] for x, a in LISTS if x == q and kinds.get(a)] for q, _ in LISTS}
    assert {r["query"]: r["diversity"] for r in found.collect()} == pytest.approx({q: len({*k}) / len(k) for q, k in known.items() if k})


def test_reranking_leaves_pairs_in_place(spark, monkeypatch):
    monkeypatch.setattr(b, "_ROWS", 4)
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((15, 4)).astype(np.float32), rng.standard_normal((8, 4))
    items = spark.createDataFrame([("d", f"a{i}", v.tolist()) for i, v in enumerate(x)], "dataset string, article_id string, vector array<float>")
    asks = spark.createDataFrame([("d", f"q{i}", v.tolist()) for i, v in enumerate(y)], "dataset string, query string, vector array<double>")
    pairs = spark.createDataFrame([*dict.fromkeys(LISTS)], LISTED)
    found = vectors.reranked(pairs, asks, items, 2)
    assert "Join" not in plan(found)
    scores = {(r["query"], r["article_id"]): r["score"] for r in vectors.candidate_cosines(pairs, asks, items).collect()}
    order = {q: sorted((-s, a) for (x, a), s in scores.items() if x == q)[:2] for q, _ in LISTS}
    assert sorted(map(tuple, found.collect())) == sorted((q, a, -s + 0.0, k + 1) for q, o in order.items() for k, (s, a) in enumerate(o))


def test_clicks_meet_few_of_the_rows_retrieved(spark):
    top = spark.createDataFrame([(f"q{i}", f"a{j}", j) for i in range(50) for j in range(20)], LISTED + ", rank int")
    wanted = spark.createDataFrame([("q1", "a2"), ("q7", "a3"), ("q7", "gone"), ("none", "a1")], LISTED)
    got = {(r["query"], r["article_id"]) for r in b.may_match(top, wanted, ["query", "article_id"]).collect()}
    assert got >= {("q1", "a2"), ("q7", "a3")} and len(got) < 10


def test_recall_joins_what_may_match(spark):
    top = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate("abcde")], LISTED + ", rank int")
    clicked = spark.createDataFrame([("1", "q", "a"), ("1", "q", "z")], "impression_id string, query string, article_id string")
    found = metrics.recall_at(clicked, top, ["impression_id"], "query", [3])
    assert "bitmap" in plan(found) and found.first()["recall_3"] == 0.5


def test_coverage_leaves_lists_in_place(spark, monkeypatch):
    monkeypatch.setattr(b, "_ROWS", 4)
    lists = spark.createDataFrame(LISTS, LISTED)
    seen = [(s, f"i{k}", f"q{k % 11}") for k in range(30) for s in ("all", "cold" if k % 3 else "warm")]
    asked = spark.createDataFrame(seen, "part string, imp string, query string")
    found = metrics.coverage_interval(asked, lists, "part", "imp", "query", spark.createDataFrame([("all", 20), ("cold", 20), ("warm", 20)], "part string, articles long"), 70)
    weight = {f"i{k}": metrics.poisson_weights(np.array([r["s"]]), 70)[0] > 0 for k, r in ((int(r["imp"][1:]), r) for r in asked.select("imp", metrics.seeds(asked["imp"]).alias("s")).distinct().collect())}
    for r in found.collect():
        mine = [(i, a) for s, i, q in seen if s == r["part"] for x, a in LISTS if x == q]
        boot = [len({a for i, a in mine if weight[i][n]}) / 20 for n in range(70)]
        assert (r["mean"], r["boot_mean"], r["n"]) == pytest.approx((len({a for _, a in mine}) / 20, np.mean(boot), len({i for i, _ in mine})))
        assert (r["ci_low"], r["ci_high"]) == pytest.approx(tuple(np.percentile(boot, [2.5, 97.5])))


def test_sliced_report_reads_stored_measures(spark):
    from newsweir.plans.pipeline import sliced_report

    rows = spark.createDataFrame([("d", f"i{k}", f"u{k % 4}", f"q{k % 9}") for k in range(20)], "dataset string, impression_id string, user_id string, query string")
    scored = spark.createDataFrame([(f"i{k}", p, int(p == k % 3), float(p)) for k in range(20) for p in range(3)], "impression_id string, pos int, label int, score double")
    articles = spark.createDataFrame([("d", f"a{i}", f"c{i % 3}") for i in range(17)], "dataset string, article_id string, category string")
    pop, lengths = spark.createDataFrame([("a1", 5)], "article_id string, n long"), spark.createDataFrame([(f"u{k}", k) for k in range(4)], "user_id string, length int")
    found = sliced_report(rows, scored, spark.createDataFrame(LISTS, LISTED), articles, pop, lengths, spark.createDataFrame([("d", 2.0)], "dataset string, threshold double"), 20)
    # Neither the ranking's windows nor the lists' measures are made again by each reader.
    assert "Window" not in plan(found)
    got = {(r["slice"], r["metric"]): (r["mean"], r["n"]) for r in found.collect()}
    assert len(got) == 21 and got["all", "mrr"][1] == 20 and got["cold", "auc"][1] == 10
    assert got["all", "coverage"][0] == pytest.approx(len({a for _, a in LISTS}) / 17)
