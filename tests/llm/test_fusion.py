import random

import numpy as np
import pytest

from newsweir.llm.fusion import fused_ranking, majority_items, majority_winners, squash

C = "record string, method string, ids array<string>, scores array<double>, score string"


def fuse(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], C)
    return fused_ranking(df, "record", "method", "ids", "scores", **more)


def majority(spark, rows):
    return majority_items(spark.createDataFrame([(*r, "x") for r in rows], C), "record", "method", "ids", "scores")


def test_squash_keeps_order_and_bounds():
    score = np.array([1.0, 2, 3, 4, 1e9, 5, 5, 5, 7])
    seg = np.array([0, 0, 0, 0, 0, 1, 1, 1, 2])
    v = squash(score, seg)
    assert (np.diff(v[:5]) > 0).all() and v.min() > 0.02 and v.max() <= 1
    assert v[5] == v[6] == v[7] == pytest.approx(0.51) and v[8] == pytest.approx(0.51)
    assert squash(score[:5] * 1000 + 7, seg[:5]) == pytest.approx(v[:5], abs=1e-6)


def test_no_method_rules_by_its_range(spark):
    rows = [("i", "m1", ["a", "b", "c"], [0.3, 0.2, 0.1]), ("i", "m2", ["a", "b", "c"], [0.9, 0.8, 0.7]), ("i", "big", ["c", "b", "a"], [9e9, 8e9, 7e9])]
    assert [r["item"] for r in fuse(spark, rows).orderBy("rank").collect()] == ["a", "b", "c"]
    assert [tuple(r) for r in majority(spark, rows).collect()] == [("i", "a", 1, 3)]
    assert fuse(spark, rows, weights={"big": 9.0}).orderBy("rank").first()["item"] == "c"


def brute_winner(lists):
    best = {m: {} for m, _, _ in lists}
    for m, ids, scores in lists:
        for i, s in zip(ids or [], scores or []):
            if i and i.strip() and s is not None:
                best[m][i] = max(s, best[m].get(i, s))
    items = {i for b in best.values() for i in b}
    get = lambda m, i: best[m].get(i, -np.inf)
    return {x for x in items if all(sum(np.sign(0 if get(m, x) == get(m, y) else 1 if get(m, x) > get(m, y) else -1) for m in best) > 0 for y in items if y != x)}


def test_majority_against_brute_force(spark):
    rng = random.Random(1)
    records = {}
    for k in range(120):
        lists = []
        for m in rng.sample(["m1", "m2", "m3", "m4"], rng.randrange(1, 5)):
            n = rng.randrange(0, 7)
            ids = [rng.choice(["a", "b", "c", "d", "e", None, " "]) for _ in range(n)]
            lists.append((m, ids, [rng.choice([None, 1.0, 2.0, 3.0, 40.0]) for _ in ids]))
        records[f"r{k}"] = lists + ([lists[0]] if rng.random() < 0.3 else [])
    rows = [(k, *x) for k, lists in records.items() for x in lists]
    got = {}
    for r in fuse(spark, rows).collect():
        got.setdefault(r["record"], []).append(r)
    won = {r["record"]: r["item"] for r in majority(spark, rows).collect()}
    for k, lists in records.items():
        mine = got.get(k, [])
        assert ({won[k]} if k in won else set()) == brute_winner(lists)
        assert sorted(r["rank"] for r in mine) == list(range(1, len(mine) + 1))
        assert all(r["methods"] == len({m for m, _, _ in lists}) for r in mine)


def test_ties_nulls_and_nothing(spark):
    rows = [("i", "m", ["b", "a"], [1.0, 1.0]), ("j", "m", None, None), ("k", None, ["a"], [1.0]), (None, "m", ["a"], [1.0]), ("l", "m", ["a"], [float("nan")])]
    assert [(r["record"], r["item"], r["rank"]) for r in fuse(spark, rows).orderBy("rank").collect()] == [("i", "a", 1), ("i", "b", 2)]
    assert fuse(spark, []).count() == 0


def winners(*tables):
    v = np.concatenate([np.array(t, float) for t in tables])
    lengths = np.array([len(t) for t in tables])
    return majority_winners(v, v, np.r_[0, np.cumsum(lengths)[:-1]], lengths).tolist()


def test_winner_by_elimination():
    assert winners([[1, 3], [2, 2], [3, 1]], [[1, 1], [2, 2]], [[1, 1]], [[5, 5], [1, 1], [1, 1]]) == [-1, 4, 5, 6]
    # Where rounding makes bounded values equal the raw scores decide.
    assert majority_winners(np.array([[0.5], [0.5]]), np.array([[1.0], [1.0 + 1e-15]]), np.array([0]), np.array([2])).tolist() == [1]
