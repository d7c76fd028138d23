import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweir.llm.mixing import largest_exact_total, mix, share_out, tree_budgets
from newsweir.llm.packing import combinations, pack, plan_containers, solve_nonnegative
from newsweir.llm.tokens import TokenCounter, with_tokens

TEXTS = ["", "a", "Hello world", " leading", "two  blanks", "tab\there", "line\n \nnext", "x\n y", "it's we'll", "end ", "ÆØÅ 🌊👍 1234", "a b c", "﻿x", "<|endoftext|> no", "w" * 3000]


def test_counts_are_the_tokenizer_s():
    count = TokenCounter()
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice([" ", "  ", "\n", "word", "7", ".", "é", "\t", "'s"]) for _ in range(40)) for _ in range(500)]
    for t in texts:
        assert count(t) == len(count.encoding.encode_ordinary(t)), repr(t)
    assert count(None) == 0


def test_with_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world", "n"), (2, None, "n"), (3, "long " * 50000, "n")], "id long, text string, other string")
    got = {r["id"]: (r["tokens"], r["other"]) for r in with_tokens(df, "text").collect()}
    assert got[1] == (2, "n") and got[2] == (0, "n") and got[3][0] >= 50000
    assert with_tokens(df.limit(0), "text").count() == 0


def test_least_squares():
    a = np.random.default_rng(1).random((10, 15))
    x = np.maximum(np.random.default_rng(2).standard_normal(15), 0)
    assert np.linalg.norm(a @ solve_nonnegative(a, a @ x, 20000) - a @ x) < 1e-2
    assert all(95 <= sum(c) <= 96 and len(c) <= 3 for c in combinations())


@pytest.mark.parametrize("capacity", [3, 100, 1000])
def test_plans_use_every_piece_once(capacity):
    rng = random.Random(capacity)
    counts = Counter(rng.randrange(1, capacity) for _ in range(3000))
    used: Counter = Counter()
    plan = plan_containers(dict(counts), capacity)
    for pieces, times in plan:
        assert times > 0 and sum(k * n for k, n in pieces.items()) <= capacity
        for k, n in pieces.items():
            used[k] += n * times
    assert used == counts
    room = sum(t for _, t in plan) * capacity
    assert sum(k * n for k, n in counts.items()) / room > 0.97


def test_pack(spark):
    rng = random.Random(5)
    sizes = [rng.choice([0, 7, 7, 7, 50, 100, 101, 250, rng.randrange(1, 400)]) for _ in range(1500)]
    df = spark.createDataFrame([(i, n, "x", 1) for i, n in enumerate(sizes)] + [(9999, None, "x", 1)], "doc long, n int, spec string, container int")
    got = pack(df, "doc", "n", {"s": 100, "l": 1000}).collect()
    for spec, capacity in (("s", 100), ("l", 1000)):
        mine = [r for r in got if r["spec"] == spec]
        held, of = Counter(), {}
        for r in mine:
            held[r["container"]] += r["n"]
            of.setdefault(r["doc"], []).append(r)
        assert max(held.values()) <= capacity
        assert set(of) == set(range(1500)) | {9999}
        for d, parts in of.items():
            n = sizes[d] if d < 1500 else 0
            assert sum(p["n"] for p in parts) == n and sorted(p["part"] for p in parts) == list(range(len(parts)))
            assert len(parts) == (1 if n <= capacity else -(-n // capacity))
        full = [n for c, n in held.items() if n]
        assert sum(full) / (len(full) * capacity) > 0.93
    assert pack(df.limit(0), "doc", "n", {"s": 100}).count() == 0
    with pytest.raises(ValueError):
        pack(df, "doc", "n", {"s": 0})


def test_sharing_out():
    assert share_out(10, {"a": 1, "b": 1}, {"a": 2, "b": 20}) == {"a": 2, "b": 8}
    assert share_out(10, {"a": 1, "b": 3}, {"a": 1, "b": 2}) == {"a": 1, "b": 2}
    assert share_out(10, {"a": 0, "b": 0}, {"a": 5, "b": 5}) == {"a": 0, "b": 0}


def leaf(source, domain, language, share, limit):
    return {"source": source, "domain": domain, "language": language, "share": share, "limit": limit}


def test_siblings_before_ancestors():
    leaves = [leaf("a", "news", "en", 0.25, 5), leaf("b", "news", "en", 0.25, 99), leaf("c", "news", "da", 0.25, 99), leaf("d", "mail", "en", 0.25, 99)]
    got = {k[2]: n for k, n in tree_budgets(100, leaves).items()}
    assert got == pytest.approx({"a": 5, "b": 45, "c": 25, "d": 25})
    leaves[1]["limit"] = 15
    assert {k[2]: n for k, n in tree_budgets(100, leaves).items()} == pytest.approx({"a": 5, "b": 15, "c": 55, "d": 25})
    # One source in two leaves: what its small one lacks goes to the sibling beside it, not to its other leaf.
    two = [leaf("a", "news", "en", 0.25, 5), leaf("b", "news", "en", 0.25, 99), leaf("a", "news", "da", 0.5, 99)]
    assert tree_budgets(100, two) == pytest.approx({("news", "en", "a"): 5, ("news", "en", "b"): 45, ("news", "da", "a"): 50})
    assert largest_exact_total(leaves) == pytest.approx(20)


DOCS = "doc long, src string, lang string, kind string, n int, source string"


def docs(spark, rng):
    rows = [(i, rng.choice(["A ", "a", "big", "BIG", "x_y", "X-Y", None]), rng.choice(["en", None]), "k", rng.randrange(5, 60), "x") for i in range(4000)]
    return rows + [(None, "a", "en", "k", 5, "x"), (5000, "a", "en", "k", None, "x"), (5001, "a", "en", "k", 0, "x")]


def mixed(spark, rows, targets, total):
    t = spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int")
    df = spark.createDataFrame(rows, DOCS)
    return mix(df, t, doc="doc", source="src", domain=F.col("kind"), language="lang", size="n", total=total)


@pytest.mark.parametrize("total", ["exact", "all"])
def test_mix(spark, total):
    rows = docs(spark, random.Random(7))
    targets = [("m", "a", 0.5, 2), ("m", "big", 0.3, 1), ("m", "x-y", 0.2, 1), ("gone", "nowhere", 1.0, 3), ("half", "nowhere", 0.5, 3), ("half", "a", 0.5, 1)]
    chosen, shares = mixed(spark, rows, targets, total)
    got = chosen.collect()
    size = {r[0]: r[4] or 0 for r in rows}
    for name in ("m", "half"):
        mine = [r for r in got if r["mix_name"] == name]
        assert len({r["doc"] for r in mine}) == len(mine)
        repeats = {s: k for m, s, _, k in targets if m == name}
        assert all(0 < r["copies"] <= repeats[r["source"]] and r["n"] == size[r["doc"]] for r in mine)
        whole = sum(r["n"] * r["copies"] for r in mine)
        told = {r["source"]: r for r in shares.collect() if r["mix_name"] == name}
        for s, r in told.items():
            tokens = sum(x["n"] * x["copies"] for x in mine if x["source"] == s)
            assert r["tokens"] == tokens and r["reached_share"] == pytest.approx(tokens / whole)
            assert r["reached_share"] == pytest.approx(r["planned_share"], abs=0.003)
            if total == "exact" and name == "m":
                assert r["reached_share"] == pytest.approx(r["target_share"], abs=0.003)
    told = {(r["mix_name"], r["source"]): r for r in shares.collect()}
    assert told["gone", "nowhere"]["reached_share"] == 0 and told["half", "a"]["reached_share"] == 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixed(spark, rows, targets, total)[0].collect()))


def test_siblings_run_short(spark):
    """Small leaves give what they can; the rest comes from the same domain and language, and shares say so."""
    rows = [(i, "small", "en", "news", 10, "x") for i in range(20)] + [(100 + i, "large", "en", "news", 10, "x") for i in range(400)]
    rows += [(1000 + i, "other", "da", "mail", 10, "x") for i in range(400)]
    targets = [("m", "small", 0.4, 2), ("m", "large", 0.1, 1), ("m", "other", 0.5, 1)]
    told = {r["source"]: r for r in mixed(spark, rows, targets, "all")[1].collect()}
    # Of 8,200 tokens the other domain gives all its 4,000; of the 4,200 left the small source gives all it may, the large one the rest.
    assert {s: r["tokens"] for s, r in told.items()} == {"small": 400, "large": 3800, "other": 4000}
    assert told["small"]["most_copies"] == 2


def test_mix_of_nothing(spark):
    chosen, shares = mixed(spark, [], [("m", "a", 1.0, 1)], "exact")
    assert chosen.count() == 0 and shares.first()["tokens"] == 0
