import datetime as dt
import random

import newsweir.operators.asof as asof
from newsweir.operators.asof import ALWAYS, all_known, last_known
from newsweir.plans.general import history_entries, history_versions

NAMES = dict(entity="user", event_id="id", event_time="t", version_time="vt", value="item")
EVENTS, VERSIONS = "id string, user string, t long, start string", "user string, vt long, item string, _node int"


def brute(events, versions):
    last, known = {}, set()
    for i, u, t, _ in events:
        if i is None or u is None or t is None:
            continue
        seen = [(vt, item) for w, vt, item, _ in versions if w == u and vt is not None and item is not None and vt < t]
        if seen:
            last[i] = max(seen)[1]
            known |= {(i, item) for _, item in seen}
    return last, known


def check(spark, events, versions):
    e, v = spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS)
    last, known = brute(events, versions)
    assert {r["id"]: r["item"] for r in last_known(e, v, **NAMES).collect()} == last
    assert {(r["id"], r["item"]) for r in all_known(e, v, **NAMES).collect()} == known
    assert last_known(e, v, **NAMES).count() == len(last)


def test_against_brute_force_with_a_hot_user_and_ties(spark):
    rng = random.Random(3)
    day = 86_400_000_000
    events = [(f"e{i}", rng.choice(["hot"] * 5 + [f"u{j}" for j in range(12)]), rng.randrange(0, 40 * day, day // 8), "x") for i in range(700)]
    versions = [
        (rng.choice(["hot"] * 3 + [f"u{j}" for j in range(14)]), rng.randrange(-5 * day, 45 * day, day // 8), f"a{rng.randrange(30)}", 0) for _ in range(400)
    ]
    versions += [(u, ALWAYS, "old", 0) for u in ("u1", "u2")]
    check(spark, events + events[:50], versions + versions[:20])


def test_salted_nodes_and_leaves(spark, monkeypatch):
    """A third of all events at one moment of one user, and few events a node allowed."""
    monkeypatch.setattr(asof, "_EVENTS", 10)
    rng = random.Random(4)
    events = [(f"e{i}", "hot", 5_000, "") for i in range(150)]
    events += [(f"f{i}", rng.choice(["hot", "u", "w"]), rng.randrange(10_000), "") for i in range(300)]
    versions = [(rng.choice(["hot", "hot", "u", "w"]), rng.randrange(10_000), f"a{rng.randrange(9)}", 0) for _ in range(250)]
    check(spark, events, versions)


def test_nothing_at_the_moment_itself_or_later(spark):
    check(spark, [("e", "u", 100, "")], [("u", 100, "now", 0), ("u", 99, "before", 0), ("u", 101, "later", 0)])


def test_nulls_and_empty_tables(spark):
    events = [("e", "u", 5, ""), (None, "u", 5, ""), ("f", None, 5, ""), ("g", "u", None, "")]
    versions = [("u", 1, "a", 0), (None, 1, "b", 0), ("u", None, "c", 0), ("u", 3, None, 0)]
    check(spark, events, versions)
    e, v = spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS)
    for one, two in ((e.limit(0), v), (e, v.limit(0)), (e.limit(0), v.limit(0))):
        assert last_known(one, two, **NAMES).count() == 0
        assert all_known(one, two, **NAMES).count() == 0


def test_history_rows(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        ("a", ["x", "y", None, " "], [t, None, t, t]),
        ("b", ["x", "y"], None),
        ("c", None, None),
        ("d", [], []),
        ("e", ["x", "y"], [t]),
    ]
    h = spark.createDataFrame(rows, "user_id string, history_article_ids array<string>, history_timestamps array<timestamp_ntz>")
    at = int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert {tuple(r) for r in history_versions(h).collect()} == {("a", at, "x"), ("b", ALWAYS, "y"), ("e", at, "x")}
    assert {tuple(r) for r in history_entries(h).collect()} == {("a", at, "x"), ("b", ALWAYS, "x"), ("b", ALWAYS, "y"), ("e", at, "x")}
