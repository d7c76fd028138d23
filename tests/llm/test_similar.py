import numpy as np
from pyspark.sql import functions as F

import newsweir.llm.similar as s


def clustered(n, dims, rng, spread=0.6):
    centres = rng.standard_normal((20, dims))
    return (centres[rng.integers(0, 20, n)] + spread * rng.standard_normal((n, dims))).astype(np.float32)


def table(spark, x, ids=None):
    rows = [(i, v, "x", 0) for i, v in zip(ids or [f"a{i:05d}" for i in range(len(x))], [r.tolist() for r in x])]
    return spark.createDataFrame(rows, "item string, v array<float>, id string, part int")


def test_balanced_parts_cut_few_edges():
    x = s.unit(clustered(600, 16, np.random.default_rng(1)))
    graph = s.neighbour_graph(x, 8)
    part = s.balanced_partition(graph, 6)
    sizes = np.bincount(part, minlength=6)
    assert sizes.min() >= 98 and sizes.max() <= 102
    assert (part[graph] == part[:, None]).mean() > 2.5 / 6


def test_nearest_recall_and_pairs(spark, monkeypatch):
    monkeypatch.setattr(s, "PARTITION", 100)
    monkeypatch.setattr(s, "_BLOCK", 64)
    monkeypatch.setattr(s, "_SHARE", 100)
    rng = np.random.default_rng(2)
    x = clustered(1200, 16, rng)
    x[1100:] = x[:100] + 0.02 * rng.standard_normal((100, 16))
    df = table(spark, x)
    u = s.unit(x.astype(np.float64))
    cosine = u @ u.T
    np.fill_diagonal(cosine, -2)
    got = {}
    for r in s.nearest(df, "item", "v", 16, 10).collect():
        got.setdefault(r["item"], {})[r["rank"]] = (r["neighbour"], r["cosine"])
    truth = np.argsort(-cosine, axis=1)[:, :10]
    assert len(got) == 1200 and all(len(v) == 10 for v in got.values())
    hits = sum(len({f"a{j:05d}" for j in row} & {n for n, _ in got[f"a{i:05d}"].values()}) for i, row in enumerate(truth))
    assert hits >= 0.93 * 12000
    assert all(abs(c - cosine[int(i[1:]), int(n[1:])]) < 1e-9 for i, v in list(got.items())[:50] for n, c in v.values())
    want = {(f"a{i:05d}", f"a{j:05d}") for i, j in zip(*np.nonzero(np.triu(cosine >= 0.9)))}
    pairs = [(r["a"], r["b"]) for r in s.similar_pairs(df, "item", "v", 16, 0.9).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) <= want and len(pairs) >= 0.99 * len(want)


def test_copies_nulls_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        ("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("b", None), ("a", [1.0, 0.0]), ("c", [2.0, 0.1]), ("d", [0.0, 1.0]),
        ("zero", [0.0, 0.0]), ("short", [1.0]), ("empty", []), ("null", None), (None, [1.0, 0.0]), ("hole", [1.0, None]), ("nan", [nan, 1.0]), ("inf", [inf, 1.0]),
    ]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "item string, v array<float>, class string")
    assert {(r["a"], r["b"]) for r in s.similar_pairs(df, "item", "v", 2, 0.9).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    got = {(r["item"], r["rank"]): r["neighbour"] for r in s.nearest(df, "item", "v", 2, 2).collect()}
    assert got == {("a", 1): "b", ("a", 2): "c", ("b", 1): "a", ("b", 2): "c", ("c", 1): "a", ("c", 2): "b", ("d", 1): "c", ("d", 2): "a"}


def test_a_class_of_copies_has_k_neighbours_each(spark):
    df = table(spark, np.ones((30, 2), np.float32))
    got = s.nearest(df, "item", "v", 2, 3).groupBy("item").agg(F.count("*").alias("n")).collect()
    assert len(got) == 30 and {r["n"] for r in got} == {3}


def test_nothing(spark):
    df = table(spark, np.zeros((0, 2), np.float32))
    assert s.similar_pairs(df, "item", "v", 2, 0.9).count() == 0 and s.nearest(df, "item", "v", 2, 3).count() == 0


def test_two_levels(spark, monkeypatch):
    """So few vectors to learn from that each partition gets partitions of its own."""
    rng = np.random.default_rng(4)
    x = clustered(4000, 16, rng)
    x[3900:] = x[:100] + 0.02 * rng.standard_normal((100, 16))
    df = table(spark, x).repartition(4)
    index = s.Index(s.vector_classes(df, "item", "v", 16), 16, k=10, sample=256, partition=60)
    sizes = [r["count"] for r in index.homes.groupBy("part").count().collect()]
    assert index.below is not None and sum(sizes) == 4000 and len(sizes) > 30 and max(sizes) < 600
    u = s.unit(x.astype(np.float64))
    cosine = u @ u.T
    np.fill_diagonal(cosine, -2)
    got = s.measured_recall(df, "item", "v", 16, 10, F.col("item").endswith("0"), sample=256, partition=60).first()
    assert got["queries"] == 400 and got["recall"] > 0.9
    want = {(f"a{i:05d}", f"a{j:05d}") for i, j in zip(*np.nonzero(np.triu(cosine >= 0.9)))}
    pairs = [(r["a"], r["b"]) for r in s.similar_pairs(df, "item", "v", 16, 0.9, sample=256, partition=60).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) <= want and len(pairs) >= 0.99 * len(want)


def test_classes_and_a_crowd_of_copies(spark, monkeypatch):
    monkeypatch.setattr(s, "_LIST", 7)
    x = np.array([[1.0, 0]] * 40 + [[1, 0.1]] * 3 + [[0, 1]] + [[0.9, 0.05]], np.float32)
    df = table(spark, x)
    links, members = s.similar_classes(df, "item", "v", 2, 0.9)
    got = {r["item"]: (r["class"], r["links"]) for r in s.class_links(links, members).collect()}
    assert len(got) == 45 and got["a00039"] == ("a00000", 2) and got["a00042"] == ("a00040", 2) and got["a00043"] == ("a00043", 0)
    pairs = [(r["a"], r["b"]) for r in s.similar_pairs(df, "item", "v", 2, 0.9).collect()]
    near = [f"a{i:05d}" for i in (*range(43), 44)]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(p, q) for p in near for q in near if p < q}
