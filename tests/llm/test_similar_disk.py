"""The search for pairs: what it keeps on disk, and partitions with blocks and partitions of their own."""

import os
import threading

import numpy as np
import pytest

import newsweir.llm.similar as s


def vectors(n, rng):
    x = rng.standard_normal((n, 64)).astype(np.float32)
    x[: n // 10] = x[n // 2 : n // 2 + n // 10] + 0.4 * rng.standard_normal((n // 10, 64))
    return x


def expected(x):
    u = s.unit(x.astype(np.float64))
    return {(f"a{i:05d}", f"a{j:05d}") for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.9, 1)))}


def table(spark, x):
    return spark.createDataFrame([(f"a{i:05d}", r.tolist()) for i, r in enumerate(x)], "item string, v array<float>").repartition(4)


def test_disk_of_the_search(spark):
    """At most 6 times the bytes of the vectors at once, in shuffle files and stored tables."""
    x = vectors(6000, np.random.default_rng(3))
    df = table(spark, x).localCheckpoint()
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()) + [spark.conf.get("spark.checkpoint.dir")]

    def used():
        total = 0
        for d in dirs:
            for at, _, files in os.walk(d):
                for f in files:
                    try:
                        total += os.path.getsize(os.path.join(at, f))
                    except OSError:
                        pass
        return total

    floor, peak, done = used(), [0], threading.Event()

    def watch():
        while not done.wait(0.05):
            peak[0] = max(peak[0], used() - floor)

    t = threading.Thread(target=watch)
    t.start()
    try:
        pairs = {(r["a"], r["b"]) for r in s.similar_pairs(df, "item", "v", 64, 0.9, sample=3008, partition=32).collect()}
    finally:
        done.set()
        t.join()
    want = expected(x)
    assert len(want) > 300 and pairs <= want and len(pairs) >= 0.995 * len(want)
    assert peak[0] < 6 * x.nbytes, peak[0] / x.nbytes


@pytest.mark.parametrize("few, gather, copies", [(2, 1 << 20, 8), (32, 300, 8), (2, 400, 2)])
def test_partitions_within_and_blocks(spark, monkeypatch, few, gather, copies):
    for name, value in (("_FEW", few), ("_GATHER", gather), ("_COPIES", copies)):
        monkeypatch.setattr(s, name, value)
    x = vectors(3000, np.random.default_rng(5))
    pairs = [(r["a"], r["b"]) for r in s.similar_pairs(table(spark, x), "item", "v", 64, 0.9, sample=256, partition=60).collect()]
    want = expected(x)
    assert len(pairs) == len(set(pairs)) and set(pairs) <= want and len(pairs) >= 0.99 * len(want)


def test_zeros_of_either_sign_are_equal(spark):
    df = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [-0.0, 1.0])], "item string, v array<float>")
    assert {r["class"] for r in s.vector_classes(df, "item", "v", 2).collect()} == {"a"}
