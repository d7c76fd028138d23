"""Probes must serve the vectors that the router was not trained on."""

import numpy as np

import newsweir.llm.similar as s


def test_recall_of_unseen_vectors(spark, monkeypatch):
    monkeypatch.setattr(s, "PARTITION", 100)
    monkeypatch.setattr(s, "SAMPLE", 320)
    x = np.random.default_rng(7).standard_normal((2400, 32)).astype(np.float32)
    df = spark.createDataFrame([(f"a{i:05d}", r.tolist()) for i, r in enumerate(x)], "item string, v array<float>").repartition(5)
    u = s.unit(x.astype(np.float64))
    cosine = u @ u.T
    np.fill_diagonal(cosine, -2)
    truth = np.argsort(-cosine, axis=1)[:, :10]
    got = {(r["item"], r["neighbour"]) for r in s.nearest(df, "item", "v", 32, 10).collect()}
    hits = sum((f"a{i:05d}", f"a{j:05d}") in got for i, row in enumerate(truth) for j in row)
    assert hits >= 0.955 * truth.size, hits / truth.size
    row, near = s.true_nearest(s.vector_classes(df, "item", "v", 32).withColumnRenamed("item", "id"), ["a00003", "a00008"], u[[3, 8]], 10)
    for n, i in enumerate((3, 8)):
        assert np.allclose(np.sort(near[row == n] @ u[i]), np.sort(cosine[i])[-10:])
