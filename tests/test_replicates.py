import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweir.operators.metrics import bootstrap_means, coverage_interval, poisson_weights, seeds


@pytest.mark.parametrize("replicates", [1, 62, 63, 150, 1000])
def test_coverage_with_any_number_of_replicates(spark, replicates):
    imp = spark.createDataFrame([("a", f"i{i}", f"q{i % 7}") for i in range(25)], "dataset string, impression_id string, query string")
    lists = [(f"q{q}", f"a{q * 2 + x}") for q in range(6) for x in range(3)]
    catalog = spark.createDataFrame([("a", 20)], "dataset string, articles long")
    got = coverage_interval(imp, spark.createDataFrame(lists, "query string, article_id string"), "dataset", "impression_id", "query", catalog, replicates).first()
    rows = imp.select("query", seeds(F.col("impression_id")).alias("s")).collect()
    weights = poisson_weights(np.array([r["s"] for r in rows]), replicates)
    asked = [{r["query"] for r, w in zip(rows, weights[:, b]) if w > 0} for b in range(replicates)]
    share = [len({a for q, a in lists if q in s}) / 20 for s in asked]
    assert got["mean"] == len({a for _, a in lists}) / 20 and got["n"] == sum(i % 7 < 6 for i in range(25))
    assert got["boot_mean"] == pytest.approx(np.mean(share))
    assert (got["ci_low"], got["ci_high"]) == pytest.approx(tuple(np.percentile(share, [2.5, 97.5])))


def test_weights_are_poisson():
    w = poisson_weights(np.random.default_rng(1).integers(0, 2**32, 2000), 500).astype(float)
    share = np.bincount(w.ravel().astype(int), minlength=4)[:4] / w.size
    assert share == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=2e-3)
    assert np.abs(np.corrcoef(w[:, :40].T) - np.eye(40)).max() < 0.12 and np.abs(np.corrcoef(w[:40]) - np.eye(40)).max() < 0.25


def test_means_by_group_against_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [("ab"[i % 2], f"k{i}", None if i % 10 == 0 else float(x)) for i, x in enumerate(rng.normal(3, 2, 900))] + [("c", "k", None)]
    df = spark.createDataFrame(rows, "g string, key string, x double").repartition(5)
    got = {r["g"]: r for r in bootstrap_means(df, ["g"], "key", "x", 1000).collect()}
    assert set(got) == {"a", "b"}
    for g in "ab":
        some = df.filter((F.col("g") == g) & F.col("x").isNotNull()).select("x", seeds(F.col("key")).alias("s")).toPandas()
        w = poisson_weights(some["s"].to_numpy(), 1000)
        means = (some["x"].to_numpy() @ w) / w.sum(0)
        assert got[g]["n"] == len(some) and got[g]["mean"] == pytest.approx(some["x"].mean())
        assert (got[g]["ci_low"], got[g]["ci_high"]) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
        # About as wide as the interval of the normal distribution.
        assert got[g]["ci_high"] - got[g]["ci_low"] == pytest.approx(2 * 1.96 * some["x"].std() / len(some) ** 0.5, rel=0.12)
    assert bootstrap_means(df.limit(0), ["g"], "key", "x").count() == 0
