"""Items that appear together more often than chance allows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweir.operators.durable import stored
from newsweir.operators.skew import hot_keys, skew_join

# A record of more items is cut into blocks of about this many, and its pairs are made by pairs of blocks.
_BLOCK = 128
# Degrees up to _EXACT have a class each in the null, greater ones share one when they are within _NEAR.
_EXACT, _NEAR = 200, 1.005
_BIN = 0.02


def degree_classes(counts: DataFrame, degree: str) -> tuple[np.ndarray, np.ndarray]:
    """(degree, how many have it) of the rows of `counts`, by classes: the mean degree of a class stands for it.

    The rule is the same at every size. Classes grow with the logarithm of the degrees, 200 and some 460 for
    each tenfold, so the driver gets few rows whatever the data.
    """
    d = F.col(degree)
    near = F.floor(F.log(d / float(_EXACT)) / math.log(_NEAR)) + _EXACT + 1
    rows = counts.groupBy(F.when(d <= _EXACT, d).otherwise(near).alias("class")).agg(F.avg(d).alias("degree"), F.count(F.lit(1)).alias("n"))
    got = sorted((r["degree"], r["n"]) for r in rows.collect())
    return np.array([x for x, _ in got], float), np.array([n for _, n in got], float)


def fit_configuration(item_degree, items, record_size, records, steps: int = 300):
    """Fitness x of each item degree and y of each record size: an item is in a record with odds x*y.

    The bipartite configuration model: the expected number of records of an item and of items of a record
    equal those observed. `items` and `records` say how many have each degree and size.
    """
    k, s = np.asarray(item_degree, float), np.asarray(record_size, float)
    m, r = np.asarray(items, float), np.asarray(records, float)
    edges = max((k * m).sum(), 1.0)
    x, y = k / np.sqrt(edges), s / np.sqrt(edges)
    for _ in range(steps):
        before = x
        x = k / np.maximum((r * y / (1 + np.outer(x, y))).sum(1), 1e-300)
        y = s / np.maximum((m * x / (1 + np.outer(y, x))).sum(1), 1e-300)
        if np.max(np.abs(x / before - 1), initial=0) < 1e-9:
            break
    return x, y


def _upper_tail(w: np.ndarray) -> np.ndarray:
    """The normal distribution's upper tail over its density: by erfc, beyond 3 by a continued fraction."""
    near = np.minimum(w, 3.0)
    by_erfc = np.array([math.erfc(x / math.sqrt(2)) / 2 for x in near]) / np.exp(-near * near / 2) * math.sqrt(2 * math.pi)
    far = np.maximum(w, 3.0)
    return np.where(w <= 3, by_erfc, 1 / (far + 1 / (far + 2 / (far + 3 / (far + 4 / (far + 5 / far))))))


def poisson_binomial_tail(n: np.ndarray, q: np.ndarray, times: np.ndarray, exact_to: int = 40) -> np.ndarray:
    """log10 of P(X >= n), X a sum of independent trials: `times` of them succeed with q, by rows of q.

    Where at most `exact_to` successes of a mean no greater are asked for and all odds are below 0.1, the
    probabilities of n and the next 40 numbers of successes are summed, each from its recursion over power
    sums of the odds. Otherwise it is the Lugannani-Rice saddle point, within some hundredths of log10.
    """
    n = np.asarray(n, float)
    out = np.zeros(len(n))
    odds = q / np.maximum(1 - q, 1e-12)
    small = (n <= exact_to) & (q @ times <= np.minimum(n, exact_to)) & (odds.max(1, initial=0) < 0.1) & (n > 0)
    if small.any():
        o, m = odds[small], n[small].astype(int)
        # log P(0), then k P(k) = sum over i of (-1)^(i-1) P(k-i) t_i, with t_i the sum of odds^i.
        first = -np.log1p(o) @ times
        powers, t = o.copy(), []
        for _ in range(8):
            t.append(powers @ times)
            powers = powers * o
        top = int(m.max()) + 40
        p = np.zeros((len(m), top + 1))
        p[:, 0] = 1
        for k in range(1, top + 1):
            p[:, k] = sum((1 if i % 2 else -1) * p[:, k - i] * t[i - 1] for i in range(1, min(k, 8) + 1)) / k
            np.maximum(p[:, k], 0, out=p[:, k])
        reach = np.arange(top + 1)[None, :] >= m[:, None]
        out[small] = np.log(np.maximum((p * reach).sum(1), 1e-300)) + first
    rest = ~small & (n > 0)
    if rest.any():
        o, m = odds[rest], n[rest]
        lo, hi = np.full(rest.sum(), -40.0), np.full(rest.sum(), 60.0)
        for _ in range(60):
            u = (lo + hi) / 2
            z = o * np.exp(u)[:, None]
            low = (z / (1 + z)) @ times < m - 0.5
            lo, hi = np.where(low, u, lo), np.where(low, hi, u)
        u = (lo + hi) / 2
        u = np.where(np.abs(u) < 1e-4, 1e-4, u)
        z = o * np.exp(u)[:, None]
        share = z / (1 + z)
        w2 = np.maximum(2 * (u * (m - 0.5) - (np.log1p(z) - np.log1p(o)) @ times), 1e-12)
        w = np.sign(u) * np.sqrt(w2)
        v = 2 * np.sinh(u / 2) * np.sqrt(np.maximum((share * (1 - share)) @ times, 1e-300))
        density = -w2 / 2 - 0.5 * math.log(2 * math.pi)
        above = density + np.log(np.maximum(_upper_tail(np.abs(w)) + 1 / v - 1 / w, 1e-300))
        below = np.log1p(-np.clip(np.exp(density) * (_upper_tail(np.abs(w)) - 1 / v + 1 / w), 0, 1 - 1e-12))
        out[rest] = np.where(u > 0, above, below)
    return np.minimum(out, 0) / math.log(10)


def pair_counts(members: DataFrame, kept: DataFrame, hot_items: DataFrame, total: int) -> DataFrame:
    """(a, b, n_a, n_b, n): records that hold both items, for pairs of `kept` (item, n_item); a < b.

    `members` is distinct (record, item) with `total` rows. A record's items are put into blocks of about
    128 by hash; a group holds two blocks of one record, so that no task gathers a huge record, and pairs
    are counted in each task before they are shuffled.
    """
    m = skew_join(members, kept, ["item"], hot_items)
    sizes = m.groupBy("record").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > _BLOCK)
    sizes = sizes.select("record", F.ceil(F.col("_size") / _BLOCK).cast("int").alias("_blocks"))
    m = skew_join(m, sizes, ["record"], hot_keys(members, ["record"], total), "left")
    blocks = F.coalesce("_blocks", F.lit(1))
    m = m.withColumn("_block", F.pmod(F.xxhash64("item"), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    m = m.select("record", "item", "n_item", "_block", other.alias("_other")).select(
        "record",
        F.least("_block", "_other").alias("_p"),
        F.greatest("_block", "_other").alias("_q"),
        F.struct("item", "n_item", "_block").alias("_m"),
    )
    groups = m.groupBy("record", "_p", "_q").agg(F.collect_list("_m").alias("_all")).filter(F.size("_all") > 1)

    def with_later(x):
        # Items of one block are paired in the group of that block alone, those of two in the group of both.
        return F.transform(
            F.filter(
                F.col("_all"),
                lambda y: (y["item"] > x["item"]) & ((F.col("_p") == F.col("_q")) | (y["_block"] != x["_block"])),
            ),
            lambda y: F.struct(x["item"].alias("a"), y["item"].alias("b"), x["n_item"].alias("n_a"), y["n_item"].alias("n_b")),
        )

    pairs = groups.select(F.explode(F.transform("_all", with_later)).alias("_x")).select(F.inline("_x"))
    return pairs.groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("n"))


def together(
    records: DataFrame, record: str, item: str, min_count: int = 1, min_lift: float = 0.0, rate: float | None = None
) -> DataFrame:
    """(a, b, n, n_a, n_b, lift, expected, log10_p[, surprising]) of item pairs of the same record; a < b as strings.

    n records hold both; lift is n times the number of records over n_a * n_b. The null is a bipartite
    configuration model fitted to all item frequencies and record sizes; expected is the null's mean
    number of common records and log10_p the logarithm of the chance of n or more (a Poisson-binomial
    tail). With `rate`, surprising says whether the pair is found at that false-discovery rate among all
    observed pairs of at least min_count common records (Benjamini-Hochberg, with p rounded up to a bin of
    0.02 in log10; pairs below min_lift are tested as if their p were 1).

    Pairs with n < min_count or lift < min_lift are left out. Both bounds also prune items exactly: an
    item of a pair with n >= c is in c records, and n <= n_a gives lift <= records/n_b. Repeated items of
    a record count once. Null records and items are left out. Fewer than two items give no pairs.
    """
    one = records.select(F.col(record).alias("record"), F.col(item).alias("item")).dropna().distinct()
    members = stored(one)
    counts = members.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    k, m = degree_classes(counts, "n_item")
    s, r = degree_classes(members.groupBy("record").agg(F.count(F.lit(1)).alias("size")), "size")
    n_records, total = int(r.sum()), members.count()
    most = n_records / min_lift if min_lift > 0 else total
    kept = counts.filter((F.col("n_item") >= min_count) & (F.col("n_item") <= most))
    x, y = fit_configuration(k, m, s, r)

    hot = hot_keys(members, ["item"], total)
    pairs = pair_counts(members, kept, hot, total).filter(F.col("n") >= min_count)
    if rate is not None and min_lift > 0:
        pairs = stored(pairs)
        tested = pairs.count()
    lift = F.col("n") * F.lit(float(n_records)) / (F.col("n_a") * F.col("n_b"))
    pairs = pairs.withColumn("lift", lift).filter(F.col("n") * F.lit(float(n_records)) >= min_lift * F.col("n_a") * F.col("n_b"))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            # The null knows a pair by its counts alone, and most pairs share theirs with others.
            counts, row = np.unique(f[["n", "n_a", "n_b"]].to_numpy(), axis=0, return_inverse=True)
            mean, tail = np.zeros(len(counts)), np.zeros(len(counts))
            for at in range(0, len(counts), 2000):
                c = counts[at : at + 2000]
                one, two = (np.outer(np.interp(c[:, i].astype(float), k, x), y) for i in (1, 2))
                q = one / (1 + one) * (two / (1 + two))
                mean[at : at + 2000], tail[at : at + 2000] = q @ r, poisson_binomial_tail(c[:, 0], q, r)
            row = row.ravel()
            yield f.assign(expected=mean[row], log10_p=tail[row])

    schema = "a string, b string, n_a long, n_b long, n long, lift double, expected double, log10_p double"
    scored = pairs.select("a", "b", "n_a", "n_b", "n", "lift").mapInPandas(score, schema)
    if rate is None:
        return scored
    scored = stored(scored)
    # Bins of -log10 p; those beyond 400 pass at any rate.
    strength = F.floor(F.least(-F.col("log10_p"), F.lit(400.0)) / _BIN)
    bins = sorted(scored.groupBy(strength.alias("bin")).count().collect(), key=lambda b: -b["bin"])
    tested = tested if min_lift > 0 else sum(b["count"] for b in bins)
    seen, cut = 0, float("inf")
    for b in bins:
        seen += b["count"]
        if 10.0 ** (-b["bin"] * _BIN) <= rate * seen / tested:
            cut = b["bin"] * _BIN
    return scored.withColumn("surprising", -F.col("log10_p") >= F.lit(cut))
