"""Ranking quality, list quality and their spread."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweir.operators.beside import beside, coded, may_match, numbers

_DISCOUNTS = [0.0]
for _r in range(1, 11):
    _DISCOUNTS.append(_DISCOUNTS[-1] + 1 / math.log2(_r + 1))


def _discount(n: Column, k: int) -> Column:
    """The sum of the discounts of the first n places, k at most."""
    return F.element_at(F.array(*[F.lit(d) for d in _DISCOUNTS]), (F.least(n, F.lit(k)) + 1).cast("int"))


def ranking_metrics(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, auc, mrr, ndcg5, ndcg10) of each list of (pos, label, score) rows.

    Equal scores share their gains (nDCG) and count half (AUC); for the reciprocal rank of the first hit
    they are ordered by pos. Undefined metrics are null: all without a positive label, AUC also without a
    negative one.
    """
    each = Window.partitionBy(*by)
    tie = Window.partitionBy(*by, "score")
    rows = (
        scored.withColumn("_place", F.row_number().over(each.orderBy(F.desc("score"), "pos")))
        .withColumn("_before", F.rank().over(each.orderBy(F.desc("score"))) - 1)
        .withColumn("_tied", F.count(F.lit(1)).over(tie))
        .withColumn("_good", F.sum("label").over(tie))
        .withColumn("_n", F.count(F.lit(1)).over(each))
    )
    # Places from below, ties sharing the mean place.
    up = F.col("_n") - F.col("_before") - (F.col("_tied") - 1) / 2
    hit = F.col("label") == 1

    def gain(k: int) -> Column:
        share = F.col("_good") / (F.col("_tied") * F.col("_tied"))
        return F.sum(share * (_discount(F.col("_before") + F.col("_tied"), k) - _discount(F.col("_before"), k)))

    sums = rows.groupBy(*by).agg(
        F.sum("label").alias("_p"),
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(hit, up)).alias("_up"),
        F.min(F.when(hit, F.col("_place"))).alias("_first"),
        gain(5).alias("_dcg5"),
        gain(10).alias("_dcg10"),
    )
    p, n = F.col("_p"), F.col("_n")
    return sums.select(
        *by,
        F.when((p > 0) & (p < n), (F.col("_up") - p * (p + 1) / 2) / (p * (n - p))).alias("auc"),
        (1 / F.col("_first")).alias("mrr"),
        F.when(p > 0, F.col("_dcg5") / _discount(p, 5)).alias("ndcg5"),
        F.when(p > 0, F.col("_dcg10") / _discount(p, 10)).alias("ndcg10"),
    )


def recall_at(clicked: DataFrame, retrieved: DataFrame, by: list[str], key: str, ks: list[int]) -> DataFrame:
    """(by, recall_k...): the share of an impression's clicks among the first k articles retrieved for its key.

    `clicked` has by, key and article_id, a row per element of a click list, so a click may count twice.
    Impressions without clicks have no row, those with nothing retrieved have 0.
    """
    some = may_match(retrieved.select(key, "article_id", "rank"), clicked, [key, "article_id"])
    hits = clicked.join(some, [key, "article_id"], "left")
    share = [F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in ks]
    return hits.groupBy(*by).agg(*share)


def diversity(lists: DataFrame, categories: DataFrame, by: str) -> DataFrame:
    """(by, diversity): distinct over known categories of each list; lists without a known one have no row."""

    def work(chunks):
        for rows, (place, found) in chunks:
            if found is None or not found.num_rows:
                continue
            code, keys = coded(rows, by)
            kind, kinds = coded(found, "category")
            some = place >= 0
            pair, n = np.unique(code[some] * len(kinds) + kind[place[some]], return_counts=True)
            key, kind = np.divmod(pair, len(kinds))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(key)), kinds.take(pa.array(kind)), pa.array(n)], [by, "category", "_n"])

    known = categories.filter(F.col("category").isNotNull()).select("article_id", "category")
    counts = beside(lists.select(by, "article_id"), [(known, "article_id")], work, f"`{by}` {lists.schema[by].dataType.simpleString()}, category string, _n long")
    each = counts.groupBy(by, "category").agg(F.sum("_n").alias("_n"))
    return each.groupBy(by).agg((F.count(F.lit(1)) / F.sum("_n")).alias("diversity"))


def novelty(lists: DataFrame, popularity: DataFrame, clicks: int, by: str) -> DataFrame:
    """(by, novelty): the mean of -log2 of the smoothed share of clicks of each list's articles."""

    def work(chunks):
        for rows, (place, found) in chunks:
            code, keys = coded(rows, by)
            worth = -np.log2((numbers(found, "n", 0)[place] + 1) / (clicks + 1.0))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.bincount(code, worth, len(keys))), pa.array(np.bincount(code, minlength=len(keys)))], [by, "_sum", "_n"])

    schema = f"`{by}` {lists.schema[by].dataType.simpleString()}, _sum double, _n long"
    sums = beside(lists.select(by, "article_id"), [(popularity.select("article_id", "n"), "article_id")], work, schema)
    return sums.groupBy(by).agg((F.sum("_sum") / F.sum("_n")).alias("novelty"))


def popularity(clicked: DataFrame) -> DataFrame:
    """(article_id, n): how often each article is clicked, every list element once."""
    return clicked.groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))


# Shares of 2^32 below which a Poisson variable of mean 1 is at most 0, 1, 2, ...
_POISSON = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(8)]
# Odd multipliers that spread the bits of 32-bit numbers.
_STEP, _MIX = 0x9E3779B1, (0x7FEB352D, 0x846CA68B)
_WORD = 62  # replicates in a long
# A draw in Arrow works on some rows times all replicates at once, and holds the sums of some groups.
_CELLS, _GROUPS = 1 << 21, 512
# Articles and labels whose bits a task holds, and rows of bits that it handles at once.
_COVERED, _OUT = 1 << 19, 1 << 16


def seeds(key: Column) -> Column:
    """The first 8 hexadecimal digits of a key's md5, as a number: a row's seed of all its draws."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def poisson_weights(seed: np.ndarray, replicates: int) -> np.ndarray:
    """How often each row is drawn in each replicate: Poisson variables of mean 1 from a mix of seed and replicate."""
    x = seed.astype(np.uint32)[:, None] ^ (np.arange(1, replicates + 1, dtype=np.uint32) * np.uint32(_STEP))[None, :]
    for shift, by in ((16, _MIX[0]), (15, _MIX[1])):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(by)
    x ^= x >> np.uint32(16)
    w = np.zeros(x.shape, np.int8)
    for c in _POISSON:
        w += x >= np.uint32(int(c * 2**32))
    return w


def bootstrap_means(values: DataFrame, by: list[str], key: str, value: str, replicates: int = 1000, alpha: float = 0.05) -> DataFrame:
    """(by, mean, ci_low, ci_high, n): the mean and its bootstrap interval.

    Each row is drawn a Poisson number of times in each replicate, by a hash of its key: the resampling
    for data in many partitions, with neither row numbers nor a shuffle of rows. A partition's rows of a
    group meet all replicates' weights in one matrix product, and a vector of sums a group and partition
    is all that is shuffled. Any number of replicates will do. Null values are left out; a group without
    values has no row, a replicate that draws none of a group's rows no mean.
    """
    v = values.filter(F.col(value).isNotNull()).select(*by, seeds(F.col(key)).alias("_seed"), F.col(value).cast("double").alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, np.ndarray] = {}

        def sums() -> pa.RecordBatch:
            keys = list(zip(*groups)) if groups else [[] for _ in by]
            held = np.stack(list(groups.values())) if groups else np.zeros((0, 2, replicates))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(held[:, i].ravel()), replicates).cast(pa.list_(pa.float64())) for i in (0, 1)]
            groups.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(k, t) for k, t in zip(keys, types)), *lists], [*by, "_w", "_x"])

        types = [pa.string()] * len(by)
        for b in batches:
            types = [b.schema.field(c).type for c in by]
            names = list(zip(*(b[c].to_pylist() for c in by)))
            code = {k: i for i, k in enumerate(dict.fromkeys(names))}
            of = np.fromiter(map(code.__getitem__, names), int, len(names))
            order = np.argsort(of, kind="stable")
            seed, x = b["_seed"].to_numpy()[order], b["_v"].to_numpy()[order]
            ends = np.searchsorted(of[order], np.arange(len(code) + 1))
            some = max(1, _CELLS // replicates)
            for k, lo, hi in zip(code, ends, ends[1:]):
                for at in range(lo, hi, some):
                    w = poisson_weights(seed[at : min(at + some, hi)], replicates).astype(np.float64)
                    got = np.stack([w.sum(0), x[at : min(at + some, hi)] @ w])
                    groups[k] = groups[k] + got if k in groups else got
                if len(groups) >= _GROUPS:
                    yield sums()
        yield sums()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in v.select(*by).schema]
    drawn = v.mapInArrow(run, ", ".join([*fields, "_w array<double>, _x array<double>"]))
    pairs = F.posexplode(F.arrays_zip("_w", "_x")).alias("_b", "_s")
    means = drawn.select(*by, pairs).groupBy(*by, "_b").agg(F.try_divide(F.sum("_s._x"), F.sum("_s._w")).alias("_m"))
    low, high = (F.percentile("_m", F.lit(q)) for q in (alpha / 2, 1 - alpha / 2))
    spread = means.groupBy(*by).agg(low.alias("ci_low"), high.alias("ci_high"))
    whole = v.groupBy(*by).agg(F.avg("_v").alias("mean"), F.count(F.lit(1)).alias("n"))
    return whole.join(spread, by)


def drawn_bits(rows: DataFrame, key: str, replicates: int) -> tuple[DataFrame, list[str]]:
    """`rows` with longs that have a bit for each replicate that draws the row at all, 62 a long, and the longs' names."""
    words = [f"_bits{at}" for at in range(-(-replicates // _WORD))]
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seed = b["_seed"].to_numpy()
            out = np.zeros((len(words), len(seed)), np.int64)
            some = max(1, _CELLS // replicates)
            for at in range(0, len(seed), some):
                on = poisson_weights(seed[at : at + some], replicates) > 0
                for r in range(replicates):
                    out[r // _WORD, at : at + some] |= on[:, r].astype(np.int64) << (r % _WORD)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in columns), *map(pa.array, out)], [*columns, *words])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{w} long" for w in words]
    return rows.withColumn("_seed", seeds(F.col(key))).mapInArrow(run, ", ".join(fields)), words


def _covered(chunks) -> Iterator[pa.RecordBatch]:
    """(_by, article_id, bits...): which replicates draw an impression whose list has the article, in the lists of some chunks."""
    held: dict[str, np.ndarray] = {}
    ids = pa.array([], pa.string())

    def out() -> Iterator[pa.RecordBatch]:
        for key, bits in held.items():
            some = np.flatnonzero(bits[:, 0] >= 0)
            for at in range(0, len(some), _OUT):
                one = some[at : at + _OUT]
                columns = [pa.array([key] * len(one), pa.string()), ids.take(pa.array(one)), *(pa.array(c) for c in bits[one].T)]
                yield pa.RecordBatch.from_arrays(columns, ["_by", "article_id", *(f"_bits{i}" for i in range(bits.shape[1]))])

    for rows, (place, found) in chunks:
        if found is None or not found.num_rows:
            continue
        asked = found["_asked"].combine_chunks()
        size = np.diff(asked.offsets.to_numpy())
        first, flat = np.cumsum(size) - size, asked.flatten()
        label, labels = coded(pa.table({"by": flat.field("by")}), "by")
        words = flat.field("words").flatten().to_numpy().reshape(len(flat), -1)
        article, own = coded(rows, "article_id")
        known = pc.index_in(own, ids).fill_null(-1).to_numpy().copy()
        new = np.flatnonzero(known < 0)
        known[new] = len(ids) + np.arange(len(new))
        ids = pa.concat_arrays([ids, own.take(pa.array(new))])
        article, row = known[article], np.flatnonzero(place >= 0)
        for i, key in enumerate(labels.to_pylist()):
            # A query has an entry for a label once.
            entry = np.full(len(size), -1)
            mine = np.flatnonzero(label == i)
            entry[np.searchsorted(first, mine, "right") - 1] = mine
            of = entry[place[row]]
            some = np.flatnonzero(of >= 0)
            some = some[np.argsort(article[row[some]], kind="stable")]
            bits = held.get(key, np.zeros((0, words.shape[1]), np.int64))
            bits = np.concatenate([bits, np.full((len(ids) - len(bits), words.shape[1]), -1)]) if len(bits) < len(ids) else bits
            for at in range(0, len(some), _OUT):
                part = some[at : at + _OUT]
                which, begin = np.unique(article[row[part]], return_index=True)
                drawn = np.bitwise_or.reduceat(words[of[part]], begin, axis=0)
                old = bits[which]
                bits[which] = np.where(old < 0, drawn, old | drawn)
            held[key] = bits
        if sum(map(len, held.values())) > _COVERED:
            yield from out()
            held.clear()
            ids = ids[:0]
    yield from out()


def coverage_interval(
    impressions: DataFrame, lists: DataFrame, by: str, key: str, query: str, catalog: DataFrame, replicates: int = 1000, alpha: float = 0.05
) -> DataFrame:
    """(by, mean, boot_mean, ci_low, ci_high, n): catalogue coverage and its bootstrap interval.

    `impressions` has by, key and query, `lists` query and article_id, `catalog` by and articles, the
    catalogue's size. Impressions are drawn, not articles. Which replicates draw a query's impressions is
    a bit each in as many longs as they need by a bitwise or; so is which of them cover an article, which
    each task gathers for its lists. Each row is read once for all replicates. The point may lie above the
    interval, as drawing with repeats never adds articles. Only impressions with a list count in n.
    """
    asked, words = drawn_bits(impressions.select(by, key, query), key, replicates)
    either = [F.bit_or(c).alias(c) for c in words]
    asked = asked.groupBy(by, query).agg(*either, F.count_distinct(key).alias("_n"))
    n = asked.join(lists.select(query).distinct(), query, "left_semi").groupBy(by).agg(F.sum("_n").alias("n"))
    each = asked.groupBy(query).agg(F.collect_list(F.struct(F.col(by).alias("by"), F.array(*words).alias("words"))).alias("_asked"))
    parts = beside(lists.select(query, "article_id"), [(each, query)], _covered, f"_by string, article_id string, {', '.join(f'{w} long' for w in words)}")
    covered = parts.groupBy("_by", "article_id").agg(*either).select("_by", *words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        bit = np.arange(replicates) // _WORD * 64 + np.arange(replicates) % _WORD
        for b in batches:
            code, keys = coded(pa.Table.from_batches([b]), "_by")
            held = np.stack([b[w].to_numpy() for w in words], axis=1)
            for i, key in enumerate(keys.to_pylist()):
                own = held[code == i]
                got = sums.setdefault(key, np.zeros(replicates + 1, np.int64))
                got[0] += len(own)
                for at in range(0, len(own), 4096):
                    got[1:] += np.unpackbits(own[at : at + 4096].view(np.uint8), axis=1, bitorder="little")[:, bit].sum(axis=0, dtype=np.int64)
        for key, got in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(got)), pa.array(np.arange(-1, replicates), pa.int32()), pa.array(got)], ["_by", "_b", "_covered"])

    counted = covered.mapInArrow(count, "_by string, _b int, _covered long")
    # A catalogue has a row per value of `by`, a label.
    counts = counted.groupBy(F.col("_by").alias(by), "_b").agg(F.sum("_covered").alias("_covered")).join(F.broadcast(catalog), by)
    share = F.when(F.col("articles") > 0, F.col("_covered") / F.col("articles")).otherwise(0.0)
    boot = F.when(F.col("_b") >= 0, F.col("_share"))
    return (
        counts.withColumn("_share", share)
        .groupBy(by)
        .agg(
            F.max(F.when(F.col("_b") < 0, F.col("_share"))).alias("mean"),
            F.avg(boot).alias("boot_mean"),
            F.percentile(boot, F.lit(alpha / 2)).alias("ci_low"),
            F.percentile(boot, F.lit(1 - alpha / 2)).alias("ci_high"),
        )
        .join(n, by)
    )


def bootstrap_ci(values, n_boot: int = 1000, alpha: float = 0.05, seed: int = 42) -> dict:
    """The mean of local values and its interval by resampling with NumPy's generator; NaN if there are none."""
    x = np.asarray(values, float)
    if not len(x):
        return {"mean": math.nan, "ci_low": math.nan, "ci_high": math.nan, "n": 0}
    draw = np.random.default_rng(seed)
    means = [draw.choice(x, len(x)).mean() for _ in range(n_boot)]
    low, high = np.percentile(means, [100 * alpha / 2, 100 - 100 * alpha / 2])
    return {"mean": float(x.mean()), "ci_low": float(low), "ci_high": float(high), "n": len(x)}


def cold_threshold(history: DataFrame, by: str, length: str, percent: float = 25.0) -> DataFrame:
    """(by, threshold): the percentile of history lengths, interpolated; below it a user is cold."""
    return history.groupBy(by).agg(F.coalesce(F.percentile(length, F.lit(percent / 100)), F.lit(0.0)).alias("threshold"))


def cold_or_warm(length: Column, threshold: Column) -> Column:
    return F.when(F.coalesce(length, F.lit(0)) < threshold, "cold").otherwise("warm")
