"""Most similar vectors for every vector, by learned partitions."""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweir.operators.blocks import blocked_top
from newsweir.operators.durable import discard, stored
from newsweir.operators.skew import hot_keys, lookup, skew_join

# Rows the partitions and a classifier are learned from, and how many vectors a partition should hold.
SAMPLE = 8192
# Vectors held out from the sample, whose true neighbours set the probes of a search for the nearest.
HELD = 1024
PARTITION = 1000
_NEIGHBOURS = 10
# A partition is searched in blocks of at most about this many vectors; its queries are spread in shares.
_BLOCK, _SHARE = 4096, 32768
# Items of a class in one list when pairs are written out.
_LIST = 256
# Rows of a partition that a task of linked_vectors holds, and how many, in partitions, it compares without learning any.
_GATHER, _FEW = 1 << 20, 96
# Copies of each vector that linked_vectors shuffles at a time.
_COPIES = 8
# More than single precision loses of a product of unit vectors.
_SINGLE = 1e-5


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of each unit vector among the others, by blocks."""
    out = np.zeros((len(x), k), int)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -2
        out[a : a + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _bisect(edges: np.ndarray, size: int, left: int, rng: np.random.Generator) -> np.ndarray:
    """True for `left` of `size` nodes, so that few edges run between the sides."""
    a, b = edges
    degree = np.maximum(np.bincount(a, minlength=size), 1)
    v = rng.standard_normal(size)
    for _ in range(40):
        # A lazy random walk, away from the constant vector: its slowest mode splits the graph.
        v = 0.5 * v + 0.5 * np.bincount(a, v[b], size) / degree
        v -= (v * degree).sum() / degree.sum()
        v /= np.linalg.norm(v) + 1e-30
    side = np.zeros(size, bool)
    side[np.argsort(v, kind="stable")[:left]] = True
    for _ in range(8):
        # Exchange the pairs that gain most, half of them at a time as their gains depend on each other.
        gain = np.bincount(a, np.where(side[a] != side[b], 1.0, -1.0), size)
        mine, other = np.flatnonzero(side), np.flatnonzero(~side)
        mine, other = mine[np.argsort(-gain[mine], kind="stable")], other[np.argsort(-gain[other], kind="stable")]
        n = min(len(mine), len(other))
        better = int((gain[mine[:n]] + gain[other[:n]] > 0).sum() + 1) // 2
        if not better or gain[mine[0]] + gain[other[0]] <= 0:
            break
        side[mine[:better]], side[other[:better]] = False, True
    return side


def balanced_partition(graph: np.ndarray, parts: int, seed: int = 2) -> np.ndarray:
    """A part of each node, all of nearly equal size, by bisecting the neighbour graph again and again."""
    n, k = graph.shape
    a = np.concatenate([np.repeat(np.arange(n), k), graph.ravel()])
    b = np.concatenate([graph.ravel(), np.repeat(np.arange(n), k)])
    part, rng = np.zeros(n, int), np.random.default_rng(seed)

    def split(nodes: np.ndarray, edges: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            part[nodes] = first
            return
        some = count // 2
        side = _bisect(edges, len(nodes), round(len(nodes) * some / count), rng)
        for own, at, many in ((side, first, some), (~side, first + some, count - some)):
            number = np.cumsum(own) - 1
            inside = own[edges[0]] & own[edges[1]]
            split(nodes[own], number[edges[:, inside]], at, many)

    split(np.arange(n), np.stack([a, b]), 0, parts)
    return part


class Router:
    """A network of one hidden layer from a unit vector to the probabilities of partitions."""

    def __init__(self, dims: int, parts: int, hidden: int = 128, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.weights = [
            (rng.standard_normal((dims, hidden)) * np.sqrt(2 / dims)).astype(np.float32),
            np.zeros(hidden, np.float32),
            (rng.standard_normal((hidden, parts)) / np.sqrt(hidden)).astype(np.float32),
            np.zeros(parts, np.float32),
        ]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        scale = np.float32(np.sqrt(x.shape[1]))
        return np.maximum(x * scale @ w1 + b1, 0) @ w2 + b2

    def train(self, x: np.ndarray, target: np.ndarray, steps: int = 1200, batch: int = 256, rate: float = 3e-3, seed: int = 2) -> None:
        """Cross entropy against `target`, rows of probabilities, by Adam."""
        rng = np.random.default_rng(seed)
        x = (x * np.sqrt(x.shape[1])).astype(np.float32)
        first, second = [[np.zeros_like(w) for w in self.weights] for _ in range(2)]
        for t in range(1, steps + 1):
            i = rng.integers(0, len(x), batch)
            w1, b1, w2, b2 = self.weights
            z = x[i] @ w1 + b1
            h = np.maximum(z, 0)
            p = h @ w2 + b2
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - target[i]) / batch
            dh = (d @ w2.T) * (z > 0)
            grads = [x[i].T @ dh, dh.sum(0), h.T @ d, d.sum(0)]
            step = rate * 0.5 * (1 + np.cos(np.pi * t / steps))
            for w, g, m, v in zip(self.weights, grads, first, second):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def route(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The `probes` most probable partitions, most probable first."""
        p = self.logits(x.astype(np.float32))
        if probes >= p.shape[1]:
            return np.argsort(-p, axis=1, kind="stable")
        some = np.argpartition(-p, probes - 1, axis=1)[:, :probes]
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(p, some, 1), axis=1, kind="stable"), 1)


def learn_router(x: np.ndarray, parts: int) -> Router:
    """A router learned from unit vectors: a balanced partition of their neighbour graph, then a classifier.

    A vector's target is half its own partition and half its neighbours' partitions.
    """
    graph = neighbour_graph(x, min(_NEIGHBOURS, len(x) - 1))
    part = balanced_partition(graph, parts)
    target = np.zeros((len(x), parts), np.float32)
    target[np.arange(len(x)), part] = 0.5
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 0.5 / graph.shape[1])
    router = Router(x.shape[1], parts)
    router.train(x, target)
    return router


def copies_for_cosine(router: Router, x: np.ndarray, least: float, cover: float = 0.9995, seed: int = 2) -> int:
    """In how many partitions to keep each vector so that `cover` of those at that cosine meet in one.

    They are apart in random directions or, if more copies are needed then, in those of differences of x's rows.
    """
    rng = np.random.default_rng(seed)
    parts, order = router.weights[3].shape[0], rng.permutation(len(x))
    place, copies = np.argsort(router.route(x, parts), axis=1), 1
    for away in (rng.standard_normal(x.shape), x[order] - x[np.roll(order, 1)]):
        away = unit(away - (away * x).sum(1, keepdims=True) * x + 1e-12)
        other = np.argsort(router.route(least * x + np.sqrt(1 - least * least) * away, parts), axis=1)
        copies = max(copies, int(np.quantile(np.maximum(place, other).min(1), cover)) + 1)
    return copies


def true_nearest(vectors: DataFrame, ids: list[str], x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, vector): the k nearest among all of `vectors` (id, vector) of each row of x, itself left out.

    Each task compares its vectors with all of x and hands on the k best of each row it has seen.
    """
    dims = x.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {i: n for n, i in enumerate(ids)}
        best, near = np.full((len(x), k), -np.inf), np.zeros((len(x), k, dims))
        for b in batches:
            if not b.num_rows:
                continue
            y = unit(b["vector"].flatten().to_numpy().reshape(-1, dims).astype(np.float64))
            own = [(number[i], j) for j, i in enumerate(b["id"].to_pylist()) if i in number]
            cosine = x @ y.T
            for n, j in own:
                cosine[n, j] = -np.inf
            some = min(k, len(y))
            at = np.argpartition(-cosine, some - 1, axis=1)[:, :some]
            score = np.concatenate([best, np.take_along_axis(cosine, at, 1)], 1)
            keep = np.argpartition(-score, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(score, keep, 1)
            near = np.take_along_axis(np.concatenate([near, y[at]], 1), keep[:, :, None], 1)
        row, col = np.nonzero(best > -np.inf)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(near[row, col].ravel()), dims).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), flat, pa.array(best[row, col])], ["row", "vector", "cosine"])

    found = vectors.select("id", "vector").mapInArrow(scan, "row int, vector array<double>, cosine double")
    top = found.withColumn("_n", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("cosine")))).filter(F.col("_n") <= k)
    got = top.select("row", "vector").toArrow().combine_chunks()
    return got["row"].to_numpy(), got["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dims)


def probes_for_neighbours(router: Router, x: np.ndarray, row: np.ndarray, near: np.ndarray, recall: float) -> int:
    """How many partitions to search so that the neighbours `near` of x's rows `row` are found with that recall."""
    place = np.argsort(router.route(x, router.weights[3].shape[0]), axis=1)
    return int(np.quantile(place[row, router.route(near, 1)[:, 0]], recall)) + 1


def probes_for_recall(router: Router, x: np.ndarray, k: int, recall: float) -> int:
    """How many partitions to search so that the sample's k nearest are found with that recall."""
    graph = neighbour_graph(x, min(k, len(x) - 1))
    return probes_for_neighbours(router, x, np.repeat(np.arange(len(x)), graph.shape[1]), x[graph.ravel()], recall)


def vector_classes(df: DataFrame, item: str, vector: str, dims: int) -> DataFrame:
    """(item, class, vector): usable vectors, one row per item, stored; items of equal vectors share a class.

    Usable are vectors of `dims` numbers, all finite and not all zero. Of an item's several vectors the
    greatest in order counts. The class is the least item id that has the vector; a vector that many items
    share gathers in no task. Vectors are equal if two hashes of 64 bits are: they are shuffled twice in
    all, and hashes in their place otherwise.
    """
    finite = ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = df.filter(F.col(item).isNotNull() & (F.size(vector) == dims) & finite & F.exists(vector, lambda v: v != 0))
    one = usable.select(F.col(item).alias("item"), F.col(vector).alias("vector")).groupBy("item").agg(F.max("vector").alias("vector"))
    same = ["_h", "_g"]
    one = stored(one.withColumns({"_h": F.xxhash64("vector"), "_g": F.xxhash64(F.lit(7), "vector")}), tidy=True)
    classes = one.groupBy(*same).agg(F.min("item").alias("class"))
    out = stored(skew_join(one, classes, same, hot_keys(one, same, one.count())).select("item", "class", "vector"), tidy=True)
    discard(one)
    return out


def _packed(router: Router, probes: int) -> bytes:
    return pickle.dumps((router.weights, probes))


def _unpacked(data: bytes) -> tuple[Router, int]:
    router = Router.__new__(Router)
    router.weights, probes = pickle.loads(data)
    return router, probes


_CHILDREN = 1 << 12  # more than a router has partitions
_ROUTED = "id string, vector array<float>, floor double, part int, rank int"


def _sampled(vectors: DataFrame, dims: int, size: int) -> tuple[list[str], np.ndarray]:
    """(ids, rows): the `size` vectors of the least hashes. Their order takes a bounded number of rows from each task."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(size).select("id", "vector").toArrow()
    return rows["id"].to_pylist(), rows["vector"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dims)


class Index:
    """Learned partitions over the distinct vectors of a table of vector_classes, in one level or two.

    The partitions and the router are fitted on at most `sample` vectors, those of the least hashes; every
    vector is indexed. There is a partition for each `partition` vectors, up to one per 16 of the sample.
    Where that leaves more than twice as many vectors in a partition, each gets partitions and a router of
    its own, fitted where it lies on as large a sample of it: (sample / 16)^2 partitions in all.

    `k` and `recall` set the probes by the nearest neighbours: by those among all vectors of up to HELD
    vectors that the router was not trained on, and by the sample's.
    """

    def __init__(self, classes: DataFrame, dims: int, k: int, recall: float = 0.97, sample: int | None = None, partition: int | None = None):
        sample, partition = sample or SAMPLE, partition or PARTITION
        self.vectors = classes.filter(F.col("item") == F.col("class")).select(F.col("class").alias("id"), "vector")
        count = self.vectors.count()
        held = min(HELD, count // 9)
        ids, x = _sampled(self.vectors, dims, sample + held)
        ids, apart, x = ids[len(x) - held :], x[len(x) - held :], x[: len(x) - held]
        self.dims, parts = dims, max(1, min(-(-count // partition), len(x) // 16))
        two = parts > 1 and count > 2 * partition * parts
        # What two levels may miss, half each.
        recall = 1 - (1 - recall) / 2 if two else recall
        self.router, self.probes, self.below = None, 1, None
        if parts > 1:
            x = unit(x)
            self.router = learn_router(x, parts)
            apart = unit(apart)
            unseen = probes_for_neighbours(self.router, apart, *true_nearest(self.vectors, ids, apart, k), recall)
            self.probes = max(unseen, probes_for_recall(self.router, x, k, recall))
        homes = self._routed(self.vectors.withColumn("floor", F.lit(-2.0)), 1)
        if two:
            homes = stored(homes)
            # At most sample / 16 partitions: their sizes go to the driver.
            self.sizes = {r["part"]: r["n"] for r in homes.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
            self.below = stored(self._fit_below(homes, k, recall, sample, partition))
            homes = self._routed_below(homes, True)
        #: Each vector with its partition.
        self.homes = stored(homes.drop("rank"))

    def _fit_below(self, homes: DataFrame, k: int, recall: float, sample: int, partition: int) -> DataFrame:
        """(part, router): a router of its own for each partition, fitted on about `sample` of its vectors."""
        spark = self.vectors.sparkSession
        shares = F.broadcast(spark.createDataFrame([(p, n, min(1.0, sample / n)) for p, n in self.sizes.items()], "part int, n long, share double"))
        some = homes.join(shares, "part").filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < F.col("share") * (1 << 20))

        def fit(f: pd.DataFrame) -> pd.DataFrame:
            x = unit(np.stack(f["vector"].to_numpy()).astype(np.float64))
            parts = max(1, min(-(-int(f["n"].iloc[0]) // partition), len(x) // 16))
            if parts == 1:
                data = None
            else:
                router = learn_router(x, parts)
                data = _packed(router, probes_for_recall(router, x, k, recall))
            return pd.DataFrame({"part": f["part"].iloc[:1], "router": [data]})

        return some.select("part", "n", "vector").groupBy("part").applyInPandas(fit, "part int, router binary")

    def _routed(self, vectors: DataFrame, last: int) -> DataFrame:
        """(id, vector, floor, part, rank): each of `vectors` with its `last` most probable partitions."""
        router = self.router

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = b["vector"].flatten().to_numpy().reshape(b.num_rows, -1)
                at = router.route(unit(x.astype(np.float64)), last)[:, :last] if router else np.zeros((b.num_rows, 1), int)
                row = pa.array(np.repeat(np.arange(b.num_rows), at.shape[1]))
                rank = np.tile(np.arange(at.shape[1], dtype=np.int32), b.num_rows)
                cols = [b[c].take(row) for c in ("id", "vector", "floor")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(at.ravel().astype(np.int32)), pa.array(rank)], ["id", "vector", "floor", "part", "rank"])

        return vectors.select("id", "vector", "floor").mapInArrow(route, _ROUTED)

    def _routed_below(self, rows: DataFrame, home: bool) -> DataFrame:
        """The routed rows with partitions of the second level, the most probable one or all that are to be searched.

        The rows of a partition go to several tasks, each behind a copy of the partition's router.
        """
        spark, dims = self.vectors.sparkSession, self.dims
        salts = F.broadcast(spark.createDataFrame([(p, -(-n // 100_000)) for p, n in self.sizes.items()], "part int, salts int"))
        cols = ["part", "salt", "router", "id", "vector", "floor", "rank"]
        a = self.below.join(salts, "part").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        a = a.select("part", "salt", "router", *[F.lit(None).cast(t).alias(c) for c, t in (("id", "string"), ("vector", "array<float>"), ("floor", "double"), ("rank", "int"))])
        b = rows.join(salts, "part").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).withColumn("router", F.lit(None).cast("binary"))
        both = a.unionByName(b.select(*cols)).repartition("part", "salt").sortWithinPartitions("part", "salt", F.col("id").isNotNull())

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            router, probes = None, 1
            for b in batches:
                if not b.num_rows:
                    continue
                lead = b["id"].is_null().to_numpy(zero_copy_only=False)
                cut = np.flatnonzero(np.r_[True, lead[1:] | lead[:-1]])
                for lo, hi in zip(cut, np.r_[cut[1:], b.num_rows]):
                    c = b.slice(lo, hi - lo)
                    if lead[lo]:
                        data = c["router"][0].as_py()
                        router, probes = _unpacked(data) if data else (None, 1)
                        continue
                    x = unit(c["vector"].flatten().to_numpy().reshape(-1, dims).astype(np.float64))
                    at = router.route(x, 1 if home else probes) if router else np.zeros((len(x), 1), int)
                    at = at[:, : 1 if home else probes]
                    row = pa.array(np.repeat(np.arange(len(x)), at.shape[1]))
                    part = (c["part"].to_numpy()[:, None] * _CHILDREN + at).ravel().astype(np.int32)
                    # Of all partitions only the most probable one of the most probable one has rank 0.
                    rank = (c["rank"].to_numpy()[:, None] * _CHILDREN + np.arange(at.shape[1])).ravel().astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*(c[n].take(row) for n in ("id", "vector", "floor")), pa.array(part), pa.array(rank)], ["id", "vector", "floor", "part", "rank"])

        return both.mapInArrow(route, _ROUTED)

    def _asking(self, vectors: DataFrame) -> DataFrame:
        """(id, vector, floor, part): each of `vectors` with the partitions to search other than its own."""
        rows = self._routed(vectors, self.probes)
        rows = self._routed_below(rows, False) if self.below is not None else rows
        return rows.filter(F.col("rank") > 0).drop("rank")

    def _scan(self, asking: DataFrame, k: int) -> DataFrame:
        """(id, other, cosine): for each of `asking` (id, vector, floor, part) the vectors stored in that
        partition with a cosine of at least floor; only the k best of a block where there are more.

        Stored vectors of a partition are cut into blocks and its queries into shares; each task holds one
        block and streams a share of queries past it, whatever the partition's size.
        """
        homes = self.homes
        # At most (sample / 16)^2 partitions, an integer or two each. As parts are balanced, so are the asking.
        sizes = {r["part"]: r["n"] for r in homes.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
        cuts = [(p, -(-n // _BLOCK), -(-n * self.probes // _SHARE)) for p, n in sizes.items()]
        spark = self.vectors.sparkSession
        cuts = F.broadcast(spark.createDataFrame(cuts, "part int, blocks int, shares int"))
        number = F.xxhash64("id")
        s = homes.join(cuts, "part").withColumn("block", F.pmod(number, F.col("blocks")).cast("int"))
        s = s.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("ask", F.lit(False))
        a = asking.join(cuts, "part").withColumn("share", F.pmod(number, F.col("shares")).cast("int"))
        a = a.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("ask", F.lit(True))
        cols = ["part", "block", "share", "ask", "id", "vector", "floor"]
        tasks = s.select(*cols).unionByName(a.select(*cols)).repartition("part", "block", "share")
        dims = self.dims

        def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, ids, x = None, [], []
            base_ids, base = None, None
            for b in batches:
                if not b.num_rows:
                    continue
                keys = np.stack([b[c].to_numpy() for c in ("part", "block", "share")], 1)
                ask = b["ask"].to_numpy(zero_copy_only=False)
                floor = b["floor"].to_numpy()
                v = unit(b["vector"].flatten().to_numpy().reshape(-1, dims).astype(np.float64))
                whole = np.column_stack([keys, ask])
                cut = np.flatnonzero(np.r_[True, (whole[1:] != whole[:-1]).any(1)])
                for lo, hi in zip(cut, np.r_[cut[1:], len(v)]):
                    if group != tuple(keys[lo]):
                        group, ids, x, base = tuple(keys[lo]), [], [], None
                    if not ask[lo]:
                        ids.append(b["id"].slice(lo, hi - lo))
                        x.append(v[lo:hi])
                        continue
                    if base is None:
                        if not x:
                            continue
                        base_ids, base = pa.concat_arrays(ids), np.concatenate(x)
                        single = base.astype(np.float32)
                    for at in range(lo, hi, 1024):
                        q = v[at : min(at + 1024, hi)]
                        least = floor[at : at + len(q)]
                        rough = q.astype(np.float32) @ single.T
                        if least.max() <= -2:
                            # Some more than k by the rough product, for the vector itself and near ties.
                            n = min(k + 4, rough.shape[1])
                            j = np.argpartition(-rough, n - 1, axis=1)[:, :n].ravel()
                            i = np.repeat(np.arange(len(q)), n)
                        else:
                            i, j = np.nonzero(rough >= (least - 1e-4).astype(np.float32)[:, None])
                        cosine = np.einsum("ij,ij->i", q[i], base[j])
                        one, other = b["id"].take(pa.array(at + i)), base_ids.take(pa.array(j))
                        keep = pa.compute.and_(pa.compute.not_equal(one, other), pa.array(cosine >= least[i]))
                        yield pa.RecordBatch.from_arrays([one, other, pa.array(cosine)], ["id", "other", "cosine"]).filter(keep)

        return tasks.sortWithinPartitions("part", "block", "share", "ask").mapInArrow(rerank, "id string, other string, cosine double")

    def nearest(self, k: int) -> DataFrame:
        """(id, other, cosine, rank): the k nearest of each distinct vector that its probes find.

        The home partition is searched first. Its k-th cosine is a floor for the other probes, so that they
        return little more than what will be kept.
        """
        found = stored(self._scan(self.homes, k))
        best = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
        if self.probes > 1 or self.below is not None:
            top = found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).drop("_n")
            floor = F.when(F.count(F.lit(1)) >= k, F.min("cosine")).otherwise(F.lit(-1.5))
            asking = self.vectors.join(top.groupBy("id").agg(floor.alias("floor")), "id", "left").fillna(-1.5, ["floor"])
            found = top.unionByName(self._scan(self._asking(asking), k))
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def coded(x: np.ndarray) -> np.ndarray:
    """A row of bytes for each unit vector: its numbers as a byte each, their scale, and how far that is from the vector."""
    scale = (np.abs(x).max(1, keepdims=True) / 127).astype("<f4")
    q = np.rint(x / scale).astype(np.int8)
    off = (np.linalg.norm(x - q * scale.astype(np.float64), axis=1, keepdims=True) + 1e-6).astype("<f4")
    return np.concatenate([np.ascontiguousarray(v).view(np.uint8).reshape(len(x), -1) for v in (q, scale, off)], 1)


def decoded(code: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, distances from the true ones) of the first bytes of rows of `coded`."""
    scale, off = np.ascontiguousarray(code[:, dims : dims + 8]).view("<f4").reshape(-1, 2).T
    return code[:, :dims].view(np.int8) * scale[:, None].astype(np.float32), off


def _first_shared(one: np.ndarray, other: np.ndarray, number: int) -> np.ndarray:
    """Whether `number` is the least that rows of `one` and `other` share."""
    out = np.empty(len(one), bool)
    for a in range(0, len(one), 1 << 16):
        x, y = one[a : a + (1 << 16)], other[a : a + (1 << 16)]
        shared = (x[:, :, None] == y[:, None, :]).any(2)
        out[a : a + len(x)] = np.where(shared, x, np.iinfo(x.dtype).max).min(1) == number
    return out


def _places(x: np.ndarray, least: float, sample: int, partition: int) -> np.ndarray:
    """The partitions of each row of x, learned from some of them; one for all if they are few."""
    if len(x) <= _FEW * partition:
        return np.zeros((len(x), 1), np.int16)
    parts = max(2, min(-(-len(x) // partition), sample // 16))
    some = unit(x[np.random.default_rng(2).permutation(len(x))[: min(sample, 32 * parts)]].astype(np.float64))
    router = learn_router(some, parts)
    copies = copies_for_cosine(router, some, least)
    return np.concatenate([router.route(x[a : a + 8192], copies)[:, :copies].astype(np.int16) for a in range(0, len(x), 8192)])


def _close(x: np.ndarray, off: np.ndarray, side: np.ndarray | None, least: float, sample: int, partition: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, sure): the rows of coded vectors that may have a cosine of at least `least`, each pair once.

    Of two codes the product differs from the cosine by at most the sum of their distances and the
    distances' product, so no pair within a partition is missed, and most are sure. With `side` only
    pairs of a row of side 0 and one of side 1 are made.
    """
    places = _places(x, least, sample, partition)
    order = np.argsort(places.ravel(), kind="stable")
    cut = np.searchsorted(places.ravel()[order], np.arange(int(places.max()) + 2))
    for part, (lo, hi) in enumerate(zip(cut, cut[1:])):
        rows = np.sort(order[lo:hi] // places.shape[1])
        mine, others = (rows, rows) if side is None else (rows[side[rows] == 0], rows[side[rows] == 1])
        if not len(mine) or not len(others):
            continue
        most = float(off[rows].max())
        bar = np.float32(least - 2 * most - most * most - _SINGLE)
        for a in range(0, len(mine), 512):
            q = mine[a : a + 512]
            for b in range(a if side is None else 0, len(others), 2048):
                base = others[b : b + 2048]
                rough = (x[q] @ x[base].T).ravel()
                # Far faster than nonzero in two dimensions.
                hit = np.flatnonzero(rough >= bar)
                i, j = divmod(hit, len(base))
                value, i, j = rough[hit].astype(np.float64), q[i], base[j]
                slack = off[i] + off[j] + off[i] * off[j] + _SINGLE
                keep = (value >= least - slack) & ((i < j) | (side is not None))
                if places.shape[1] > 1 and keep.any():
                    keep[keep] = _first_shared(places[i[keep]], places[j[keep]], part)
                if keep.any():
                    yield i[keep], j[keep], (value >= least + slack)[keep]


def _bytes(rows: pa.Array) -> np.ndarray:
    """A binary column of values of one length as rows of bytes."""
    ends = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1]
    return np.frombuffer(rows.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(rows), -1)


def linked_vectors(vectors: DataFrame, dims: int, least: float, sample: int | None = None, partition: int | None = None) -> DataFrame:
    """(a, b): distinct vectors (id, vector) with a cosine of at least `least`, a < b, missing few; stored.

    Partitions are learned from a sample as in Index. Each vector is put into its several most probable
    partitions, as many as let two at that cosine meet in one, and all in a partition are compared: that
    takes far fewer copies than to keep a vector in one and to ask in all that are likely. A copy is a byte
    a number; pairs that these leave open are tested on the vectors. A task holds one partition, or a pair
    of blocks of one with over _GATHER rows by the sample, and learns partitions of its own where it has
    many rows. Shuffle files are deleted after each turn. A pair is handed on only by the least partition that both share.
    """
    sample, partition = sample or SAMPLE, partition or PARTITION
    count = vectors.count()
    x = _sampled(vectors, dims, sample)[1]
    parts = max(1, min(-(-count // partition), len(x) // 16))
    router, copies, rows = None, 1, np.array([count])
    if parts > 1:
        x = unit(x)
        router = learn_router(x, parts)
        copies = copies_for_cosine(router, x, least)
        rows = np.bincount(router.route(x, copies)[:, :copies].ravel(), minlength=parts) / len(x) * count
    blocks = np.maximum(1, np.ceil(rows / _GATHER)).astype(int)

    # Copies of a vector, those for pairs of blocks counted: partitions take turns, so that some _COPIES are shuffled at a time.
    turns = -(-int((blocks * rows).sum() / max(count, 1)) // _COPIES) or 1

    def place(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = unit(b["vector"].flatten().to_numpy().reshape(-1, dims).astype(np.float64))
            at = router.route(v, copies)[:, :copies] if router else np.zeros((len(v), 1), int)
            code = np.concatenate([coded(v), np.ascontiguousarray(at.astype("<i2")).view(np.uint8).reshape(len(v), -1)], 1)
            many = blocks[at]
            own = b["number"].to_numpy()[:, None] % many
            for other in range(int(many.max())):
                row, col = np.nonzero((many > other) & (at % turns == turn))
                mine = own[row, col]
                whole = np.concatenate([code[row], (mine > other).astype(np.uint8)[:, None]], 1)
                ends = np.arange(0, whole.size + 1, whole.shape[1], dtype=np.int32)
                codes = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(whole)])
                group = (at[row, col].astype(np.int64) << 40) + (np.minimum(mine, other) << 20) + np.maximum(mine, other)
                yield pa.RecordBatch.from_arrays([pa.array(group), b["id"].take(pa.array(row)), codes], ["group", "id", "code"])

    def pairs(group: int, ids: list[pa.Array], codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids, code = pa.concat_arrays(ids), np.concatenate(codes)
        v, off = decoded(code, dims)
        at = np.ascontiguousarray(code[:, dims + 8 : -1]).view("<i2").reshape(len(code), -1)
        side = code[:, -1] if group >> 20 & 0xFFFFF != group & 0xFFFFF else None
        for i, j, sure in _close(v, off, side, least, sample, partition):
            keep = _first_shared(at[i], at[j], group >> 40)
            found = [ids.take(pa.array(i[keep])), ids.take(pa.array(j[keep])), pa.array(sure[keep])]
            yield pa.RecordBatch.from_arrays(found, ["id", "other", "sure"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, codes = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            key = b["group"].to_numpy()
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for lo, hi in zip(cut, np.r_[cut[1:], len(key)]):
                if key[lo] != group:
                    if ids:
                        yield from pairs(group, ids, codes)
                    group, ids, codes = int(key[lo]), [], []
                ids.append(b["id"].slice(lo, hi - lo))
                codes.append(_bytes(b["code"].slice(lo, hi - lo)).copy())
        if ids:
            yield from pairs(group, ids, codes)

    numbered, parted = vectors.select("id", "vector", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 40)).alias("number")), []
    for turn in range(turns):
        placed = numbered.mapInArrow(functools.partial(place, turn=turn), "group long, id string, code binary")
        found = placed.repartition("group").sortWithinPartitions("group").mapInArrow(meet, "id string, other string, sure boolean")
        parted.append(stored(found.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "sure"), tidy=True))
    met = functools.reduce(DataFrame.unionByName, parted)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (unit(b[c].flatten().to_numpy().reshape(-1, dims).astype(np.float64)) for c in ("x", "y"))
                yield b.select(["a", "b"]).filter(pa.array(np.einsum("ij,ij->i", x, y) >= least))

    near = met.filter(~F.col("sure")).select("a", "b")
    for end, name in (("a", "x"), ("b", "y")):
        near = near.join(vectors.select(F.col("id").alias(end), F.col("vector").alias(name)), end)
    links = stored(met.filter("sure").select("a", "b").unionByName(near.select("a", "b", "x", "y").mapInArrow(test, "a string, b string")), tidy=True)
    discard(met)
    return links


def similar_classes(df: DataFrame, item: str, vector: str, dims: int, least: float, **more) -> tuple[DataFrame, DataFrame]:
    """(links, members): (a, b) of linked classes, a < b, and (item, class, vector) of every item with a usable vector.

    Items of equal vectors are one class, named by its least item; classes are linked at a cosine of at
    least `least`, missing few. Copies are never compared with each other. Items without a usable vector
    have no rows, see vector_classes. `more` goes to linked_vectors.
    """
    members = vector_classes(df, item, vector, dims)
    distinct = members.filter(F.col("item") == F.col("class")).select(F.col("class").alias("id"), "vector")
    return linked_vectors(distinct, dims, least, **more), members


def class_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """(item, class, links): each item with its class and the number of classes linked to that."""
    ends = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    hot = hot_keys(members, ["class"], members.count())
    return skew_join(members.select("item", "class"), ends, ["class"], hot, "left").fillna(0, ["links"])


def expanded_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): all pairs of items of linked classes and of one class, a < b as strings.

    Only classes of several items are joined; their items lie in lists of some 256, so that neither a large
    class nor one with many links gathers in a task.
    """
    several = members.groupBy("class").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    crowd = skew_join(members.select("item", "class"), several, ["class"], hot_keys(members, ["class"], members.count()))
    crowd = crowd.withColumn("lists", F.ceil(F.col("n") / _LIST).cast("int")).withColumn("list", F.pmod(F.xxhash64("item"), F.col("lists")).cast("int"))
    crowd = stored(crowd.groupBy("class", "lists", "list").agg(F.collect_list("item").alias("items")))
    sizes = stored(crowd.select("class", "lists").distinct())
    rows = links.select("a", "b", F.lit(False).alias("_own"))
    rows = rows.unionByName(sizes.select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(True).alias("_own")))
    for c in "ab":
        rows = lookup(rows, sizes.withColumnRenamed("class", c), [c], "left")
        rows = rows.withColumn("list", F.explode(F.sequence(F.lit(0), F.coalesce("lists", F.lit(1)) - 1))).drop("lists")
        rows = lookup(rows, crowd.select(F.col("class").alias(c), "list", F.col("items").alias(f"{c}_items")), [c, "list"], "left").drop("list")
    rows = rows.withColumn("a", F.explode(F.coalesce("a_items", F.array("a")))).withColumn("b", F.explode(F.coalesce("b_items", F.array("b"))))
    own = F.col("_own")
    # A class meets itself in both orders, two classes meet once.
    return rows.filter(~own | (F.col("a") < F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar_pairs(df: DataFrame, item: str, vector: str, dims: int, least: float, **more) -> DataFrame:
    """(a, b): items with a cosine of at least `least`, a < b as strings, missing few of them.

    Searched over distinct vectors, see similar_classes, then handed on to all items that share them.
    """
    return expanded_pairs(*similar_classes(df, item, vector, dims, least, **more))


def nearest(df: DataFrame, item: str, vector: str, dims: int, k: int, recall: float = 0.97, **more) -> DataFrame:
    """(item, neighbour, cosine, rank): the k most similar others of every item with a usable vector.

    The search is over distinct vectors; an item's neighbours are the items of its own class, cosine 1,
    then those of the nearest classes, ordered by cosine and id. Only the k + 1 least ids of a class can
    be neighbours. The probes are set for the given recall on vectors held out from
    training and on the sample; ties are ordered by id. `more` goes to the Index.
    """
    classes = vector_classes(df, item, vector, dims)
    some = Window.partitionBy("class").orderBy("item")
    few = classes.select("item", "class").withColumn("_n", F.row_number().over(some)).filter(F.col("_n") <= k + 1)
    few = few.select(F.col("item").alias("neighbour"), F.col("class").alias("other"))
    found = Index(classes, dims, k=k, recall=recall, **more).nearest(k).select(F.col("id").alias("class"), "other", "cosine")
    own = classes.filter(F.col("item") == F.col("class")).select("class", F.col("class").alias("other"), F.lit(1.0).alias("cosine"))
    near = found.unionByName(own).join(few, "other")
    # The k + 1 best of a class, itself among them, serve all its items: a list on the class, which may be hot.
    top = Window.partitionBy("class").orderBy(F.desc("cosine"), "neighbour")
    near = near.withColumn("_n", F.row_number().over(top)).filter(F.col("_n") <= k + 1)
    near = near.groupBy("class").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("away"), "neighbour"))).alias("_near"))
    rows = skew_join(classes.select("item", "class"), near, ["class"], hot_keys(classes, ["class"], classes.count()))
    others = F.slice(F.filter("_near", lambda x: x["neighbour"] != F.col("item")), 1, k)
    rows = rows.select("item", F.posexplode(others).alias("_at", "_x"))
    return rows.select("item", F.col("_x.neighbour").alias("neighbour"), (-F.col("_x.away")).alias("cosine"), (F.col("_at") + 1).alias("rank"))


def measured_recall(df: DataFrame, item: str, vector: str, dims: int, k: int, asked: Column, **more) -> DataFrame:
    """(queries, recall): the share of the true k nearest of the items `asked` for that `nearest` finds.

    `asked` is a condition on the column item. All items are compared with those asked for, in blocks; an
    item as near as the k-th true one is a true one. Without neighbours the recall is 1.
    """
    found = nearest(df, item, vector, dims, k, **more)
    members = vector_classes(df, item, vector, dims)
    asked_for = stored(members.filter(asked).select("item"))
    rows = members.select(F.lit("all").alias("realm"), F.col("item").alias("id"), F.col("vector").cast("array<double>").alias("v"))
    asks = rows.join(asked_for.withColumnRenamed("item", "id"), "id", "left_semi").select(*rows.columns)

    def load(block):
        return unit(block["v"].combine_chunks().flatten().to_numpy().reshape(-1, dims))

    true = blocked_top(rows, asks, k + 1, load, lambda base, q: load(q) @ base.T)
    true = true.filter(F.col("query") != F.col("item")).withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"))))
    true = true.filter(F.col("_n") <= k).groupBy("query").agg(F.min("score").alias("_least"), F.count(F.lit(1)).alias("_all"))
    near = found.join(true.select(F.col("query").alias("item"), "_least"), "item").filter(F.col("cosine") >= F.col("_least") - 1e-9)
    hits = near.groupBy("item").agg(F.count(F.lit(1)).alias("_hits"))
    each = asked_for.join(true.withColumnRenamed("query", "item"), "item", "left").join(hits, "item", "left")
    share = F.coalesce(F.sum("_hits"), F.lit(0)) / F.sum("_all")
    return each.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(share, F.lit(1.0)).alias("recall"))
