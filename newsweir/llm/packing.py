"""Filling containers of fixed capacity with items of varying length."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweir.operators.skew import salted_prefix

# Lengths are put into this many bins for the least-squares problem; combinations have at most 3 lengths.
_BINS = 96
# A planned combination is made only while no more than this part of a container stays empty.
_WASTE = 0.002
# How far below the capacity a combination of bins may end, in bins.
_WINDOW = 1


def combinations(bins: int = _BINS, window: int = _WINDOW) -> list[tuple[int, ...]]:
    """Descending combinations of at most three bins, each rounded up to its end, that fill a container."""
    out: list[tuple[int, ...]] = [(a,) for a in range(bins - window, bins + 1)]
    for a in range(bins, 0, -1):
        for b in range(min(a, bins - a), 0, -1):
            if bins - window <= a + b:
                out.append((a, b))
            out += [(a, b, c) for c in range(min(b, bins - a - b), 0, -1) if bins - window <= a + b + c]
    return out


def solve_nonnegative(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 with a least |a x - b|, by accelerated projected gradients."""
    g, c = a.T @ a, a.T @ b
    v = np.ones(len(g))
    for _ in range(30):
        v = g @ v
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * (v @ g @ v))
    x = y = np.zeros(len(c))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - step * (g @ y - c), 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


class _Stock:
    """Counts by length, with the lengths still in stock in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: n for k, n in counts.items() if n > 0}
        self.lengths = sorted(self.counts)

    def fitting(self, room: int, taken: dict[int, int]) -> int | None:
        """The greatest length of at most `room` with a piece left beside those taken."""
        i = bisect_right(self.lengths, room)
        while i:
            i -= 1
            if self.counts[self.lengths[i]] > taken.get(self.lengths[i], 0):
                return self.lengths[i]
        return None

    def take(self, pieces: dict[int, int], times: int) -> None:
        for length, n in pieces.items():
            self.counts[length] -= n * times
            if not self.counts[length]:
                del self.counts[length]
                self.lengths.remove(length)


def plan_containers(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(pieces by length, containers filled that way)] that use up `counts`, lengths from 1 to capacity.

    A non-negative least-squares fit of the length histogram by combinations of at most three binned
    lengths says how often to repeat each; repeats are rounded down. Each is made of the longest pieces
    its bins have left, as long as the container is all but full; then what room remains, and what pieces
    remain, are filled greedily with the longest piece that fits. Each step empties the stock of a length or a combination's repeats, so the
    work depends on the capacity, not on the number of pieces.
    """
    stock = _Stock(counts)
    width = capacity / _BINS
    shapes = combinations()
    histogram = np.zeros(_BINS)
    for length, n in stock.counts.items():
        histogram[int(np.ceil(length / width)) - 1] += n
    a = np.zeros((_BINS, len(shapes)))
    for j, shape in enumerate(shapes):
        for part in shape:
            a[part - 1, j] += 1
    repeats = solve_nonnegative(a, histogram)
    plan: list[tuple[dict[int, int], int]] = []

    def filled(pieces: dict[int, int], room: int) -> int:
        """Adds the longest pieces that fit to `pieces`; the room left."""
        while (length := stock.fitting(room, pieces)) is not None:
            pieces[length] = pieces.get(length, 0) + 1
            room -= length
        return room

    def make(pieces: dict[int, int], most: int) -> int:
        times = min([most, *(stock.counts[k] // n for k, n in pieces.items())])
        stock.take(pieces, times)
        plan.append((pieces, times))
        return times

    for j in np.argsort(-repeats, kind="stable"):
        left = int(np.floor(repeats[j] + 1e-6))
        while left > 0:
            pieces: dict[int, int] = {}
            room = capacity
            for at, part in enumerate(shapes[j], 1):
                # The last piece may use what the others left of their bins.
                most = room if at == len(shapes[j]) else min(room, int(np.floor(part * width)))
                length = stock.fitting(most, pieces)
                if length is None or length <= (part - 1) * width:
                    break
                pieces[length] = pieces.get(length, 0) + 1
                room -= length
            else:
                if filled(pieces, room) <= _WASTE * capacity:
                    left -= make(pieces, left)
                    continue
            break
    while stock.lengths:
        pieces = {stock.lengths[-1]: 1}
        filled(pieces, capacity - stock.lengths[-1])
        make(pieces, stock.counts[stock.lengths[-1]])
    return plan


class _Places:
    """Which container holds the piece of a length with a given rank."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]):
        next_rank: dict[int, int] = {}
        rows, base = [], 0
        for pieces, times in plan:
            for length, n in pieces.items():
                start = next_rank.get(length, 0)
                rows.append((length, start, base, n))
                next_rank[length] = start + n * times
            base += times
        rows.sort()
        cols = np.array(rows, np.int64).reshape(-1, 4)
        self.key, self.start, self.base, self.n = (cols[:, 0] << 44) + cols[:, 1], cols[:, 1], cols[:, 2], cols[:, 3]

    def find(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.key, (length << 44) + rank, side="right") - 1
        return self.base[at] + (rank - self.start[at]) // self.n[at]


def pack(sized: DataFrame, item: str, size: str, capacities: dict[str, int]) -> DataFrame:
    """(spec, container, item, part, size): every item in containers of each capacity, whole where it fits.

    An item larger than the capacity is cut into full containers of its own and a rest; part numbers the
    pieces of an item from 0. All other pieces stay whole. Only the histogram of lengths, at most one
    count per length below the capacity, goes to the driver, which plans how containers are composed; each
    piece finds its container from its rank among the pieces of its length. Ranks are made without
    gathering a length in one task, however common it is. Items of size 0 or null size are put into one
    container named empty; a null item is placed like any other. An empty table gives no rows.
    """
    if not all(c > 0 for c in capacities.values()):
        raise ValueError("capacities must be positive")
    spark = sized.sparkSession
    base = sized.select(F.col(item), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
    specs = F.array(*[F.struct(F.lit(k).alias("spec"), F.lit(c).cast("long").alias("_capacity")) for k, c in capacities.items()])
    rows = base.select(item, "_size", F.inline(specs))
    full, rest = F.floor(F.col("_size") / F.col("_capacity")), F.col("_size") % F.col("_capacity")
    rows = rows.withColumn("_full", full.cast("long")).withColumn("_rest", rest)

    counts: dict[str, dict[int, int]] = {k: {} for k in capacities}
    for r in rows.filter(F.col("_rest") > 0).groupBy("spec", "_rest").count().collect():
        counts[r["spec"]][r["_rest"]] = r["count"]
    places = spark.sparkContext.broadcast({k: _Places(plan_containers(counts[k], c)) for k, c in capacities.items()})

    order = F.pmod(F.xxhash64(F.col(item), F.lit(8)), F.lit(2**32))
    rests = rows.filter(F.col("_rest") > 0).select("spec", item, "_full", "_rest", order.alias("_order"))
    n_rests = sum(n for own in counts.values() for n in own.values())
    ranked = salted_prefix(rests, ["spec", "_rest"], "_order", item, F.lit(1), "_rank", max(64, -(-n_rests // 500_000)))

    out = rows.select("spec", F.lit("").alias("container"), item, F.lit(0).alias("part"), F.lit(0).cast("long").alias(size)).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spec = np.array(b.column(0).to_pylist(), object)
            length, rank = b.column(3).to_numpy(), b.column(4).to_numpy()
            at = np.zeros(len(spec), np.int64)
            for k in set(spec):
                own = spec == k
                at[own] = places.value[k].find(length[own], rank[own])
            names = pa.array([f"{k}-{i}" for k, i in zip(spec, at)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), names, b.column(1), b.column(2), b.column(3)], out.names)

    placed = ranked.select("spec", item, F.col("_full").cast("int"), "_rest", "_rank").mapInArrow(place, out)
    whole = rows.filter(F.col("_full") > 0).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_full").cast("int") - 1)))
    whole = whole.select(
        "spec", F.concat_ws("-", "spec", F.lit("full"), F.col(item), "part").alias("container"), item, "part", F.col("_capacity").alias(size)
    )
    empty = rows.filter(F.col("_size") == 0).select(
        "spec", F.concat("spec", F.lit("-empty")).alias("container"), item, F.lit(0).alias("part"), F.lit(0).cast("long").alias(size)
    )
    return placed.unionByName(whole).unionByName(empty)
