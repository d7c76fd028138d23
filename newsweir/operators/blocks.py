"""Top-k of queries against all items, in blocks: exact, with bounded memory in every task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsweir.operators.durable import stored

_BLOCK, _SHARE = 4096, 4096
_OUT = "query string, item string, score double"
# Of top_lists: queries that one task holds, and that are scored at once; digits of scores that are kept.
_HELD, _BATCH, _MICRO = 16384, 512, 1e6
_NONE = np.iinfo(np.int64).min


def first_of_rows(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest of each row, greatest and leftmost first; NaN is no score."""
    worth = np.where(np.isnan(scores), -np.inf, scores)
    least = np.partition(worth, worth.shape[1] - k, axis=1)[:, worth.shape[1] - k] if worth.shape[1] > k else np.full(len(worth), -np.inf)
    row, col = np.nonzero((worth >= least[:, None]) & (worth > -np.inf))
    order = np.lexsort((col, -worth[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(worth)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], col[keep]


def blocked_top(items: DataFrame, queries: DataFrame, k: int, load: Callable, score: Callable) -> DataFrame:
    """(query, item, score, rank) of the k best items of each query, among those of its `realm`.

    `items` and `queries` have realm, id and the same further columns. load(table) makes an index of a
    block of items, sorted by id; score(index, table) gives a matrix of rounded scores of a batch of
    queries, NaN for items that aren't results. Each task holds one block of about 4,096 items and streams
    a share of the realm's queries past it; the k best of each block meet in a window that ranks by score
    and id. Realms are labels with few values; their sizes are collected.
    """
    sizes = {r["realm"]: [r["n"], 0] for r in items.groupBy("realm").agg(F.count(F.lit(1)).alias("n")).collect()}
    for r in queries.groupBy("realm").agg(F.count(F.lit(1)).alias("n")).collect():
        if r["realm"] in sizes:
            sizes[r["realm"]][1] = r["n"]
    spark = items.sparkSession
    wide = spark.sparkContext.defaultParallelism
    cuts = []
    for realm, (n, q) in sizes.items():
        blocks = -(-n // _BLOCK)
        cuts.append((realm, blocks, max(1, -(-q // _SHARE), min(-(-wide // blocks), -(-q // 64)))))
    cuts = F.broadcast(spark.createDataFrame(cuts, "realm string, blocks int, shares int"))
    extra = [c for c in items.columns if c not in ("realm", "id")]
    number = F.xxhash64("id")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    a = items.join(cuts, "realm").withColumn("block", F.pmod(number, F.col("blocks")).cast("int")).withColumn("share", every("shares"))
    b = queries.join(cuts, "realm").withColumn("share", F.pmod(number, F.col("shares")).cast("int")).withColumn("block", every("blocks"))
    cols = ["realm", "block", "share", "ask", "id", *extra]
    tasks = a.withColumn("ask", F.lit(False)).select(*cols).unionByName(b.withColumn("ask", F.lit(True)).select(*cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, index, ids = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            whole = list(zip(*(t[c].to_pylist() for c in ("realm", "block", "share", "ask"))))
            cut = [0, *(i for i in range(1, len(whole)) if whole[i] != whole[i - 1]), len(whole)]
            for lo, hi in zip(cut, cut[1:]):
                if whole[lo][:3] != group:
                    group, parts, index = whole[lo][:3], [], None
                if not whole[lo][3]:
                    parts.append(t.slice(lo, hi - lo))
                    continue
                if index is None:
                    if not parts:
                        continue
                    block = pa.concat_tables(parts).combine_chunks().sort_by("id")
                    index, ids = load(block), block["id"].combine_chunks()
                for at in range(lo, hi, 256):
                    q = t.slice(at, min(256, hi - at))
                    s = score(index, q)
                    rows, hits = first_of_rows(s, k)
                    yield pa.RecordBatch.from_arrays(
                        [q["id"].combine_chunks().take(pa.array(rows)), ids.take(pa.array(hits)), pa.array(s[rows, hits], pa.float64())],
                        ["query", "item", "score"],
                    )

    found = tasks.repartition("realm", "block", "share").sortWithinPartitions("realm", "block", "share", "ask").mapInArrow(run, _OUT)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


class Scoring(Protocol):
    """How top_lists scores: `queries` makes a share's queries, `block` a block of items for them.

    near(queries, block, lo, hi) gives a matrix of nearly the scores of the queries from lo to hi, in single
    precision, -inf for an item or NaN for a query without scores; exact(queries, block, row, col) the very
    scores of single places of that matrix. floor(x) lies below the near score of anything whose rounded
    score is x or more, and below the rounded score of anything whose near score is. A near score that isn't
    above `least` is no result.
    """

    least: float

    def queries(self, table: pa.Table): ...

    def block(self, queries, table: pa.Table): ...

    def near(self, queries, block, lo: int, hi: int) -> np.ndarray: ...

    def exact(self, queries, block, lo: int, row: np.ndarray, col: np.ndarray) -> np.ndarray: ...

    def floor(self, block, x: np.ndarray) -> np.ndarray: ...


class _Best:
    """The k best of each query of a batch: a whole number holds the rounded score and, below it, the place by id from the end."""

    def __init__(self, n: int, k: int, bits: int):
        self.keys, self.bits = np.full((n, k), _NONE), bits
        self.rows: list[np.ndarray] = []
        self.found: list[np.ndarray] = []
        self.waiting = 0
        self.last = self.keys.min(axis=1)

    def worst(self) -> np.ndarray:
        """The rounded score of each query's last, -inf while it has fewer than k."""
        return np.where(self.last == _NONE, -np.inf, (self.last >> self.bits) / _MICRO)

    def add(self, row: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        micro = np.rint(score * _MICRO)
        if len(micro) and np.abs(micro).max() >= 2.0 ** (62 - self.bits):
            raise OverflowError("scores are too great to be ranked with so many items")
        key = (micro.astype(np.int64) << self.bits) + ((1 << self.bits) - 1 - place)
        better = key > self.last[row]
        self.rows.append(row[better])
        self.found.append(key[better])
        self.waiting += len(self.rows[-1])
        if 2 * self.waiting > self.keys.size:
            self.merge()

    def merge(self) -> None:
        if self.waiting:
            row, key = np.concatenate(self.rows), np.concatenate(self.found)
            order = np.argsort(row, kind="stable")
            row, key = row[order], key[order]
            n = np.bincount(row, minlength=len(self.keys))
            new = np.full((len(self.keys), n.max()), _NONE)
            new[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = key
            self.keys = np.partition(np.concatenate([self.keys, new], axis=1), new.shape[1], axis=1)[:, new.shape[1] :]
            self.last = self.keys.min(axis=1)
        self.rows, self.found, self.waiting = [], [], 0

    def ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, place by id, score, rank), in this order."""
        self.merge()
        keys = -np.sort(-np.maximum(self.keys, _NONE + 1), axis=1)
        row, at = np.nonzero(keys > _NONE + 1)
        key = keys[row, at]
        return row, (1 << self.bits) - 1 - (key & ((1 << self.bits) - 1)), (key >> self.bits) / _MICRO, at + 1


def top_lists(items: DataFrame, queries: DataFrame, k: int, scoring: Scoring) -> DataFrame:
    """(query, item, score, rank) of the k best items of each query, among those of its `realm`; ties by id.

    `items` and `queries` have realm, id and what `scoring` needs. The items are written once, in blocks of
    about 4,096 in the order of ids. A task holds some 16,384 queries with their best so far and reads block
    after block from the shared folder, by pyarrow, so neither items nor partial lists are shuffled, and its
    memory holds a share, a block, and the ids of a realm. Nearly right scores tell which few items of a
    block can be among a query's best; these get exact scores. Blocks are counted by realm, a label.
    """
    items = items.filter(F.col("realm").isNotNull() & F.col("id").isNotNull())
    blocks = max(1, -(-items.count() // _BLOCK))
    laid = stored(items.repartitionByRange(blocks, "realm", "id").sortWithinPartitions("realm", "id"), tidy=True)
    files = laid.groupBy("realm", F.col("_metadata.file_path").alias("path")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    places: dict[str, list] = {}
    for r in sorted(files.collect(), key=lambda r: r["first"]):
        places.setdefault(r["realm"], []).append((r["path"], r["n"]))
    columns = [c for c in laid.columns if c != "realm"]

    def read(path: str, realm: str) -> pa.Table:
        from pyarrow import fs, parquet

        at, name = fs.FileSystem.from_uri(path)
        with at.open_input_file(name) as f:
            t = parquet.ParquetFile(f).read(columns=["realm", *columns], use_threads=False)
        return t.filter(pc.equal(t["realm"], realm)).combine_chunks()

    def lists(realm: str, table: pa.Table) -> Iterator[pa.RecordBatch]:
        held = scoring.queries(table)
        bits = max(1, sum(n for _, n in places[realm]).bit_length())
        cuts = [(lo, min(lo + _BATCH, table.num_rows)) for lo in range(0, table.num_rows, _BATCH)]
        best, ids, before = [_Best(hi - lo, k, bits) for lo, hi in cuts], [], 0
        for path, _ in places[realm]:
            t = read(path, realm)
            block = scoring.block(held, t)
            for (lo, hi), b in zip(cuts, best):
                near = scoring.near(held, block, lo, hi)
                worst = scoring.floor(block, b.worst())
                if near.shape[1] > k and (new := np.isneginf(worst)).any():
                    some = near[new]
                    kth = np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k]
                    worst[new] = scoring.floor(block, scoring.floor(block, kth))
                row, col = np.divmod(np.flatnonzero(near > np.maximum(worst, scoring.least).astype(near.dtype)[:, None]), near.shape[1])
                if len(row):
                    b.add(row, scoring.exact(held, block, lo, row, col), before + col)
            ids.append(t["id"].combine_chunks())
            before += t.num_rows
        ids = pa.chunked_array(ids).combine_chunks()
        for (lo, _), b in zip(cuts, best):
            row, place, score, rank = b.ranked()
            yield pa.RecordBatch.from_arrays(
                [table["id"].take(pa.array(lo + row)).combine_chunks(), ids.take(pa.array(place)), pa.array(score), pa.array(rank, pa.int32())],
                ["query", "item", "score", "rank"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            for realm in t["realm"].unique().to_pylist():
                if realm in places:
                    yield from lists(realm, t.filter(pc.equal(t["realm"], realm)).combine_chunks())

    asked, wide = queries.filter(F.col("realm").isNotNull()), 2 * items.sparkSession.sparkContext.defaultParallelism
    n = asked.count()
    shares = max(1, -(-n // _HELD), min(wide, -(-n // 64)))
    dealt = asked.repartitionByRange(shares, "realm", F.xxhash64("id"), "id")
    return dealt.mapInArrow(run, f"{_OUT}, rank int")
