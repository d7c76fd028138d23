"""One ranking from several differently-scaled scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A normal distribution's standard deviation over its median absolute deviation, and over its mean one.
_MAD, _MEAN_AD = 1.4826, 1.2533
# Bounded values of scored items lie in (_LEAST, 1); a method that lacks an item gives it _MISSING.
_LEAST, _MISSING = 0.02, 0.01


def _segments(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of a sorted key."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    return starts, np.diff(np.r_[starts, len(key)])


def _medians(x: np.ndarray, seg: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    v = x[np.lexsort((x, seg))]
    return (v[starts + (lengths - 1) // 2] + v[starts + lengths // 2]) / 2


def squash(score: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Scores as values in (0.02, 1), in the same order within a segment; `seg` is sorted and numbers segments.

    Each is taken from its segment's median and divided by the segment's median absolute deviation, or, if
    that is 0, by the mean one; the logistic function then flattens outliers. A steepness well below 1 and
    double precision keep far outliers apart. Where all scores are equal every value is the middle one.
    """
    starts, lengths = _segments(seg)
    spread = lambda v: np.repeat(v, lengths)
    away = score - spread(_medians(score, seg, starts, lengths))
    mad = _MAD * _medians(np.abs(away), seg, starts, lengths)
    mean = _MEAN_AD * np.add.reduceat(np.abs(away), starts) / lengths if len(starts) else mad
    scale = spread(np.where(mad > 0, mad, np.where(mean > 0, mean, 1)))
    z = away / scale
    # Beyond 4 deviations only the logarithm counts, so that no two scores meet at the bound.
    z = np.sign(z) * np.where(np.abs(z) > 4, 4 + np.log1p(np.maximum(np.abs(z) - 4, 0)), np.abs(z))
    return _LEAST + (1 - _LEAST) / (1 + np.exp(-z))


def majority_winners(values: np.ndarray, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The row of each segment that has the higher value in more columns than the lower, against every other row; -1 if none.

    Rows of a segment lie in fused order. A candidate goes down the order and gives way to the row that
    isn't below it; only the last one left can be a winner, which a second pass tests. Where two bounded
    values meet by rounding the raw ones decide, so the result is exact. All segments take a step at once.
    """

    def votes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = np.sign(values[a] - values[b])
        return np.where(s != 0, s, (raw[a] > raw[b]).astype(int) - (raw[a] < raw[b])).sum(1)

    left, steps = np.arange(len(starts)), int(lengths.max(initial=0))
    best = starts.copy()
    for step in range(1, steps):
        left = left[lengths[left] > step]
        row = starts[left] + step
        best[left] = np.where(votes(best[left], row) > 0, best[left], row)
    won, left = np.ones(len(starts), bool), np.arange(len(starts))
    for step in range(steps):
        left = left[lengths[left] > step]
        row = starts[left] + step
        won[left] &= (votes(best[left], row) > 0) | (row == best[left])
    return np.where(won, best, -1)


def fused_ranking(lists: DataFrame, record: str, method: str, items: str, scores: str, weights: dict | None = None) -> DataFrame:
    """(record, item, score, rank, methods) of all scored items of each record; items are strings.

    Within a method an item has its highest non-null score. Scores are standardised within their record
    and method by median and median absolute deviation, squashed by the logistic function, and combined
    by the geometric mean weighted by `weights` (1 for a method not named). A method of the record that
    lacks the item gives it less than it gives any item it scored. Ties of score are ordered by item id.
    methods counts the record's methods.

    Null and blank ids, null or NaN scores, and rows without record or method are left out; repeated rows
    change nothing. A record of one method is ranked by it. Records without a scored item give no rows.
    """
    return _fused(lists, record, method, items, scores, weights).select("record", "item", "score", "rank", "methods")


def majority_items(lists: DataFrame, record: str, method: str, items: str, scores: str) -> DataFrame:
    """(record, item, rank, methods): the item that more methods put above than below each other item of its record.

    A walk down the fused ranking by the methods' bounded values finds the only candidate, see
    majority_winners; rank is its place in that ranking. Records without such an item give no row. Nulls,
    repeats and ties as in fused_ranking.
    """
    return _fused(lists, record, method, items, scores, None).filter("majority").select("record", "item", "rank", "methods")


def _fused(lists: DataFrame, record: str, method: str, items: str, scores: str, weights: dict | None) -> DataFrame:
    weights = weights or {}
    known = lists.filter(F.col(record).isNotNull() & F.col(method).isNotNull())
    long = known.select(
        F.col(record).alias("record"),
        F.col(method).alias("method"),
        F.explode_outer(F.arrays_zip(F.col(items).alias("item"), F.col(scores).alias("score"))).alias("_x"),
    ).select("record", "method", F.col("_x.item").alias("item"), F.col("_x.score").cast("double").alias("score"))
    usable = (F.length(F.trim("item")) > 0) & F.col("score").isNotNull() & ~F.isnan("score")
    # A row without a usable pair still names the method.
    long = long.select("record", "method", F.when(usable, F.col("item")).alias("item"), F.when(usable, F.col("score")).alias("score"))
    best = long.groupBy("record", "method", "item").agg(F.max("score").alias("score"))
    per_record = best.groupBy("record").agg(F.collect_list(F.struct("method", "item", "score")).alias("all"))

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lens = pa.compute.list_value_length(batch["all"]).to_numpy(zero_copy_only=False).astype(int)
            flat = batch["all"].flatten()
            method_codes = flat.field("method").dictionary_encode()
            item_codes = flat.field("item").dictionary_encode()
            m = method_codes.indices.to_numpy()
            names = method_codes.dictionary.to_pylist()
            item = item_codes.indices.fill_null(-1).to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), lens)
            n_methods = np.zeros((batch.num_rows, len(names)), bool)
            n_methods[owner, m] = True
            ok = item >= 0
            score = flat.field("score").fill_null(0.0).to_numpy()[ok]
            owner, m, item = owner[ok], m[ok], item[ok]
            order = np.lexsort((m, owner))
            owner, m, item, score = owner[order], m[order], item[order], score[order]
            value = squash(score, owner * len(names) + m)
            # Number the items of each record, in the order of their ids.
            text = np.array(item_codes.dictionary.to_pylist(), object)
            place = np.empty(len(text), int)
            place[np.argsort(text.astype(str))] = np.arange(len(text))
            key, row = np.unique(owner * (len(text) + 1) + place[item] if len(item) else np.zeros(0, int), return_inverse=True)
            first = np.zeros(len(key), int)
            first[row] = np.arange(len(row))
            table = np.full((len(key), len(names)), _MISSING)
            table[row, m] = value
            raw = np.full((len(key), len(names)), -np.inf)
            raw[row, m] = score
            of, item = owner[first], item[first]
            w = np.array([weights.get(x, 1.0) for x in names])[None, :] * n_methods[of]
            fused = np.exp((w * np.log(table)).sum(1) / np.maximum(w.sum(1), 1e-12))
            starts, lengths = _segments(of)
            # Each record's rows from the highest score down, equal ones by id.
            order = np.lexsort((np.arange(len(of)), -fused, of))
            rank = np.zeros(len(of), int)
            rank[order] = np.arange(len(of)) - np.repeat(starts, lengths) + 1
            top = majority_winners(table[order], raw[order], starts, lengths)
            winner = np.zeros(len(of), bool)
            winner[order[top[top >= 0]]] = True
            yield pa.RecordBatch.from_arrays(
                [
                    batch["record"].take(pa.array(of)),
                    pa.array(text[item], pa.string()),
                    pa.array(fused),
                    pa.array(rank, pa.int32()),
                    pa.array(n_methods.sum(1)[of], pa.int32()),
                    pa.array(winner),
                ],
                ["record", "item", "score", "rank", "methods", "majority"],
            )

    schema = "record string, item string, score double, rank int, methods int, majority boolean"
    return per_record.select(F.col("record").cast("string").alias("record"), "all").mapInArrow(fuse, schema)
