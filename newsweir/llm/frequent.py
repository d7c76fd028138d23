"""Most frequent items by Misra-Gries summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "part long, item string, low long, error long, total long"
_FAN_IN = 128
_ROUNDS = 3  # 128^3 partitions are merged with at most 128 summaries in a task


def _counts(items, n) -> pa.Table:
    t = pa.table({"item": items, "n": pa.array(n, pa.int64())})
    return t.group_by("item").aggregate([("n", "sum")]).rename_columns(["item", "n"])


def _decrement(summary: pa.Table, counters: int) -> tuple[pa.Table, int]:
    """At most `counters` counters: all lose the next-largest count, and those left without one go."""
    n = summary["n"].to_numpy()
    if len(n) <= counters:
        return summary, 0
    cut = int(np.partition(n, len(n) - counters - 1)[len(n) - counters - 1])
    keep = n > cut
    return pa.table({"item": summary["item"].filter(pa.array(keep)), "n": pa.array(n[keep] - cut, pa.int64())}), cut


def _rows(part: int, summary: pa.Table, error: int, total: int) -> pa.RecordBatch:
    """The counters, and a row without item that carries error and total even when no counter is left."""
    items = summary["item"].to_pylist() + [None]
    size = len(items)
    cols = [[part] * size, items, summary["n"].to_pylist() + [0], [error] * size, [total] * size]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], _SCHEMA.replace(" string", "").replace(" long", "").split(", "))


def misra_gries(df: DataFrame, column: str, counters: int) -> DataFrame:
    """(item, low, high, total): every value of `column` held by more than total/(counters + 1) rows, and others.

    Each partition streams through a summary of at most `counters` counters; summaries are merged, at most
    128 in a task, by adding up counts and subtracting the next-largest counter from all. Memory is
    bounded by the number of counters, not by the rows or distinct values. low <= true count <= high, and
    high - low <= total/(counters + 1). Null values are left out. An empty table gives no rows.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, error, total = _counts(pa.array([], pa.string()), []), 0, 0
        for batch in batches:
            items = batch.column(0)
            total += len(items)
            both = pa.concat_tables([summary, _counts(items, np.ones(len(items), np.int64))])
            summary, cut = _decrement(_counts(both["item"], both["n"].to_numpy()), counters)
            error += cut
        if total:
            yield _rows(TaskContext.get().partitionId(), summary, error, total)

    def merge(t: pa.Table) -> pa.Table:
        heads = t.filter(pa.compute.is_null(t["item"]))
        rest = t.filter(pa.compute.is_valid(t["item"]))
        summary, cut = _decrement(_counts(rest["item"], rest["low"].to_numpy()), counters)
        error = sum(heads["error"].to_pylist()) + cut
        return pa.Table.from_batches([_rows(t["part"][0].as_py(), summary, error, sum(heads["total"].to_pylist()))])

    values = df.select(F.col(column).cast("string")).filter(F.col(column).isNotNull())
    summaries = values.mapInArrow(summarise, _SCHEMA)
    for left in range(_ROUNDS - 1, -1, -1):
        part = F.floor(F.col("part") / _FAN_IN).cast("long") if left else F.lit(0).cast("long")
        summaries = summaries.withColumn("part", part).groupBy("part").applyInArrow(merge, _SCHEMA)
    return summaries.filter(F.col("item").isNotNull()).select("item", "low", (F.col("low") + F.col("error")).alias("high"), "total")


def frequent_items(df: DataFrame, column: str, share: float, counters: int | None = None) -> DataFrame:
    """(item, n, total): values held by at least `share` of the rows that have one, with exact counts.

    Candidates are the counters of misra_gries whose upper bound reaches the share; there are at most
    `counters` of them (10/share by default), so they are broadcast for a recount in a second pass.
    """
    counters = counters or int(np.ceil(10 / share))
    found = misra_gries(df, column, counters).filter(F.col("high") >= share * F.col("total"))
    again = df.select(F.col(column).cast("string").alias("item")).join(F.broadcast(found.select("item", "total")), "item")
    return again.groupBy("item", "total").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= share * F.col("total"))
