"""Aggregates, joins and ranks that hold when a few keys own most of the rows."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_KEYS of all rows, so there are fewer than HOT_KEYS hot
# keys whatever the data: a list of them can always be broadcast.
HOT_KEYS = 512


def keyed_counts(df: DataFrame, record: str, key: str, name: str = "n") -> DataFrame:
    """Number of distinct records per key, exact, without an overloaded task.

    Two map-side combining steps: (record, key) pairs are made distinct first, partially in each map
    task, and spread by pair so that no key gathers in a task; then counts are combined per key in
    each map task's hash table (which spills) and one partial count per key and map task is shuffled.
    Null keys are counted under null, records without an id are left out. An empty table gives no rows.
    """
    pairs = df.select(record, key).filter(F.col(record).isNotNull()).distinct()
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def heavy_share(counts: DataFrame, key: str, n: str, share: float, by: str) -> DataFrame:
    """Rows of `counts` with a key that hold at least `share` of the total of their group `by`, null keys included.

    The totals have one row per value of `by`, a label the caller makes, so they are broadcast. The test on
    the key needs the total: pushed below the join, it would make two different inputs of one.
    """
    totals = counts.groupBy(by).agg(F.sum(n).alias("_total"))
    heavy = F.when(F.col(n) >= share * F.col("_total"), F.col(key)).isNotNull()
    return counts.join(F.broadcast(totals), by).filter(heavy).drop("_total")


def hot_keys(df: DataFrame, keys: list[str], total: int, weight: Column | None = None, limit: int = HOT_KEYS) -> DataFrame:
    """Keys with more than 1/limit of `total`, the number of rows (or sum of `weight`), with `_share`, their part.

    There are fewer than `limit` such keys whatever the data, so they are fetched once and come back as a
    local table that any number of joins can broadcast. Keys with a null are never hot: they join nothing.
    """
    some = functools.reduce(operator.and_, [F.col(k).isNotNull() for k in keys])
    per_key = df.filter(some).groupBy(*keys).agg(F.sum(weight if weight is not None else F.lit(1)).alias("_n"))
    few = per_key.filter(F.col("_n") * limit > total).withColumn("_share", F.col("_n") / F.lit(total)).drop("_n")
    return df.sparkSession.createDataFrame(few.collect(), few.schema)


def skew_join(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """`big` joined with `small`, unique on `keys`, where a few `hot` keys hold most of `big`.

    `hot` has fewer than HOT_KEYS rows, see hot_keys. `small` has one row per key, so its rows for hot
    keys are as few and are broadcast: the hot rows of `big` are never shuffled. The others are joined
    the usual way. `how` is inner or left.
    """
    marked = big.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    few = small.join(F.broadcast(hot.select(*keys)), keys, "left_semi")
    a = marked.filter(F.col("_hot")).drop("_hot").join(F.broadcast(few), keys, how)
    rest = marked.filter(F.col("_hot").isNull()).drop("_hot")
    some = functools.reduce(operator.and_, [F.col(k).isNotNull() for k in keys])
    b = rest.filter(some).join(small, keys, how)
    out = a.unionByName(b)
    if how == "left":
        # Rows with a null key match nothing; they would all meet in one task.
        new = [f for f in small.schema if f.name not in keys]
        out = out.unionByName(rest.filter(~some).select(*big.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in new]))
    return out


def _plan_bytes(df: DataFrame) -> int:
    """What the optimizer takes a plan's result for; the size of its files for a stored table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", most: int = 20_000, megabytes: int = 32) -> DataFrame:
    """`big` joined with `small`, unique on `keys`: by broadcast up to `most` rows and `megabytes`, else by skew_join.

    The size of `small` is checked each time, in rows and bytes; pass a stored table, whose rows are counted
    from footers and whose bytes are those of its files.
    """
    if _plan_bytes(small) <= megabytes << 20 and small.limit(most + 1).count() <= most:
        return big.join(F.broadcast(small), keys, how)
    return skew_join(big, small, keys, hot_keys(big, keys, big.count()), how)


def salted_prefix(
    df: DataFrame, keys: list[str], order: str, tie: str, size: Column, before: str, buckets: int | None = None
) -> DataFrame:
    """Adds `before`: the sum of `size` over the rows of the same keys that come earlier.

    `order` is a column of longs spread evenly over [0, 2^32), `tie` a unique column that orders rows
    equal in it. A window over a key that holds a third of all rows would run in one task. Here the order
    is cut into `buckets` ranges: sums per (key, range) are combined map-side, running sums over at most
    `buckets` ranges give each range its start, and the window inside a range sees 1/buckets of a key. As
    many ranges are made as leave at most some 500,000 rows in one if all rows are of one key, but 64 at
    least; pass rows that are cheap to count. Null keys form a key of their own.
    """
    buckets = buckets or max(64, -(-df.count() // 500_000))
    rows = df.withColumn("_size", size.cast("long")).withColumn("_bucket", F.floor(F.col(order) * buckets / F.lit(2**32)).cast("int"))
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"),
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("_within", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = inner.join(starts, functools.reduce(operator.and_, same, F.col("_bucket") == F.col("_b")))
    return joined.withColumn(before, F.col("_start") + F.col("_within")).select(*df.columns, before)
