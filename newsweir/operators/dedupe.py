"""One row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in `order`, which should leave no ties; null is a key like any other.

    The limit of one row per key is applied in each map task before the shuffle.
    """
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_row", first).filter(F.col("_row") == 1).drop("_row")


def one_per_id(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per non-null `key` with the greatest value of each column, null only where all are null."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(c).alias(c) for c in columns])
