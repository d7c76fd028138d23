"""The driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` under `sf_dir`; columns are pruned by whoever selects from it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(c):
    """True for an id that is neither null nor blank."""
    return F.length(F.trim(c)) > 0


def clean_ids(ids):
    """An id list without null and blank elements; a null list stays null."""
    return F.filter(ids, filled)


def clicks(impressions: DataFrame) -> DataFrame:
    """(impression_id, article_id), one row per click.

    A click is a distinct pair of impression and article; null and blank ids are left out, so are
    impressions without an id. Copies of an impression add nothing.
    """
    return (
        impressions.select("impression_id", F.explode(clean_ids("clicked")).alias("article_id"))
        .filter(F.col("impression_id").isNotNull())
        .distinct()
    )
