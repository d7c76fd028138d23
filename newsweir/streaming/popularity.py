"""Clicks as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweir.operators.durable import shared_path
from newsweir.sources.raw import IMPRESSIONS
from newsweir.sources.tables import clean_ids


def click_stream(spark: SparkSession, path: str) -> DataFrame:
    """(timestamp, article_id) of the clicks in Parquet files of impressions as they arrive at a folder.

    A path to a single file is read as its folder with a filter on the name.
    """
    reader = spark.readStream.schema(IMPRESSIONS)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        folder, _, name = path.rpartition("/")
        rows = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        rows = reader.parquet(path)
    return rows.filter(F.col("timestamp").isNotNull()).select("timestamp", F.explode(clean_ids("clicked")).alias("article_id"))


def windowed_popularity(clicks: DataFrame, window: str = "1 hour", lateness: str | None = "10 minutes") -> DataFrame:
    """(hour, article_id, clicks): clicks by window and article; clicks later than `lateness` are dropped.

    With `lateness` None none are dropped and the state is kept for good.
    """
    timed = clicks.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    timed = timed.withWatermark("timestamp", lateness) if lateness else timed
    counted = timed.groupBy(F.window("timestamp", window), "article_id").agg(F.count(F.lit(1)).alias("clicks"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "article_id", "clicks")


def _run(counted: DataFrame, mode: str, out: str, keep) -> None:
    run = counted.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").foreachBatch(keep)
    run.trigger(availableNow=True).start().awaitTermination()


def hourly_clicks(spark: SparkSession, path: str) -> DataFrame:
    """What a stream over the files at `path` has counted once all are read, every late click included."""
    out = shared_path(spark, "stream")
    counted = windowed_popularity(click_stream(spark, path), lateness=None)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/counts")

    _run(counted, "complete", out, keep)
    return spark.read.parquet(f"{out}/counts")


def closed_hours(spark: SparkSession, path: str, lateness: str = "10 minutes") -> DataFrame:
    """The hours that the watermark has closed once all files at `path` are read, each written once.

    State is dropped as the watermark passes, so it is bounded by the hours within `lateness` of the
    latest click. An hour is written by the batch that closes it, into a folder of the batch's number, so
    that a batch that runs again replaces its own.
    """
    out = shared_path(spark, "stream")
    counted = windowed_popularity(click_stream(spark, path), lateness=lateness)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/hours/batch={number}")

    _run(counted, "append", out, keep)
    return spark.read.parquet(f"{out}/hours").drop("batch")
