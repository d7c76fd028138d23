"""Cutting a lineage so that it survives the loss of an executor."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Paths made by this process, by application, until they are released.
_MADE: dict[str, list[str]] = {}
# Shuffle files otherwise stay until the driver's garbage collector meets their last reference.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.cache
def _own_folder() -> str:
    """A temporary folder of this machine, removed when the process ends."""
    folder = tempfile.mkdtemp(prefix="newsweir-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session names in spark.checkpoint.dir, or its context was given, and all executors share.

    A session on one machine that names none gets a temporary folder; one on a cluster must name it, as
    what one executor writes to its own disk no other can read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _own_folder()
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, tidy: bool = False) -> DataFrame:
    """`df`, written once as a Parquet table to the shared folder and read back.

    As a reliable checkpoint, but compressed and open to column pruning. The table stays until it is
    released or the folder is cleared. `tidy` deletes the shuffle files of the writing when it is done.
    """
    spark = df.sparkSession
    path = shared_path(spark, "stored")
    before = spark.conf.get(_TIDY, None)
    if tidy:
        spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that `stored` made and that nothing will read again."""
    made = _MADE.get(df.sparkSession.sparkContext.applicationId, [])
    for path in {p for f in df.inputFiles() for p in made if f"/{p.rsplit('/', 1)[1]}/" in f}:
        fs, at = file_system(df.sparkSession, path)
        fs.delete(at, True)
        made.remove(path)


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path there)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def release(spark: SparkSession) -> None:
    """Deletes all tables that were stored for this application; what is still to be read from them fails."""
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        fs, at = file_system(spark, path)
        fs.delete(at, True)
