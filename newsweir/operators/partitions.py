"""Use of all cores where a table has fewer splits than there are."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """`scan`, a selection from files, in at least as many partitions as there are cores.

    For work that costs far more than moving its rows. A table of more splits, as any large one, is left
    as it is. Not for plans with a shuffle, which counting the partitions would run.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
