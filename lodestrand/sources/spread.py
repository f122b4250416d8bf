"""Small tables over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table dealt to as many partitions as there are cores, if a scan of it has fewer.

    A table of few files, or of few row groups, is read by as many tasks, whatever its columns then cost. Large tables
    have more partitions than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
