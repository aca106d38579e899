"""Stored tables as DataFrames, and the use of all cores on small ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows that one task gets, about, of a job that does much work on small rows.
TASK_ROWS = 250_000


def spread(rows: DataFrame, *key: str, task_rows: int | None = None) -> DataFrame:
    """Spread a scan with fewer partitions than the cluster has cores, by ``key``.

    A small file is one task, which would do all the work of a costly per-row job alone. A
    scan of any size that matters has more partitions than there are cores and is
    returned as it is, without a shuffle. Name a unique key, so that rows spread evenly and a
    retried task sends each row to the same place.

    A scan is cut by bytes, so tasks of many small rows take the longer the larger the table is, up to the size of a file block. With
    ``task_rows`` there is a partition for each so many rows at least, which parquet files tell without being read.
    """
    width = rows.sparkSession.sparkContext.defaultParallelism
    if task_rows is not None:
        width = max(width, -(-rows.count() // task_rows))
    if rows.rdd.getNumPartitions() >= width:
        return rows
    return rows.repartition(width, *key)
