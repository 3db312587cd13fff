"""Session helpers: the shared folder for checkpoints and written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK = 50_000  # rows that become wide records in one task


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where that is unset, a folder below the warehouse takes its place.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table; never reused between calls."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def spread_small(table: DataFrame) -> DataFrame:
    """Use all cores on a table read as fewer partitions than there are cores.

    Text scoring is bound by CPU, and a small file is one partition. A table
    that already has enough partitions is returned unchanged, without a shuffle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def spread_rows(table: DataFrame, tasks_per_core: int = 1) -> DataFrame:
    """Use all cores and at most about ROWS_PER_TASK rows a task (action: counts rows).

    For narrow rows that become wide records: a task sorts or writes the records
    of its rows, so its memory must not grow with the table. A table that has
    enough partitions is returned unchanged, without a shuffle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores * tasks_per_core, -(-table.count() // ROWS_PER_TASK))
    return table.repartition(wanted) if table.rdd.getNumPartitions() < wanted else table
