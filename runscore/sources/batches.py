"""Appending in batches, so that a repeated append leaves one set of rows.

A batch is a folder of its own, named by the caller. Writing a batch again
replaces it. Spark marks a folder when its job has committed, and readers take
marked batches only: an append that failed half-way is never seen.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


def append_batch(table: DataFrame, path: str, batch: str) -> None:
    """Write the rows as the batch of that name (action)."""
    if not _NAME.fullmatch(batch):
        raise ValueError(f"not a batch name: {batch!r}")
    table.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def committed_batches(spark: SparkSession, path: str) -> list[str]:
    """Names of the batches whose write has ended, in order; from folder names only."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    marks = store.globStatus(folder) or []
    return sorted(mark.getPath().getParent().getName().removeprefix("batch=") for mark in marks)


def read_batches(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of all committed batches with the column ``batch``; None where there is none."""
    names = committed_batches(spark, path)
    if not names:
        return None
    reader = spark.read.option("basePath", path).option("mergeSchema", True)
    return reader.parquet(*[f"{path}/batch={name}" for name in names])
