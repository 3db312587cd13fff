"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where unset, one beside the warehouse."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared")
    return context.getCheckpointDir().rstrip("/")


@contextmanager
def shuffles_released(spark: SparkSession):
    """Within it, Spark removes an execution's shuffle files when the execution ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Named Parquet tables of one job below the shared folder.

    A lost executor costs its running tasks only: everything kept here is read
    again from the shared file system. drop() frees what no later step reads.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, frame: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
        """Write the frame (action) and read it back; its shuffle files go as soon as it is written."""
        with shuffles_released(self.spark):
            frame.write.options(compression="zstd", **(options or {})).parquet(self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
