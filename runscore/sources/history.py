"""Run history: insert-or-replace, bucketed versions and feedback rows.

A kept table is partitioned by version and hash bucket of its key. A change
writes the buckets it touches as a new version and leaves the others alone; the
present state is the newest version of every bucket. Nothing that was written
is changed, so a change that is repeated after a failure reads the same state
and replaces its own version only.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runscore.operators.iterations import explode_rounds
from runscore.operators.profile import row_fingerprint
from runscore.sources.batches import append_batch

BUCKETS = 64
_PLACE = re.compile(r"/version=(\d+)/bucket=(\d+)/")


def upsert_runs(target: DataFrame, new: DataFrame) -> DataFrame:
    """Insert-or-replace by run_id: the latest ``created_at`` stays, new rows win ties.

    ``row_number() = 1`` is applied per input partition before the shuffle, so
    repeated versions of one run do not pile up in a task.
    """
    both = target.withColumn("__new", F.lit(0)).unionByName(
        new.withColumn("__new", F.lit(1)), allowMissingColumns=True
    )
    newest = Window.partitionBy("run_id").orderBy(
        F.col("created_at").desc_nulls_last(), F.col("__new").desc()
    )
    return (
        both.withColumn("__rank", F.row_number().over(newest))
        .where(F.col("__rank") == 1)
        .drop("__rank", "__new")
    )


def list_runs(history: DataFrame, mode: str | None = None) -> DataFrame:
    return history if mode is None else history.where(F.col("mode") == mode)


def save_version(table: DataFrame, path: str, version: int) -> str:
    """Write a whole table as one immutable version (action). Writing it again is harmless."""
    target = f"{path}/version={version}"
    table.write.mode("overwrite").parquet(target)
    return target


def load_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _bucketed(table: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return table.withColumn("bucket", bucket_of(keys, buckets))


def save_buckets(
    table: DataFrame, path: str, version: int, keys: list[str], buckets: int = BUCKETS
) -> None:
    """Write the buckets that hold rows of the table as one version (action).

    Dynamic partition overwrite: writing a version again replaces its own
    buckets and nothing else.
    """
    placed = _bucketed(table, keys, buckets).withColumn("version", F.lit(version))
    (
        placed.repartition("bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("version", "bucket")
        .parquet(path)
    )


def bucket_versions(spark: SparkSession, path: str, upto: int | None = None) -> dict[int, list[int]]:
    """Versions of every bucket up to ``upto``, ascending; from file names only."""
    try:
        files = spark.read.schema("version int").parquet(path).inputFiles()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    found: dict[int, set[int]] = {}
    for name in files:
        place = _PLACE.search(name)
        if place and (upto is None or int(place[1]) <= upto):
            found.setdefault(int(place[2]), set()).add(int(place[1]))
    return {bucket: sorted(versions) for bucket, versions in found.items()}


def load_buckets(
    spark: SparkSession,
    path: str,
    upto: int | None = None,
    only: set[int] | None = None,
    schema: str | None = None,
) -> DataFrame | None:
    """Newest rows of every bucket as of a version, of some buckets where ``only`` is given.

    None where no such bucket has been written.
    """
    newest = {b: v[-1] for b, v in bucket_versions(spark, path, upto).items() if only is None or b in only}
    if not newest:
        return None
    reader = spark.read.option("basePath", path)
    if schema is not None:
        reader = reader.schema(schema)
    places = [f"{path}/version={v}/bucket={b}" for b, v in sorted(newest.items())]
    return reader.parquet(*places).drop("version", "bucket")


def change_buckets(
    batch: DataFrame,
    path: str,
    version: int,
    keys: list[str],
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    buckets: int = BUCKETS,
    *,
    repeats: bool = True,
) -> list[int]:
    """Merge a batch into the state before ``version`` and write what changed as it (action).

    Rows that are stored already, equal in every column, are repeats: they are
    dropped, and a bucket that gets nothing else is not rewritten. With
    ``repeats=False`` the batch is known to hold none. Returns the buckets
    written.
    """
    spark = batch.sparkSession
    columns = batch.columns
    placed = _bucketed(batch.dropDuplicates() if repeats else batch, keys, buckets).persist()
    touched = {r["bucket"] for r in placed.select("bucket").distinct().collect()}
    state = load_buckets(spark, path, version - 1, touched) if touched else None
    fresh, changed, table = placed, touched, placed.drop("bucket")
    if state is not None and not repeats:
        table = merge(state.select(*columns), table)
    elif state is not None:
        state = state.select(*columns)
        mark = row_fingerprint(columns)
        stored = state.select(*mark)
        fresh = placed.withColumns({"h1": mark[0], "h2": mark[1]}).join(stored, ["h1", "h2"], "left_anti")
        fresh = fresh.drop("h1", "h2").persist()
        changed = {r["bucket"] for r in fresh.select("bucket").distinct().collect()}
        kept = _bucketed(state, keys, buckets).where(F.col("bucket").isin(sorted(changed)))
        table = merge(kept.drop("bucket"), fresh.drop("bucket"))
    if changed:
        save_buckets(table, path, version, keys, buckets)
    fresh.unpersist()
    placed.unpersist()
    return sorted(changed)


def replace_rows(state: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The state with the rows of ``new`` in place of those with equal keys."""
    touched = new.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = reduce(and_, [state[k].eqNullSafe(touched[f"__{k}"]) for k in keys])
    return state.join(touched, same, "left_anti").unionByName(new)


def drop_superseded(spark: SparkSession, path: str, upto: int) -> int:
    """Delete bucket versions that a newer one up to ``upto`` replaces; returns how many (action).

    States of versions from ``upto`` on stay readable.
    """
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    old = [(v, b) for b, versions in bucket_versions(spark, path, upto).items() for v in versions[:-1]]
    for version, bucket in old:
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/version={version}/bucket={bucket}")
        place.getFileSystem(hadoop).delete(place, True)
    return len(old)


def feedback_rows(runs: DataFrame) -> DataFrame:
    """One row per feedback round with the round as JSON payload."""
    return explode_rounds(runs).select(
        "run_id",
        "iteration",
        "score",
        F.col("passed").cast("int").alias("passed"),
        F.to_json(
            F.struct("iteration", "score", "passed", "items", "summary", "qualification_score",
                     "qualified", "decision_score")
        ).alias("payload"),
    )


def append_feedback(runs: DataFrame, path: str, batch: str) -> None:
    """Append the feedback rows of new runs as a batch (action).

    The same batch again replaces its rows; read with ``read_batches``.
    """
    append_batch(feedback_rows(runs), path, batch)
