"""Streams over files written from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runscore.functions.rounding import stable_round
from runscore.plans.fixtures import run_records
from runscore.plans.oracle import METRIC_BASE, rnd, suite
from runscore.plans.registry import query
from runscore.plans.scoring_queries import WITH as SCORING_WITH
from runscore.plans.source_queries import LEVEL_SQL, UPSERT_SQL, log_table, versions
from runscore.runtime import ROWS_PER_TASK, scratch_path
from runscore.sources.history import load_buckets, save_buckets
from runscore.sources.tables import stream_log_lines
from runscore.streaming import streams as T


BATCHES = 4


def arriving(spark: SparkSession, table: DataFrame, name: str) -> DataFrame:
    """Write a table as files, one a partition, and read them back as a stream of about BATCHES batches."""
    path = scratch_path(spark, name)
    table.write.parquet(path)
    files = len(spark.read.schema(table.schema).parquet(path).inputFiles())
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-files // BATCHES)))
    return reader.parquet(path)


def finished(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream to its end and return what it wrote."""
    path = scratch_path(spark, name)
    T.run_to_parquet(stream, path, scratch_path(spark, f"{name}-state")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def files_per_batch(table: DataFrame) -> int:
    """How many files make one of BATCHES batches, with about ROWS_PER_TASK rows in each (action: counts rows)."""
    return max(1, -(-table.count() // (ROWS_PER_TASK * BATCHES)))


def in_time_order(spark: SparkSession, table: DataFrame, time: str, name: str, kind: str, files: int = 4) -> str:
    """Write a table as files of ascending, disjoint times whose modification times are in that order too (action)."""
    path = scratch_path(spark, name)
    table.repartitionByRange(files, time).write.format(kind).save(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = {s.getPath().getName(): s for s in store.listStatus(folder) if s.getPath().getName().startswith("part-")}
    newest = max(s.getModificationTime() for s in parts.values())
    for number, part in enumerate(sorted(parts)):
        store.setTimes(parts[part].getPath(), newest + 1000 * (number - len(parts)), -1)
    return path


def all_windows(spark: SparkSession, windows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run windows to the end of their stream and return all of them, open ones included."""
    path = scratch_path(spark, name)
    T.stream_windows(windows, keys, path, scratch_path(spark, f"{name}-state")).awaitTermination()
    return (
        load_buckets(spark, path)
        .withColumn("window_start", F.col("window_start").cast("string"))
        .drop("window_end")
    )


@query(
    "t1_stream_scored_runs",
    f"""{SCORING_WITH} SELECT mode, COUNT(*) AS runs, {rnd('AVG(task_score)', 6)} AS task_score,
      {rnd('AVG(decision_score)', 6)} AS decision_score, COUNT(*) FILTER (WHERE passed) AS passed
    FROM passing GROUP BY mode""",
)
def scored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a batch has a file for every core
    stream = arriving(spark, run_records(spark, sf_dir, BATCHES), "runs")
    scored = finished(spark, T.stream_scored_runs(stream), "scored")
    ev = F.col("evaluation")
    return scored.groupBy("mode").agg(
        F.count(F.lit(1)).alias("runs"),
        stable_round(F.avg(ev["task_completion_score"]), 6).alias("task_score"),
        stable_round(F.avg(ev["decision_evaluation"]["decision_score"]), 6).alias(
            "decision_score"
        ),
        F.count_if("feedback.passed").alias("passed"),
    )


SCOREBOARD_SQL = f"""WITH {METRIC_BASE}, hourly AS (
      SELECT *, date_trunc('hour', ts) AS w FROM run_values)
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, * EXCLUDE (w)
    FROM ({suite('w, mode', 'hourly')})"""
ERROR_RATE_SQL = f"""WITH l AS (SELECT ts, {LEVEL_SQL} AS level FROM events),
    w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - i * INTERVAL 30 MINUTE AS s, level
      FROM l, (SELECT UNNEST([0, 1]) AS i))
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, COUNT(*) AS lines,
      COUNT(*) FILTER (WHERE level IN ('ERROR', 'CRITICAL')) AS errors,
      {rnd("COUNT(*) FILTER (WHERE level IN ('ERROR', 'CRITICAL')) / COUNT(*)::DOUBLE", 6)} AS error_rate
    FROM w GROUP BY s"""


@query("t2_stream_scoreboard_whole", SCOREBOARD_SQL)
@query("t2_stream_scoreboard", SCOREBOARD_SQL)
def scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of the table, open ones included, over several batches in time order."""
    runs = run_records(spark, sf_dir)
    files = files_per_batch(runs)
    path = in_time_order(spark, runs, "created_at", "runs", "parquet", BATCHES * files)
    stream = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", files).parquet(path)
    return all_windows(spark, T.stream_scoreboard(stream), ["window_start", "mode"], "scoreboard")


@query("t3_stream_upsert", UPSERT_SQL)
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newer and older versions arrive in several batches, every one of them twice."""
    history, new = versions(spark, sf_dir)
    path = scratch_path(spark, "history")
    save_buckets(history, path, 0, ["run_id"])
    arrivals = scratch_path(spark, "new-runs")
    for mode in ("overwrite", "append"):
        new.coalesce(2).write.mode(mode).parquet(arrivals)
    stream = spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
    T.stream_upsert(stream, path, scratch_path(spark, "history-state")).awaitTermination()
    return load_buckets(spark, path).select("run_id", "mode", "iterations")


@query("t4_stream_error_rate_whole", ERROR_RATE_SQL)
@query("t4_stream_error_rate", ERROR_RATE_SQL)
def error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of the table, open ones included, over several batches in time order."""
    logs = log_table(spark, sf_dir)
    files = files_per_batch(logs)
    path = in_time_order(spark, logs, "timestamp", "logs", "json", BATCHES * files)
    stream = stream_log_lines(spark, path, files_per_batch=files)
    return all_windows(spark, T.stream_error_rate(stream), ["window_start"], "error-rate")
