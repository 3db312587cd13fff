"""Metric tables, log lines and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runscore.schemas import LOG_DDL

METRIC_FILES = "comparison_metrics_task_*.csv"
MOST_FIELDS = 32  # columns of a metric table that are looked at
BREAKDOWN_FILES = "decision_breakdown_task_*.csv"
_TASK_IN_NAME = r"^(?:comparison_metrics|decision_breakdown|comparison_report)_(task_.*)\.[a-z]+$"


def read_metric_tables(spark: SparkSession, path: str, glob: str = METRIC_FILES) -> DataFrame:
    """task_id, metric, baseline, feedback, delta, improved from CSV tables.

    Columns are found by the names in each file's own header, in any order; the
    key column is metric or, where that is absent or empty, component. Text
    that is not a number becomes null. Of rows with equal keys in a file the
    last one counts. A table is small, so a file is one text.
    """
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    lines = F.filter(F.split("value", r"\r\n|\n|\r"), lambda line: line != "")
    tables = files.select(
        F.col("_metadata.file_name").alias("file_name"),
        F.regexp_extract(F.col("_metadata.file_name"), _TASK_IN_NAME, 1).alias("task_id"),
        lines.alias("lines"),
    )
    rows = tables.select(
        "file_name",
        "task_id",
        _csv_fields(F.get("lines", F.lit(0))).alias("header"),
        F.posexplode("lines").alias("place", "line"),
    ).where(F.col("place") > 0)
    named = rows.select("file_name", "task_id", "place", "header", _csv_fields(F.col("line")).alias("fields"))

    def field(name: str) -> Column:
        return F.get("fields", F.array_position("header", F.lit(name)).cast("int") - 1)

    def number(name: str, source: str) -> Column:
        return field(source).try_cast("double").alias(name)

    key = F.coalesce(F.nullif(field("metric"), F.lit("")), F.nullif(field("component"), F.lit("")))
    found = named.select(
        "file_name",
        "task_id",
        key.alias("metric"),
        F.struct(
            "place",
            number("baseline", "baseline"),
            number("feedback", "feedback_loop"),
            number("delta", "delta"),
            F.coalesce(field("improved").isin("True", "true", "1"), F.lit(False)).alias("improved"),
        ).alias("row"),
    ).where(F.col("metric").isNotNull())
    last = found.groupBy("file_name", "task_id", "metric").agg(F.max("row").alias("row"))
    return last.select("task_id", "metric", "row.baseline", "row.feedback", "row.delta", "row.improved")


def _csv_fields(line: Column) -> Column:
    """Fields of a CSV line as an array, nulls for those it does not have."""
    wide = F.from_csv(line, ", ".join(f"c{i} string" for i in range(MOST_FIELDS)))
    return F.array(*[wide[f"c{i}"] for i in range(MOST_FIELDS)])


def discover_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Sorted distinct task ids that have a metric table or a report file."""
    names = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "comparison_*_task_*")
        .load(path)
        .select(F.element_at(F.split("path", "/"), -1).alias("name"))
        .where(F.col("name").rlike(r"^comparison_metrics_.*\.csv$|^comparison_report_.*\.md$"))
    )
    ids = names.select(F.regexp_extract("name", _TASK_IN_NAME, 1).alias("task_id"))
    return ids.distinct().orderBy("task_id")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines logs of a known schema."""
    return spark.read.schema(LOG_DDL).json(path)


def stream_log_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LOG_DDL)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def write_table(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV export with a header (action)."""
    table.write.mode(mode).option("header", True).csv(path)
