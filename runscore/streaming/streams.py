"""Streams of run records and log lines.

The transformations are the batch operators; only the event-time windows and
the sinks are specific to streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runscore.functions.rounding import stable_round
from runscore.operators.metrics import finish_suite, suite_aggregates
from runscore.operators.scoring import evaluate_runs
from runscore.sources.history import change_buckets, replace_rows, upsert_runs


def stream_scored_runs(runs: DataFrame, **options) -> DataFrame:
    """Score arriving records; stateless, so identical to the batch result."""
    return evaluate_runs(runs, **options)


def stream_scoreboard(
    runs: DataFrame, *, window: str = "1 hour", delay: str = "2 hours", event_time: str = "created_at"
) -> DataFrame:
    """Suite metrics per condition and tumbling window.

    In append mode a window is emitted once the watermark has passed its end;
    rows later than that are dropped.
    """
    grouped = (
        runs.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, window).alias("w"), "mode")
        .agg(*suite_aggregates())
        .withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")})
    )
    return finish_suite(grouped, ["window_start", "window_end", "mode"])


def stream_error_rate(
    logs: DataFrame,
    *,
    size: str = "1 hour",
    slide: str = "30 minutes",
    delay: str = "1 hour",
    event_time: str = "timestamp",
) -> DataFrame:
    """Log lines, errors and error share per sliding window."""
    is_error = F.col("level").isin("ERROR", "CRITICAL")
    return (
        logs.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, size, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("lines"), F.count_if(is_error).alias("errors"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "lines",
            "errors",
            stable_round(F.col("errors") / F.col("lines"), 6).alias("error_rate"),
        )
    )


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything available into Parquet, append mode, then stop."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_windows(windows: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Keep every window seen so far in a bucketed table, open ones included.

    Update mode: a batch brings the present state of the windows it touched,
    which replaces their rows; buckets without such a window are not rewritten.
    Batch n writes version n + 1 from the state before it, so a batch that is
    repeated after a failure gives the same result. Windows need not close to
    be written; the watermark only bounds the state, and rows later than it are
    dropped as in any stream. Read the result with ``load_buckets``.
    """

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        # update mode brings changed windows only, each once
        change_buckets(
            batch, path, batch_id + 1, keys, lambda state, new: replace_rows(state, new, keys), repeats=False
        )

    return (
        windows.writeStream.outputMode("update")
        .foreachBatch(apply_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def without_repeats(
    rows: DataFrame, keys: list[str], within: str, event_time: str = "created_at"
) -> DataFrame:
    """Drop rows whose keys came before, within a delay of the event time.

    The state holds the keys of that delay. Rows later than it are dropped too.
    """
    return rows.withWatermark(event_time, within).dropDuplicatesWithinWatermark(keys)


def stream_upsert(
    runs: DataFrame, path: str, checkpoint: str, repeats_within: str | None = None
) -> StreamingQuery:
    """Insert-or-replace arriving runs into a bucketed history.

    Batch n writes version n + 1 of the buckets its runs fall in, from the state
    before it; a batch repeated after a failure has the same result as one run.
    Rows that are stored already are dropped without rewriting their bucket, and
    late rows are merged like any others. ``repeats_within`` drops repeats of
    (run_id, created_at) in the stream as well, ahead of any read of the
    history, and with them rows later than that delay. Version 0 may hold an
    earlier history (see ``save_buckets``, key run_id).
    """
    if repeats_within is not None:
        runs = without_repeats(runs, ["run_id", "created_at"], repeats_within)

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        change_buckets(batch, path, batch_id + 1, ["run_id"], upsert_runs)

    return (
        runs.writeStream.foreachBatch(apply_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
