"""Streams write every window, over several batches."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from runscore.plans import stream_queries as Q
from runscore.sources import history
from runscore.sources.history import (
    BUCKETS,
    bucket_versions,
    drop_superseded,
    load_buckets,
    save_buckets,
    upsert_runs,
)
from runscore.sources.tables import stream_log_lines
from runscore.streaming import streams as T


def test_open_windows_are_written_over_several_batches(spark, tmp_path):
    start = datetime(2026, 1, 1)
    rows = [(start + timedelta(minutes=7 * i), ("INFO", "ERROR")[i % 3 == 0], "l", "m", None) for i in range(80)]
    table = spark.createDataFrame(
        rows, "timestamp timestamp, level string, logger string, message string, data map<string,string>"
    )
    path = Q.in_time_order(spark, table.repartition(3), "timestamp", "ordered", "json")
    windows = T.stream_error_rate(stream_log_lines(spark, path, files_per_batch=1))
    job = T.stream_windows(windows, ["window_start"], str(tmp_path / "w"), str(tmp_path / "state"))
    job.awaitTermination()
    seen = [p["batchId"] for p in job.recentProgress if p["numInputRows"] > 0]
    assert len(set(seen)) == 4
    got = {r["window_start"]: (r["lines"], r["errors"]) for r in load_buckets(spark, str(tmp_path / "w")).collect()}
    wanted = {}
    for at, level, *_ in rows:
        half = at.replace(minute=at.minute // 30 * 30)
        for begin in (half, half - timedelta(minutes=30)):
            lines, errors = wanted.get(begin, (0, 0))
            wanted[begin] = (lines + 1, errors + (level == "ERROR"))
    assert got == wanted


RUN = "run_id string, mode string, iterations int, created_at timestamp"
START = datetime(2026, 1, 1)


def run_rows(spark, ids, hours=0, iterations=1):
    rows = [(f"run-{i}", "baseline", iterations, START + timedelta(hours=hours)) for i in ids]
    return spark.createDataFrame(rows, RUN).coalesce(1)


def arrive(spark, folder, frame):
    frame.write.mode("append").parquet(str(folder))
    return spark.readStream.schema(RUN).option("maxFilesPerTrigger", 1).parquet(str(folder))


def state(spark, path):
    return {r["run_id"]: r["iterations"] for r in load_buckets(spark, str(path)).collect()}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    ids = range(5000)
    save_buckets(run_rows(spark, ids), str(tmp_path / "h"), 0, ["run_id"])
    assert len(bucket_versions(spark, str(tmp_path / "h"))) == BUCKETS
    few = [7, 1234]
    stream = arrive(spark, tmp_path / "in", run_rows(spark, few, hours=1, iterations=9))
    T.stream_upsert(stream, str(tmp_path / "h"), str(tmp_path / "s")).awaitTermination()
    versions = bucket_versions(spark, str(tmp_path / "h"))
    rewritten = [b for b, v in versions.items() if v != [0]]
    assert 1 <= len(rewritten) <= len(few) and all(versions[b] == [0, 1] for b in rewritten)
    assert state(spark, tmp_path / "h") == {f"run-{i}": 9 if i in few else 1 for i in ids}
    assert load_buckets(spark, str(tmp_path / "h"), upto=0).where("iterations = 9").count() == 0
    assert drop_superseded(spark, str(tmp_path / "h"), 1) == len(rewritten)
    assert state(spark, tmp_path / "h") == {f"run-{i}": 9 if i in few else 1 for i in ids}


def test_late_rows_and_older_versions(spark, tmp_path):
    arrive(spark, tmp_path / "in", run_rows(spark, [1, 2], hours=100, iterations=5))
    arrive(spark, tmp_path / "in", run_rows(spark, [2, 3], hours=-100, iterations=4))
    stream = arrive(spark, tmp_path / "in", run_rows(spark, [1], hours=200, iterations=6))
    T.stream_upsert(stream, str(tmp_path / "h"), str(tmp_path / "s")).awaitTermination()
    # a late first version is kept, a late older version does not replace a newer one
    assert state(spark, tmp_path / "h") == {"run-1": 6, "run-2": 5, "run-3": 4}


def test_repeats_rewrite_nothing(spark, tmp_path):
    rows = run_rows(spark, range(300))
    stream = arrive(spark, tmp_path / "in", rows.union(rows).coalesce(1))
    T.stream_upsert(stream, str(tmp_path / "h"), str(tmp_path / "s")).awaitTermination()
    before = bucket_versions(spark, str(tmp_path / "h"))
    stream = arrive(spark, tmp_path / "in", rows)
    T.stream_upsert(stream, str(tmp_path / "h"), str(tmp_path / "s")).awaitTermination()
    assert bucket_versions(spark, str(tmp_path / "h")) == before
    assert state(spark, tmp_path / "h") == {f"run-{i}": 1 for i in range(300)}


def test_repeats_within_the_watermark_do_not_reach_the_batch(spark, tmp_path):
    rows = run_rows(spark, range(20), hours=5)
    arrive(spark, tmp_path / "in", rows)
    stream = arrive(spark, tmp_path / "in", rows.union(run_rows(spark, [99], hours=6)).coalesce(1))
    kept = T.without_repeats(stream, ["run_id", "created_at"], "2 hours")
    query = (
        kept.writeStream.format("memory").queryName("kept").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "s0")).start()
    )
    query.awaitTermination()
    assert spark.table("kept").count() == 21
    T.stream_upsert(stream, str(tmp_path / "h"), str(tmp_path / "s"), "2 hours").awaitTermination()
    assert len(state(spark, tmp_path / "h")) == 21


@pytest.mark.parametrize("fail_before_write", [True, False])
def test_a_failed_batch_is_repeated(spark, tmp_path, monkeypatch, fail_before_write):
    save_buckets(run_rows(spark, range(50)), str(tmp_path / "h"), 0, ["run_id"])
    arrive(spark, tmp_path / "in", run_rows(spark, range(40, 60), hours=1, iterations=2))
    stream = arrive(spark, tmp_path / "in", run_rows(spark, range(55, 70), hours=2, iterations=3))
    write, calls = history.save_buckets, []

    def failing(*args, **options):
        calls.append(1)
        if not fail_before_write:
            write(*args, **options)
        if len(calls) == 2:
            raise RuntimeError("lost")
        if fail_before_write:
            write(*args, **options)

    monkeypatch.setattr(history, "save_buckets", failing)
    with pytest.raises(StreamingQueryException):
        T.stream_upsert(stream, str(tmp_path / "h"), str(tmp_path / "s")).awaitTermination()
    monkeypatch.setattr(history, "save_buckets", write)
    T.stream_upsert(stream, str(tmp_path / "h"), str(tmp_path / "s")).awaitTermination()
    wanted = {f"run-{i}": 1 for i in range(40)} | {f"run-{i}": 2 for i in range(40, 55)}
    assert state(spark, tmp_path / "h") == wanted | {f"run-{i}": 3 for i in range(55, 70)}


def test_bucketed_upsert_equals_the_plain_one(spark, tmp_path):
    old, new = run_rows(spark, range(100), hours=3), run_rows(spark, range(50, 150), hours=2, iterations=7)
    save_buckets(old, str(tmp_path / "h"), 0, ["run_id"])
    stream = arrive(spark, tmp_path / "in", new)
    T.stream_upsert(stream, str(tmp_path / "h"), str(tmp_path / "s")).awaitTermination()
    assert state(spark, tmp_path / "h") == {r["run_id"]: r["iterations"] for r in upsert_runs(old, new).collect()}


def test_rows_later_than_the_watermark_are_dropped_from_windows(spark, tmp_path):
    kind = "timestamp timestamp, level string, logger string, message string, data map<string,string>"

    def lines(hours):
        return spark.createDataFrame([(START + timedelta(hours=h), "INFO", "l", "m", None) for h in hours], kind).coalesce(1)

    for hours in ([0, 1], [10], [0, 9]):
        lines(hours).write.mode("append").json(str(tmp_path / "in"))
        stream = stream_log_lines(spark, str(tmp_path / "in"), files_per_batch=1)
        windows = T.stream_error_rate(stream, size="1 hour", slide="1 hour", delay="2 hours")
        T.stream_windows(windows, ["window_start"], str(tmp_path / "w"), str(tmp_path / "s")).awaitTermination()
    got = {r["window_start"]: r["lines"] for r in load_buckets(spark, str(tmp_path / "w")).collect()}
    # the line of hour 0 in the last batch is ten hours late, that of hour 9 one hour
    assert got == {START + timedelta(hours=h): 1 for h in (0, 1, 9, 10)}


def test_state_of_nothing(spark, tmp_path):
    assert load_buckets(spark, str(tmp_path / "none")) is None
    assert bucket_versions(spark, str(tmp_path / "none")) == {}


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    from runscore import runtime

    monkeypatch.setattr(runtime, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(Q, "ROWS_PER_TASK", 100)
    table = spark.range(0, 5_000, 1, 8)
    spread = runtime.spread_rows(table)
    sizes = [n for (n,) in spread.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert spread.rdd.getNumPartitions() == 50 and max(sizes) < 150 and sum(sizes) == 5_000
    assert runtime.spread_rows(spark.range(0, 50, 1, 8)).rdd.getNumPartitions() == 8
    assert Q.files_per_batch(table) == 13 and Q.files_per_batch(table.limit(0)) == 1


def test_a_batch_of_scored_runs_has_a_file_for_every_core(spark, sf):
    stream = Q.run_records(spark, sf, Q.BATCHES)
    assert stream.rdd.getNumPartitions() >= Q.BATCHES * spark.sparkContext.defaultParallelism


def test_a_task_takes_fifty_thousand_rows(spark):
    from runscore import runtime

    spread = runtime.spread_rows(spark.range(0, 600_000, 1, 2))
    sizes = [n for (n,) in spread.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 55_000 and sum(sizes) == 600_000
