"""Files in the layouts that occur, written to a fresh folder per test."""

import json
import os

import pytest
from helpers import record
from pyspark.sql import functions as F

from runscore.operators import compare as C
from runscore.sources.datasets import DatasetSpec, read_dataset
from runscore.operators.metrics import run_history_row
from runscore.sources import named
from runscore.sources import runs as readers
from runscore.sources.batches import append_batch, committed_batches, read_batches
from runscore.sources.history import append_feedback, load_version, save_version, upsert_runs
from runscore.sources.named import file_names, write_named_files
from runscore.sources.runs import (
    latest_file,
    list_run_files,
    read_latest,
    read_runs,
    read_tasks,
    unreadable_files,
    write_runs,
    write_suite_files,
)
from runscore.sources.tables import BREAKDOWN_FILES, discover_tasks, read_metric_tables


def put(folder, name, content):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(
        content if isinstance(content, str) else json.dumps(content, indent=2), encoding="utf-8"
    )


def suite(*tasks, mode="baseline"):
    return {
        "run_id": "20260607_120000", "mode": mode, "task_count": len(tasks), "metrics": {"TCR": 1.0},
        "results": [
            record(run_id=f"r-{t}", mode=mode, metadata={"task_id": t, "n": 3},
                   execution={"status": "success"}, created_at="2026-06-07T11:11:19.123456+00:00")
            for t in tasks
        ],
    }


def test_three_layouts(spark, tmp_path):
    put(tmp_path, "benchmark_1.json", suite("a", "b"))
    put(tmp_path, "list.json", [record(run_id="l1"), record(run_id="l2")])
    put(tmp_path, "single.json", record(run_id="s1"))
    put(tmp_path, "other.json", {"something": 1})
    put(tmp_path, "broken.json", "{not json")
    rows = read_runs(spark, str(tmp_path)).collect()
    found = {(r["file_name"], r["position"]): r["run_id"] for r in rows}
    assert found == {
        ("benchmark_1.json", 0): "r-a", ("benchmark_1.json", 1): "r-b", ("list.json", 0): "l1",
        ("list.json", 1): "l2", ("single.json", 0): "s1",
    }
    first = next(r for r in rows if r["run_id"] == "r-a")
    assert first["metadata"] == {"task_id": "a", "n": "3"}
    assert first["created_at"].microsecond == 123456
    bad = {r["file_name"]: r["is_json"] for r in unreadable_files(spark, str(tmp_path)).collect()}
    assert bad == {"other.json": True, "broken.json": False}


def test_file_listing_and_latest_file(spark, tmp_path):
    put(tmp_path / "b", "benchmark_20260607_100000.json", suite("a", "b"))
    put(tmp_path / "b", "benchmark_20260607_110000.json", {"results": []})
    put(tmp_path / "b", "notes.json", record(run_id="n"))
    put(tmp_path / "f", "benchmark_20260607_120000.json", suite("c", mode="feedback_loop"))
    listed = list_run_files(spark, str(tmp_path / "b"), str(tmp_path / "f"))
    rows = {tuple(r) for r in listed.collect()}
    assert rows == {
        ("baseline", "20260607_100000", "benchmark_20260607_100000.json", "a"),
        ("baseline", "20260607_110000", "benchmark_20260607_110000.json", ""),
        ("feedback_loop", "20260607_120000", "benchmark_20260607_120000.json", "c"),
    }
    runs = read_runs(spark, str(tmp_path / "b"))
    # the newest suite is empty, which only a list of the files or the reader itself can see
    assert latest_file(runs, file_names(spark, str(tmp_path / "b"))).count() == 0
    assert read_latest(spark, str(tmp_path / "b")).count() == 0
    assert [r["run_id"] for r in read_latest(spark, str(tmp_path / "f"), mode="x").collect()] == ["r-c"]
    assert sorted(r["run_id"] for r in latest_file(runs).collect()) == ["r-a", "r-b"]
    put(tmp_path / "old", "one.json", record(run_id="o1"))
    put(tmp_path / "old", "two.json", [record(run_id="o2")])
    assert sorted(r["run_id"] for r in read_latest(spark, str(tmp_path / "old")).collect()) == ["o1", "o2"]
    legacy = latest_file(read_runs(spark, str(tmp_path / "b"), glob="notes.json"))
    assert [r["run_id"] for r in legacy.collect()] == ["n"]


def test_pairs_from_files(spark, tmp_path):
    put(tmp_path / "b", "benchmark_1.json", suite("task_001"))
    put(tmp_path / "b", "benchmark_2.json", suite("task_002", "task_003"))
    put(tmp_path / "f", "benchmark_1.json", suite("task_001", "task_003", mode="feedback_loop"))
    runs = read_runs(spark, [str(tmp_path / "b"), str(tmp_path / "f")])
    assert C.compare_final(runs).count() == 8
    assert {r["task_id"] for r in C.compare_pairs(runs).collect()} == {"task_001", "task_003"}
    parity = C.compare_pairs(runs, first_result_only=True)
    assert {r["task_id"] for r in parity.collect()} == {"task_001"}


def test_tasks_filter_before_limit(spark, tmp_path):
    tasks = [{"id": f"t{i}", "difficulty": "easy", "expected_outputs": ["png"]} for i in (3, 1, 2)]
    put(tmp_path, "tasks.json", tasks)
    path = str(tmp_path / "tasks.json")
    assert [r["id"] for r in read_tasks(spark, path, limit=2).collect()] == ["t3", "t1"]
    assert [r["id"] for r in read_tasks(spark, path, ["t1", "t2"], 1).collect()] == ["t1"]


def test_metric_tables(spark, tmp_path):
    put(tmp_path, "comparison_metrics_task_036.csv",
        "metric,baseline,feedback_loop,delta,improved\nTCR,0.0,1.0,1.0,True\nDQS,,bad,,False\n")
    put(tmp_path, "decision_breakdown_task_036.csv",
        "component,baseline,feedback_loop,delta,improved\nPreprocessing,7.5,5.5,-2.0,false\n")
    put(tmp_path, "comparison_report_task_040.md", "# report")
    rows = {r["metric"]: r for r in read_metric_tables(spark, str(tmp_path)).collect()}
    assert tuple(rows["TCR"]) == ("task_036", "TCR", 0.0, 1.0, 1.0, True)
    assert tuple(rows["DQS"]) == ("task_036", "DQS", None, None, None, False)
    parts = read_metric_tables(spark, str(tmp_path), BREAKDOWN_FILES).collect()
    assert [(r["metric"], r["delta"], r["improved"]) for r in parts] == [
        ("Preprocessing", -2.0, False)
    ]
    assert [r["task_id"] for r in discover_tasks(spark, str(tmp_path)).collect()] == [
        "task_036", "task_040",
    ]


def test_dataset_options(spark, tmp_path):
    put(tmp_path, "adult.csv", "39, Private, <=50K\n50, ?, >50K\n , x, y\n,,\n")
    spec = DatasetSpec(columns=("age", "work", "income"), trim=True, numbers={"age": "int"})
    rows = read_dataset(spark, str(tmp_path / "adult.csv"), spec).collect()
    assert [tuple(r) for r in rows][:2] == [(39, "Private", "<=50K"), (50, "?", ">50K")]
    with pytest.raises(ValueError, match="only"):
        read_dataset(spark, str(tmp_path / "adult.csv"), DatasetSpec(min_rows=50))


def test_versions_and_upsert(spark, tmp_path):
    old = spark.createDataFrame(
        [("a", "x", "2024-01-01"), ("b", "x", "2024-01-05")], "run_id string, v string, d string"
    ).withColumn("created_at", F.col("d").cast("timestamp"))
    new = spark.createDataFrame(
        [("a", "y", "2024-01-02"), ("b", "y", "2024-01-01"), ("c", "y", "2024-01-01")],
        "run_id string, v string, d string",
    ).withColumn("created_at", F.col("d").cast("timestamp"))
    save_version(upsert_runs(old, new), str(tmp_path), 1)
    rows = load_version(spark, str(tmp_path), 1).collect()
    assert {r["run_id"]: r["v"] for r in rows} == {"a": "y", "b": "x", "c": "y"}


def test_mode_is_a_partition(spark, tmp_path, sf):
    from runscore.plans.fixtures import run_records

    write_runs(run_records(spark, sf), str(tmp_path / "runs"))
    one = spark.read.parquet(str(tmp_path / "runs")).where("mode = 'baseline'").select("run_id")
    assert "PartitionFilters: [isnotnull(mode" in one._jdf.queryExecution().executedPlan().toString()


def test_entries_that_are_no_records(spark, tmp_path):
    put(tmp_path, "list.json", [1, "x", None, record(run_id="a"), [record(run_id="no")], record(run_id="b")])
    put(tmp_path, "keys.json", {"query": None, "dataset_path": None, "run_id": "k"})
    put(tmp_path, "results.json", {"results": "none", "query": "q", "dataset_path": "d", "run_id": "s"})
    put(tmp_path, "half.json", {"query": "q", "run_id": "no"})
    put(tmp_path, "types.json", [{"run_id": "t", "query": "q", "iterations": "three", "created_at": "yesterday", "metrics": {"a": 1, "b": "x"}}])
    found = {(r["file_name"], r["run_id"]): r for r in read_runs(spark, str(tmp_path)).collect()}
    assert set(found) == {
        ("list.json", "a"), ("list.json", "b"), ("keys.json", "k"), ("results.json", "s"), ("types.json", "t"),
    }
    assert found["list.json", "a"]["position"] == 0 and found["list.json", "b"]["position"] == 1
    odd = found["types.json", "t"]
    assert odd["iterations"] is None and odd["created_at"] is None and odd["metrics"] == {"a": 1.0, "b": None}


def test_documents_too_large_for_a_variant(spark):
    texts = [json.dumps(suite("a", "b")), json.dumps([record(run_id="l")]), "{no json", "[no json"]
    docs = spark.createDataFrame([(t,) for t in texts], "value string").withColumn("doc", F.lit(None).cast("variant"))
    ids = docs.select(F.transform(readers._records(), lambda r: F.variant_get(r, "$.run_id", "string")).alias("ids"))
    assert [r["ids"] or [] for r in ids.collect()] == [["r-a", "r-b"], ["l"], [], []]


def test_suites_come_back_as_they_were(spark, tmp_path):
    put(tmp_path / "in", "benchmark_1.json", suite("a", "b", "c"))
    put(tmp_path / "in", "benchmark_2.json", suite("d"))
    runs = read_runs(spark, str(tmp_path / "in"))
    assert write_suite_files(runs, str(tmp_path / "out")) == 2
    assert write_suite_files(runs, str(tmp_path / "bare"), bare=True) == 2
    wanted = {(r["file_name"], r["position"]): r.asDict() for r in runs.drop("file_path").collect()}
    for folder in ("out", "bare"):
        got = read_runs(spark, str(tmp_path / folder)).drop("file_path").collect()
        assert {(r["file_name"], r["position"]): r.asDict() for r in got} == wanted
    assert write_named_files(spark.createDataFrame([], "name string, value string"), str(tmp_path / "none")) == 0


def test_a_file_is_parsed_once(spark, tmp_path):
    put(tmp_path, "benchmark_1.json", suite("a"))
    plan = read_runs(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 3  # the file, and the entries of one too large in either layout
    assert "RebalancePartitions" in plan


def test_two_named_files(spark, tmp_path):
    for name, status, score in (("b.json", "failure", 0.2), ("f.json", "success", 0.9)):
        runs = [record(run_id=i, execution={"status": status}, evaluation={"task_completion_score": score}) for i in "xy"]
        put(tmp_path, name, runs)
    baseline, feedback = (read_runs(spark, str(tmp_path / n)) for n in ("b.json", "f.json"))
    rows = {r["metric"]: (r["baseline"], r["feedback_loop"], r["improved"]) for r in C.compare_two_files(baseline, feedback).collect()}
    assert rows["ESR"] == (0.0, 1.0, True) and rows["TCR"] == (0.0, 1.0, True) and len(rows) == 8
    assert C.breakdown_of_two_files(baseline, feedback).count() == 8
    with pytest.raises(ValueError, match="no run"):
        C.compare_two_files(baseline, feedback.where("false"))


def test_metric_columns_are_found_by_name(spark, tmp_path):
    put(tmp_path, "comparison_metrics_task_001.csv",
        "improved,delta,note,metric,component,feedback_loop,baseline\r\n"
        '1,0.5,"a, b",TCR,x,1.0,0.5\r\n\r\nTrue,,,,Preprocessing,7,\r\nno,0.25,,TCR,,0.75,0.5\r\n0,1,,,,2,3\r\n')
    put(tmp_path, "comparison_metrics_task_002.csv", "metric,baseline\nTCR,0.125\nESR\n")
    put(tmp_path, "comparison_metrics_task_003.csv", "")
    rows = {(r["task_id"], r["metric"]): tuple(r)[2:] for r in read_metric_tables(spark, str(tmp_path)).collect()}
    assert rows == {
        ("task_001", "TCR"): (0.5, 0.75, 0.25, False),  # the last row of a repeated metric
        ("task_001", "Preprocessing"): (None, 7.0, None, True),
        ("task_002", "TCR"): (0.125, None, None, False),
        ("task_002", "ESR"): (None, None, None, False),
    }


def test_an_append_survives_a_repeat(spark, tmp_path):
    path = str(tmp_path / "log")
    assert read_batches(spark, path) is None
    rows = spark.range(5)
    for _ in range(2):
        append_batch(rows, path, "one")
    append_batch(rows.selectExpr("id + 5 AS id"), path, "two")
    assert committed_batches(spark, path) == ["one", "two"]
    assert sorted(r["id"] for r in read_batches(spark, path).collect()) == list(range(10))
    # a batch whose write has not ended has no mark yet
    rows.write.parquet(f"{path}/batch=three")
    (tmp_path / "log" / "batch=three" / "_SUCCESS").unlink()
    assert read_batches(spark, path).count() == 10
    append_batch(rows, path, "three")
    assert read_batches(spark, path).count() == 15
    with pytest.raises(ValueError, match="batch name"):
        append_batch(rows, path, "../x")


def test_feedback_and_comparisons_are_appended_once(spark, tmp_path):
    put(tmp_path / "b", "benchmark_1.json", suite("t"))
    put(tmp_path / "f", "benchmark_1.json", suite("t", mode="feedback_loop"))
    runs = read_runs(spark, [str(tmp_path / "b"), str(tmp_path / "f")])
    for _ in range(2):
        C.log_comparisons(runs, str(tmp_path / "log"), "r1")
        append_feedback(runs.withColumn("feedback_history", F.from_json(F.lit('[{"iteration": 0, "score": 0.5}]'), "array<struct<iteration:int,score:double,passed:boolean,items:array<struct<category:string,severity:string,message:string,recommendation:string>>,summary:string,qualification_score:double,qualified:boolean,decision_score:double,decision_summary:string,decision_recommendations:array<string>>>")), str(tmp_path / "rounds"), "r1")
    assert read_batches(spark, str(tmp_path / "log")).count() == 1
    assert read_batches(spark, str(tmp_path / "rounds")).count() == 2


def test_payload_keeps_every_value(spark, tmp_path):
    put(tmp_path, "benchmark_1.json", suite("t"))
    row = run_history_row(read_runs(spark, str(tmp_path))).first()
    payload = json.loads(row["payload"])
    assert payload["task_id"] == "t" and payload["score"] is None and payload["execution_success"] == 1
    assert set(payload) == set(row.asDict()) - {"run_id", "mode", "created_at", "payload"}


def test_named_files_are_written_by_tasks_under_their_names(spark, tmp_path, monkeypatch):
    def no_scratch(*_):
        raise AssertionError("the driver moves files")

    folder = str(tmp_path / "named")
    spark.createDataFrame([("old",)], "value string").coalesce(1).write.text(folder)
    (old,) = [f for f in os.listdir(folder) if f.startswith("part-")]  # with a checksum beside it
    monkeypatch.setattr("runscore.sources.named.scratch_path", no_scratch)
    rows = [(old, "new"), ("a b#%.json", "x\ny"), ("twice.json", "1"), ("twice.json", "1"), ("é.json", None), (None, "n")]
    assert write_named_files(spark.createDataFrame(rows, "name string, value string").repartition(3), folder) == 5
    listed = sorted(f for f in os.listdir(folder) if not f.startswith((".", "_SUCCESS")))
    assert listed == sorted([old, "a b#%.json", "twice.json", "é.json", "__HIVE_DEFAULT_PARTITION__"])
    assert {f: (tmp_path / "named" / f).read_text(encoding="utf-8") for f in listed} == {
        old: "new\n", "a b#%.json": "x\ny\n", "twice.json": "1\n1\n", "é.json": "\n", "__HIVE_DEFAULT_PARTITION__": "n\n",
    }
    assert [r["value"] for r in spark.read.text(f"{folder}/{old}").collect()] == ["new"]
    assert not [f for f in os.listdir(folder) if f.startswith("._") and "SUCCESS" not in f]


def test_named_files_are_moved_where_tasks_cannot_write_them(spark, tmp_path):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(tmp_path / "moved"))
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    rows = spark.createDataFrame([(f"n{i}.json", str(i)) for i in range(40)], "name string, value string")
    assert named._write_and_move(rows, folder, store) == 40
    assert (tmp_path / "moved" / "n7.json").read_text() == "7\n" and file_names(spark, str(tmp_path / "moved")).count() == 40
