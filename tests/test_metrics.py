"""Reliability metrics, pairing and summaries."""

import pytest
from helpers import evaluation, execution, frame, record, rounds
from pyspark.sql import functions as F

from runscore.operators import compare as C
from runscore.operators import summary as R
from runscore.operators.iterations import feedback_digest
from runscore.operators.metrics import run_metrics, suite_metrics
from runscore.plans.compare_queries import with_task_meta
from runscore.plans.fixtures import run_records


def test_empty_suite_is_zero(spark):
    row = suite_metrics(frame(spark, record()).where("false")).first()
    assert row["TCR"] == 0.0 and row["ORS"] == 0.0 and row["total_tasks"] == 0


def test_improvement_of_last_two_rounds(spark):
    row = suite_metrics(
        frame(spark, record(execution=execution(), feedback_history=rounds(0.5, 0.8)))
    ).first()
    assert row["FIS"] == pytest.approx(0.3)
    assert row["TCR"] == 1.0 and row["ESR"] == 1.0


@pytest.mark.parametrize(
    ("components", "da", "dqs", "bas"),
    [
        ([8, 7.5, 5, 6.5, 4, 7, 3.5, 6], 0.6083, 59.25, 35.0),
        ([7, 5.5, 7, 9, 6, 6, 4.5, 6], 0.6333, 66.25, 45.0),
        ([8, 8, 6, 5.5, 7, 7, 7.5, 6], 0.7167, 68.0, 75.0),
        ([8, 8, 8, 5.5, 7, 7, 7.5, 7.5], 0.7167, 71.75, 75.0),
    ],
)
def test_published_component_scores(spark, components, da, dqs, bas):
    row = run_metrics(frame(spark, record(evaluation=evaluation(0.8, components)))).first()
    assert (row["da"], row["dqs"], row["bas"]) == (
        pytest.approx(da, abs=1e-4), pytest.approx(dqs), pytest.approx(bas),
    )


def test_decision_accuracy_vector(spark):
    row = run_metrics(
        frame(spark, record(evaluation=evaluation(0.2, [8, 8, 7, 6, 10, 8, 6, 7])))
    ).first()
    assert row["da"] == pytest.approx(0.767, abs=1e-3)


def pair(spark):
    """The published pair of the largest overall gain."""
    return frame(
        spark,
        record(
            run_id="b", metadata={"task_id": "t"}, execution=execution("failure"),
            evaluation=evaluation(0.6, [8, 7.5, 5, 6.5, 4, 7, 3.5, 6]),
        ),
        record(
            run_id="f", mode="feedback_loop", metadata={"task_id": "t"}, execution=execution(),
            evaluation=evaluation(0.9, [7, 5.5, 7, 9, 6, 6, 4.5, 6]),
        ),
        record(run_id="x", metadata={"task_id": "alone"}, execution=execution()),
    ).withColumn("file_name", F.lit("benchmark_1.json"))


def test_published_pair(spark):
    table = {r["metric"]: r for r in C.compare_pairs(pair(spark)).collect()}
    assert len(table) == 8
    assert table["ORS"]["baseline"] == pytest.approx(29.27, abs=1e-2)
    assert table["ORS"]["feedback_loop"] == pytest.approx(62.67, abs=1e-2)
    assert table["ORS"]["delta"] == pytest.approx(33.4, abs=1e-2) and table["ORS"]["improved"]
    assert C.compare_final(pair(spark)).count() == 8
    assert [r["task_id"] for r in C.unpaired(pair(spark)).collect()] == ["alone"]


def test_published_impact_lists(spark):
    breakdown = C.decision_breakdown(pair(spark))
    lists = C.impact_lists(breakdown).first()
    assert lists["neutral"] == ["Explainability"]
    assert lists["negative"] == ["Data Understanding", "Preprocessing", "Statistical Validity"]
    ends = C.breakdown_extremes(breakdown).first()
    assert (ends["highest_component"], ends["highest_score"]) == ("Model Selection", 9.0)
    assert (ends["lowest_component"], ends["lowest_score"]) == ("Business Alignment", 4.5)
    assert (ends["gain_component"], ends["loss_component"]) == ("Model Selection", "Preprocessing")


def test_latest_file_wins(spark):
    runs = frame(
        spark,
        record(run_id="r1", metadata={"task_id": "a"}),
        record(run_id="r2", metadata={"task_id": "a"}),
        record(run_id="r3", metadata={"task_id": "b"}),
    ).withColumns({"file_name": F.concat(F.lit("benchmark_"), "run_id"), "position": F.lit(0)})
    kept = {r["task_id"]: r["run_id"] for r in C.latest_per_task(runs).collect()}
    assert kept == {"a": "r2", "b": "r3"}
    assert C.latest_per_task(runs, task_id="none").count() == 0


def test_hot_task_is_limited_before_the_shuffle(spark, sf):
    plan = C.latest_per_task(run_records(spark, sf))._jdf.queryExecution().executedPlan().toString()
    # the plan lists the last step first: limit, exchange by key, limit
    final, first = plan.index("WindowGroupLimit"), plan.rindex("WindowGroupLimit")
    assert final < plan.index("Exchange hashpartitioning") < first


def test_suite_needs_one_exchange(spark, sf):
    plan = suite_metrics(run_records(spark, sf), ["mode"])._jdf.queryExecution().executedPlan()
    assert plan.toString().count("Exchange hashpartitioning") == 1


def test_catalogue_is_broadcast_when_small(spark, sf):
    rows = with_task_meta(spark, sf)
    rows.collect()
    assert "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString()


def test_digest_text(spark):
    history = rounds(0.5)
    history[0].update(
        summary="weak",
        items=[{"category": "metrics", "severity": "high", "message": "no f1",
                "recommendation": "print f1"}],
        decision_score=61.25, decision_summary="fair", decision_recommendations=["compare"],
    )
    text = frame(spark, record(feedback_history=history)).select(feedback_digest()).first()[0]
    assert text.split("\n") == [
        "Iteration 0 (score=0.50): weak",
        "  - Decision score: 61.3/100",
        "  - Decision summary: fair",
        "  - [high] metrics: no f1",
        "    Recommendation: print f1",
        "  - Decision recommendations:",
        "    * compare",
    ]
    empty = frame(spark, record(feedback_history=[])).select(feedback_digest()).first()[0]
    assert empty == "No prior feedback."


def test_published_rankings(spark):
    """Tasks with published deltas; the rest of the tasks have none."""
    ors = {"task_026": 0.32, "task_027": 16.89, "task_029": 8.9, "task_030": -5.85,
           "task_032": 19.37, "task_034": 23.1, "task_036": 33.4, "task_040": 7.78,
           "task_042": 8.42}
    fis = {"task_029": 0.54, "task_034": 0.54, "task_040": 0.54, "task_042": 0.54,
           "task_030": -0.44}
    rows = [(t, "ORS", 0.0, d, d, d > 0) for t, d in ors.items()]
    rows += [(t, "FIS", 0.0, fis.get(t, 0.0), fis.get(t, 0.0), t in fis) for t in ors]
    rows += [("task_014", "ORS", None, None, None, None), ("task_014", "FIS", 0.0, 0.0, 0.0, False)]
    pairs = spark.createDataFrame(
        rows, "task_id string, metric string, baseline double, feedback double, delta double, "
        "improved boolean",
    )
    best = R.top_improvements(pairs).orderBy("metric", "position").collect()
    assert [r["task_id"] for r in best if r["metric"] == "ORS"] == [
        "task_036", "task_034", "task_032", "task_027", "task_029",
    ]
    assert [r["task_id"] for r in best if r["metric"] == "FIS"] == [
        "task_029", "task_034", "task_040", "task_042", "task_014",
    ]
    board = [r["task_id"] for r in R.leaderboard(pairs).collect()]
    assert board[0] == "task_036" and board[-2:] == ["task_014", "task_030"]
    cases = {r["category"]: r["task_id"] for r in R.case_studies(pairs).collect()}
    assert cases["highest_ors_improvement"] == "task_036"
    assert cases["largest_degradation"] == "task_030"


def test_first_run_of_a_file_and_newest_suite_file(spark):
    done, failed = {"status": "success"}, {"status": "failure"}
    runs = frame(
        spark,
        record(run_id="r0", metadata={"task_id": "a"}, execution=done),
        record(run_id="r3", metadata={"task_id": "a"}, execution=failed),
        record(run_id="r1", metadata={"task_id": "a"}, execution=failed),
    )
    place = {"r0": ("benchmark_1.json", 0), "r3": ("benchmark_1.json", 1), "r1": ("run_z.json", 0)}
    for column, at in (("file_name", 0), ("position", 1)):
        choice = F.create_map(*[F.lit(x) for k, v in place.items() for x in (k, v[at])])
        runs = runs.withColumn(column, choice[F.col("run_id")])
    suite_only = runs.where("file_name = 'benchmark_1.json'")
    assert [r["run_id"] for r in C.latest_per_task(suite_only).collect()] == ["r0"]
    esr = C.compare_latest(runs).where("metric = 'ESR'").first()
    assert esr["baseline"] == 0.5
