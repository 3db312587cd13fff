"""Feedback rounds and reliability metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runscore.operators import iterations as I
from runscore.operators import metrics as M
from runscore.plans.fixtures import catalogue, round_rows, run_records
from runscore.plans.oracle import AGENT_CTE, CATALOGUE_CTE, METRIC_BASE, ORS, ROUND_CTE, rnd, suite
from runscore.plans.registry import query
from runscore.schemas import METRICS

WITH = f"WITH {METRIC_BASE}\n"
ROUNDS = f"WITH {AGENT_CTE},\n{ROUND_CTE}\n"


# --- rounds -----------------------------------------------------------------
@query(
    "i1_latest_feedback",
    f"""{WITH} SELECT run_id, CASE WHEN event_id % 7 <> 0 THEN rounds - 1 END AS iteration,
      CASE WHEN event_id % 7 <> 0 THEN
        ((user_id * 13 + event_id * 7 + (rounds - 1) * 29) % 1001) / 1000.0::DOUBLE END AS score
    FROM records""",
)
def latest_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = run_records(spark, sf_dir).select("run_id", I.latest_feedback().alias("fb"))
    return last.select("run_id", F.col("fb.iteration").cast("long").alias("iteration"), "fb.score")


@query("i2_feedback_improvement", f"{WITH} SELECT run_id, fis AS improvement FROM records")
def improvement_from_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_records(spark, sf_dir).select(
        "run_id", I.feedback_improvement().alias("improvement")
    )


@query(
    "i2_round_improvement",
    f"""{ROUNDS} SELECT run_id, {rnd('COALESCE(score - previous, 0.0)', 4)} AS improvement FROM (
      SELECT run_id, iteration, score,
        LAG(score) OVER (PARTITION BY run_id ORDER BY iteration) AS previous,
        MAX(iteration) OVER (PARTITION BY run_id) AS last FROM round_rows)
    WHERE iteration = last""",
)
def improvement_from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.round_improvement(round_rows(spark, sf_dir))


@query(
    "i3_recovered",
    f"""{ROUNDS} SELECT run_id, BOOL_OR(failed_before AND NOT failed) AS recovered FROM (
      SELECT run_id, failed, COALESCE(MAX(CAST(failed AS INTEGER)) OVER (
        PARTITION BY run_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1
        AS failed_before FROM round_rows)
    GROUP BY run_id""",
)
def recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.recovered(round_rows(spark, sf_dir))


@query(
    "i4_effective_rounds",
    f"""{ROUNDS} SELECT run_id, iteration, score, passed FROM (
      SELECT *, COALESCE(MAX(CAST(passed AS INTEGER)) OVER (PARTITION BY run_id ORDER BY iteration
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed_before,
        ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY iteration) AS rn FROM round_rows)
    WHERE passed_before = 0 AND rn <= 2""",
)
def effective_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = I.effective_rounds(round_rows(spark, sf_dir), max_rounds=2)
    return kept.select("run_id", F.col("iteration").cast("long").alias("iteration"), "score", "passed")




@query("i5_feedback_digest")
def feedback_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_records(spark, sf_dir).select("run_id", I.feedback_digest().alias("digest"))


@query(
    "i6_gap_trend",
    f"""{WITH} SELECT run_id, CASE WHEN event_id % 7 = 0 THEN 0
      ELSE (event_id + rounds - 1) % 3 END AS gaps FROM records""",
)
def gap_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_records(spark, sf_dir).select("run_id", I.gap_trend().cast("long").alias("gaps"))


# --- metrics ----------------------------------------------------------------
_RUN_ORS = rnd(rnd(ORS, 4) + " * 100", 4)


@query(
    "a1_run_metrics",
    f"""{WITH} SELECT run_id, tcr, esr, da, fis, dqs, bas, {_RUN_ORS} AS ors FROM (
      SELECT run_id, COALESCE({rnd('score', 4)}, 0.0::DOUBLE) AS tcr,
        CASE WHEN status = 'success' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS esr, CAST(da AS DOUBLE) AS da, fis,
        COALESCE(dqs_c, 0.0::DOUBLE) AS dqs, COALESCE(bas_c, 0.0::DOUBLE) AS bas FROM run_values)""",
)
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.run_metrics(run_records(spark, sf_dir)).select(
        "run_id", "tcr", "esr", "da", "fis", "dqs", "bas", "ors"
    )


def single_metric(name: str, metric: str) -> None:
    """One suite metric per task and condition."""

    @query(name, f'{WITH} SELECT task_id, mode, "{metric}" FROM ({suite("task_id, mode")})')
    def job(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = M.suite_metrics(run_records(spark, sf_dir), ["task_id", "mode"])
        return table.select("task_id", "mode", metric)


for _name, _metric in [
    ("a2_tcr", "TCR"), ("a3_esr", "ESR"), ("a4_rr", "RR"), ("a5_fis", "FIS"), ("a6_da", "DA"),
    ("a7_dqs", "DQS"), ("a7_bas", "BAS"), ("a8_ors", "ORS"),
]:
    single_metric(_name, _metric)


@query(
    "a4_rr_initial_failures",
    f"""{WITH} SELECT mode, {rnd('''COALESCE(COUNT(*) FILTER (WHERE first_failed AND recovered)
        / NULLIF(COUNT(*) FILTER (WHERE first_failed), 0)::DOUBLE, 0)''', 4)} AS "RR"
    FROM (SELECT *, event_id % 7 <> 0 AND (user_id * 13 + event_id * 7) % 1001 < 750 AS first_failed
          FROM records) GROUP BY mode""",
)
def recovery_of_first_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = M.suite_metrics(run_records(spark, sf_dir), ["mode"], initial_failures=True)
    return table.select("mode", "RR")


@query("a9_suite_scoreboard", f"{WITH} {suite('mode')}")
def suite_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.suite_metrics(run_records(spark, sf_dir), ["mode"])


@query("a9_suite_total", f"{WITH} {suite('')}")
def suite_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.suite_metrics(run_records(spark, sf_dir))


def _rollup_sql() -> str:
    source = (
        "(SELECT r.*, COALESCE(c.dataset, '') AS dataset, COALESCE(c.difficulty, '') AS difficulty "
        "FROM run_values r LEFT JOIN catalogue c USING (task_id))"
    )
    keys = ["mode", "dataset", "difficulty"]
    parts = []
    for n in range(4):
        inner = suite(", ".join(keys[:n]), source)
        columns = [*keys[:n], *[f"NULL AS {k}" for k in keys[n:]]]
        named = ", ".join(f'"{m}"' for m in METRICS)
        parts.append(
            f"SELECT {', '.join(columns)}, {3 - n} AS level, {named}, total_tasks, completed_tasks "
            f"FROM ({inner})"
        )
    return " UNION ALL ".join(parts)


@query("a9_suite_rollup", f"WITH {METRIC_BASE},\n{CATALOGUE_CTE}\n{_rollup_sql()}")
def suite_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runscore.operators.compare import with_task_meta

    runs = with_task_meta(run_records(spark, sf_dir), catalogue(spark, sf_dir))
    return M.suite_metrics(runs, ["mode", "dataset", "difficulty"], rollup=True)


@query(
    "a10_run_history",
    f"""{WITH} SELECT run_id, mode, task_id,
      CAST(COALESCE(score, 0) >= 0.7 OR COALESCE(status = 'success', FALSE) AS INTEGER) AS completed,
      CAST(COALESCE(status = 'success', FALSE) AS INTEGER) AS execution_success, score,
      CAST(recovered AS INTEGER) AS recovered, rounds AS iterations
    FROM records""",
)
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.run_history_row(run_records(spark, sf_dir)).drop(
        "query", "dataset_path", "created_at", "payload"
    )
