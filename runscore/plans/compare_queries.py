"""Pairing and comparison of the two conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runscore.operators import compare as C
from runscore.operators.metrics import suite_metrics
from runscore.plans.fixtures import catalogue, run_records
from runscore.plans.oracle import (
    BREAKDOWN_CTE,
    CATALOGUE_CTE,
    METRIC_BASE,
    METRIC_NAMES,
    PAIR_BASE,
    PAIRS_CTE,
    rnd,
    suite,
    text,
    unpivoted,
)
from runscore.plans.registry import query
from runscore.runtime import scratch_path
from runscore.schemas import COMPONENTS
from runscore.sources.batches import read_batches

WITH = f"WITH {PAIR_BASE}\n"
WITH_PAIRS = f"WITH {PAIR_BASE},\n{PAIRS_CTE}\n"
WITH_BREAKDOWN = f"WITH {PAIR_BASE},\n{BREAKDOWN_CTE}\n"


@query("s3_latest_per_task", f"{WITH} SELECT mode, task_id, file_name, run_id FROM latest")
def latest_per_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.latest_per_task(run_records(spark, sf_dir)).select(
        "mode", "task_id", "file_name", "run_id"
    )


@query(
    "s3_latest_first_result",
    f"""{WITH} SELECT mode, task_id, file_name, run_id FROM run_values WHERE position = 0
    QUALIFY ROW_NUMBER() OVER (PARTITION BY mode, task_id ORDER BY file_name DESC) = 1""",
)
def latest_first_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = run_records(spark, sf_dir)
    return C.latest_per_task(runs, first_result_only=True).select(
        "mode", "task_id", "file_name", "run_id"
    )


@query(
    "j1_pair_runs",
    f"""{WITH} SELECT b.task_id, b.run_id AS baseline_run, f.run_id AS feedback_run
    FROM latest b JOIN latest f ON b.task_id = f.task_id
    WHERE b.mode = 'baseline' AND f.mode = 'feedback_loop'""",
)
def pair_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pair_runs(run_records(spark, sf_dir)).select(
        "task_id",
        F.col("b.run_id").alias("baseline_run"),
        F.col("f.run_id").alias("feedback_run"),
    ).orderBy("task_id")


# pairing on the file: every file has runs of several tasks in both conditions
_KEYED = """keyed AS (SELECT mode, file_name || '/' || task_id AS task_id FROM run_values)"""


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_records(spark, sf_dir).select(
        "mode", F.concat_ws("/", "file_name", "task_id").alias("task_id")
    )


@query(
    "j2_unpaired",
    f"""WITH {METRIC_BASE}, {_KEYED}
    SELECT task_id, MIN(mode) AS mode FROM keyed GROUP BY task_id HAVING COUNT(DISTINCT mode) = 1""",
)
def unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.unpaired(_keyed(spark, sf_dir))


@query(
    "j3_paired_ids",
    f"""WITH {METRIC_BASE}, {_KEYED}
    SELECT task_id FROM keyed WHERE mode = 'baseline'
    INTERSECT SELECT task_id FROM keyed WHERE mode = 'feedback_loop'""",
)
def paired_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.paired_ids(_keyed(spark, sf_dir))


def _comparison(source: str) -> str:
    return unpivoted(f"({suite('mode', source)})", "", METRIC_NAMES, "metric")


@query("j4_compare_metrics", f"{WITH} {_comparison('run_values')}")
def compare_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compare_metrics(run_records(spark, sf_dir))


@query("j4_compare_final", f"{WITH} {_comparison('paired')}")
def compare_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compare_final(run_records(spark, sf_dir))


@query(
    "j5_compare_latest",
    f"""WITH {PAIR_BASE}, newest AS (
      SELECT * FROM run_values r WHERE file_name = COALESCE((
        SELECT file_name FROM run_values x WHERE x.mode = r.mode AND file_name LIKE 'benchmark!_%' ESCAPE '!'
        ORDER BY file_name DESC LIMIT 1), file_name))
    {_comparison('newest')}""",
)
def compare_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compare_latest(run_records(spark, sf_dir))


@query("j6_compare_pairs", f"{WITH_PAIRS} SELECT * FROM comparison")
def compare_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compare_pairs(run_records(spark, sf_dir))


@query("j7_decision_breakdown", f"{WITH_BREAKDOWN} SELECT * FROM breakdown")
def decision_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.decision_breakdown(run_records(spark, sf_dir))


def _details(alias: str, name: str) -> str:
    last = f"(({alias}.user_id * 13 + {alias}.event_id * 7 + ({alias}.rounds - 1) * 29) % 1001)"
    known = f"{alias}.event_id % 7 <> 0"
    return f"""COALESCE({alias}.score, 0.0::DOUBLE) AS {name}_score,
      {known} AND {last} >= 750 AS {name}_passed, {alias}.rounds AS {name}_iterations,
      COALESCE(CASE WHEN {alias}.event_id % 53 <> 0 AND {alias}.event_id % 5 <> 0
        THEN {alias}.score >= 0.8 END, {known} AND {last} >= 800) AS {name}_qualified,
      CASE WHEN {known} THEN ({alias}.event_id + {alias}.rounds - 1) % 3 ELSE 0 END
        AS qualification_gap_count_{name}"""


@query(
    "j8_comparison_details",
    f"""{WITH} SELECT b.task_id, {_details('b', 'baseline')}, {_details('f', 'feedback')},
      f.recovered AS feedback_recovered
    FROM paired b JOIN paired f ON b.task_id = f.task_id AND b.mode = 'baseline'
      AND f.mode = 'feedback_loop'""",
)
def comparison_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.comparison_details(run_records(spark, sf_dir))


_INDEX = "list_position([" + ", ".join(text(n) for n in COMPONENTS.values()) + "], component)"


def _names(condition: str) -> str:
    return (
        f"COALESCE(string_agg(component, ',' ORDER BY {_INDEX}) FILTER (WHERE {condition}), '')"
    )


@query(
    "j9_impact_lists",
    f"""{WITH_BREAKDOWN} SELECT task_id, {_names('delta > 0')} AS positive,
      {_names('ABS(delta) < 1e-9')} AS neutral, {_names('delta < 0')} AS negative
    FROM breakdown GROUP BY task_id""",
)
def impact_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = C.impact_lists(C.decision_breakdown(run_records(spark, sf_dir)))
    return lists.select(
        "task_id",
        *[F.array_join(c, ",").alias(c) for c in ("positive", "neutral", "negative")],
    )


@query(
    "j10_needs_attention",
    f"""{WITH_BREAKDOWN} SELECT task_id, {_names('feedback_loop < 7 OR delta < 1')} AS components
    FROM breakdown GROUP BY task_id""",
)
def needs_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = C.needs_attention(C.decision_breakdown(run_records(spark, sf_dir)))
    return lists.select("task_id", F.array_join("components", ",").alias("components"))


def _first(order: str, condition: str = "TRUE") -> str:
    return f"(array_agg(component ORDER BY {order}, {_INDEX}) FILTER (WHERE {condition}))[1]"


@query(
    "j11_breakdown_extremes",
    f"""{WITH_BREAKDOWN} SELECT task_id,
      {_first('feedback_loop DESC')} AS highest_component, MAX(feedback_loop) AS highest_score,
      {_first('feedback_loop')} AS lowest_component, MIN(feedback_loop) AS lowest_score,
      {_first('delta DESC', 'delta > 0')} AS gain_component,
      MAX(delta) FILTER (WHERE delta > 0) AS gain,
      {_first('delta', 'delta < 0')} AS loss_component,
      MIN(delta) FILTER (WHERE delta < 0) AS loss, {rnd('AVG(delta)', 4)} AS mean_delta
    FROM breakdown GROUP BY task_id""",
)
def breakdown_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.breakdown_extremes(C.decision_breakdown(run_records(spark, sf_dir)))


@query(
    "j12_interpretation",
    f"""{WITH_PAIRS} SELECT task_id, delta, CASE WHEN delta > 0 THEN {text(C.READ_GAIN)}
      WHEN delta < 0 THEN {text(C.READ_LOSS)} ELSE {text(C.READ_FLAT)} END AS interpretation
    FROM comparison WHERE metric = 'FIS'""",
)
def interpretation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.interpretation(C.compare_pairs(run_records(spark, sf_dir)))


@query(
    "j13_with_task_meta",
    f"""WITH {METRIC_BASE}, {CATALOGUE_CTE} SELECT run_id, task_id,
      COALESCE(dataset, '') AS dataset, COALESCE(difficulty, '') AS difficulty
    FROM records LEFT JOIN catalogue USING (task_id)""",
)
def with_task_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = run_records(spark, sf_dir).select("run_id", "task_id")
    return C.with_task_meta(runs, catalogue(spark, sf_dir))


@query(
    "j14_match_task",
    f"""{WITH} SELECT mode, file_name, run_id, task_id FROM run_values
    QUALIFY ROW_NUMBER() OVER (PARTITION BY mode, file_name
      ORDER BY (task_id = 'task_007') DESC, position) = 1""",
)
def match_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.match_task(run_records(spark, sf_dir), "task_007").select(
        "mode", "file_name", "run_id", "task_id"
    )


def _log_sql() -> str:
    picks = ", ".join(
        f"MAX({side}) FILTER (WHERE metric = {text(m)}) AS \"{m}_{suffix}\""
        for m in C.LOGGED_METRICS
        for side, suffix in (("baseline", "baseline"), ("feedback_loop", "feedback"))
    )
    mean = "(" + " + ".join(COMPONENTS) + ") / 8.0 * 10.0"
    return f"""{WITH_PAIRS} SELECT w.*, w.baseline_task_id AS feedback_task_id,
      b.file_name AS baseline_file, f.file_name AS feedback_file,
      'comparison_metrics_' || w.baseline_task_id || '.csv' AS output_file,
      CASE WHEN f.has_critic THEN {rnd('0.6 + ' + rnd('f.mean', 1) + ' / 100.0 * 0.35', 2)} END
        AS decision_critic_confidence
    FROM (SELECT task_id AS baseline_task_id, {picks} FROM comparison GROUP BY task_id) w
    JOIN paired b ON b.task_id = w.baseline_task_id AND b.mode = 'baseline'
    JOIN (SELECT *, {mean} AS mean FROM paired) f
      ON f.task_id = w.baseline_task_id AND f.mode = 'feedback_loop'"""


@query("s12_comparison_log", _log_sql())
def comparison_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.comparison_log(run_records(spark, sf_dir)).drop("timestamp")


@query("s12_appended_log", _log_sql())
def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log appended twice under one name, and read back."""
    path = scratch_path(spark, "comparison-log")
    for _ in range(2):
        C.log_comparisons(run_records(spark, sf_dir), path, "first")
    return read_batches(spark, path).drop("timestamp", "batch")


@query(
    "w28_before_after",
    f"""WITH {METRIC_BASE} SELECT task_id, baseline, feedback_loop,
      {rnd('feedback_loop - baseline', 4)} AS delta, feedback_loop > baseline AS improved
    FROM (SELECT task_id, {rnd("AVG(da) FILTER (WHERE file_name < 'benchmark_00000100')", 4)} AS baseline,
            {rnd("AVG(da) FILTER (WHERE file_name >= 'benchmark_00000100')", 4)} AS feedback_loop
          FROM run_values GROUP BY task_id)
    WHERE baseline IS NOT NULL AND feedback_loop IS NOT NULL""",
)
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision accuracy per task before and after a date of change."""
    runs = run_records(spark, sf_dir)
    early = F.col("file_name") < "benchmark_00000100"

    def accuracy(part: DataFrame) -> DataFrame:
        return suite_metrics(part, ["task_id"]).select("task_id", F.col("DA").alias("value"))

    return C.before_after(accuracy(runs.where(early)), accuracy(runs.where(~early)), ["task_id"])
