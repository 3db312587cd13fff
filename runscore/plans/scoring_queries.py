"""Scoring of all runs: execution, completeness, critic, gaps, feedback, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runscore.functions import critic as K
from runscore.functions import qualify as Q
from runscore.functions import text as X
from runscore.operators.scoring import component_columns, evaluate_runs, score_table, with_judge
from runscore.operators.scoring import rule_gaps, rule_scores, run_text, text_flags
from runscore.plans.fixtures import run_records
from runscore.plans.oracle import BASE, has_any, matches, rnd, text, when
from runscore.plans.registry import query
from runscore.plans.text_queries import (
    BULLET,
    FILLED_ERR,
    JSON_PART,
    SQL_BEFORE_AFTER,
    SQL_CLIPS,
    SQL_DATA_MISSING,
    SQL_HAS_VIZ,
    SQL_IMPUTE_FAILED,
    SQL_KNOWN,
    SQL_MISUSE,
)
from runscore.schemas import COMPONENTS

# --- the same rules in SQL --------------------------------------------------
_TEXTS = """texts AS (
  SELECT a.run_id, a.mode, a.status, t.task, t.code, t.stderr, t.expected, t.summary, t.reply,
    CASE WHEN a.status IS NULL THEN '' WHEN regexp_matches(t.stdout, '\\S')
      THEN t.stdout || chr(10) || a.props ELSE t.stdout END AS stdout,
    CASE WHEN a.status IS NULL THEN CAST([] AS VARCHAR[]) ELSE t.files END AS files,
    CASE WHEN a.status IS NULL THEN '' ELSE t.stderr END AS err
  FROM agent_runs a JOIN run_templates t USING (template))"""

_FAMILIES = " + ".join(
    f"CAST({matches('code', p)} AS INTEGER)" for p in X.MODEL_FAMILIES
)
_MISSING = (
    f"list_filter({SQL_KNOWN}, lambda m: NOT regexp_matches(stdout, '(?i)\\b' || m || '\\b'))"
)

_FLAGS = f"""flags AS (
  SELECT *,
    COALESCE(status = 'success', FALSE) AS ok,
    COALESCE(status <> 'success', FALSE) AS bad,
    {FILLED_ERR.replace('stderr', 'err')} AND {has_any('err', X.CRITICAL_MARKERS)} AS critical,
    {FILLED_ERR.replace('stderr', 'err')} AND {has_any('err', X.WARNING_MARKERS)} AS warned,
    {SQL_IMPUTE_FAILED} AS impute_failed,
    {matches('task', X.VIZ_TASK)} AS wants_viz,
    {matches('task', X.PREP_TASK)} AS wants_prep,
    {matches('task', X.ML_TASK)} AS wants_ml,
    {SQL_HAS_VIZ} AS shows_viz,
    {matches('code', X.PREP_CODE)} AS shows_prep,
    {matches('stdout', X.ML_STDOUT)} AS shows_ml,
    {SQL_DATA_MISSING} AS data_missing,
    {matches('task', X.BEFORE_AFTER_TASK)} AS wants_ba,
    {SQL_BEFORE_AFTER} AS shows_ba,
    {matches('stdout', X.WORSE_WORD)} AS worse,
    {matches('task', X.OUTLIER_TASK)} AND {SQL_CLIPS} AS clips_early,
    {matches('task', X.ENGINEER_TASK)} AND NOT {matches('code', X.ENGINEER_CODE)} AS lacks_eng,
    {SQL_MISUSE['drops_twice']} AS drops_twice,
    {SQL_MISUSE['fills_inplace']} AS fills_inplace,
    {SQL_MISUSE['selects_object']} AS selects_object,
    {has_any('lower(task)', X.LEAKAGE_TERMS)} AS leakage_task,
    {_MISSING} AS missing_metrics,
    {_FAMILIES} AS families,
    lower(code) AS lc, lower(task) AS lt, lower(stdout) AS lo, lower(summary) AS ls
  FROM texts)"""


def _points(base: float, *terms: str) -> str:
    return f"ROUND(GREATEST(0.0, LEAST(10.0, {base} + {' + '.join(terms)})), 1)"


_SPLIT, _TREE = has_any("lc", K.SPLIT_CODE), has_any("lc", K.TREE_CODE)
_PREP = " + ".join(when(f"contains(lc, {text(s)})", 0.5) for s in K.PREP_SIGNALS)
SQL_COMPONENTS = {
    "data_understanding": _points(
        4.0,
        when(has_any("lc", K.EXPLORE_CODE), 2),
        when(has_any("lc", K.NULLS_CODE), 1),
        when(has_any("lt", K.QUALITY_TASK), 1),
        when("contains(ls, 'missing')", 1),
    ),
    "preprocessing": _points(
        4.0,
        f"LEAST(4.0, {_PREP})",
        when(_SPLIT, 1),
        when(f"{has_any('lc', K.SCALER_CODE)} AND {_TREE}", -1.5),
    ),
    "feature_engineering": _points(
        3.0,
        when(has_any("lc", K.SELECTION_CODE), 2),
        when(has_any("lc", K.IMPORTANCE_CODE), 2),
        when(has_any("lt", K.FEATURE_TASK), 1),
    ),
    "model_selection": _points(
        4.0,
        when("families >= 1", 1.5),
        when("families >= 2", 1.5),
        when(has_any("lt", K.COMPARE_TASK), 1),
        when(_TREE, 1),
        when("families = 0", -1),
    ),
    "evaluation_strategy": _points(
        4.0,
        when(has_any("lo", K.METRIC_STDOUT), 2),
        when(has_any("lt", K.METRIC_TASK), 1.5),
        when(has_any("lt", K.OUTCOME_TASK), 1),
    ),
    "statistical_validity": _points(
        4.0,
        when(_SPLIT, 2),
        when(f"{has_any('lc', K.FILL_CODE)} AND contains(lc, 'train_test_split')", 1),
        when(has_any("lt", K.VALIDATION_TASK), 1),
        when(has_any("lc", K.TARGET_CODE), 0.5),
        when(has_any("lc", K.DROP_TARGET_CODE), -0.5),
    ),
    "business_alignment": _points(
        4.0,
        when(has_any("lt", X.BUSINESS_TERMS), 2),
        when(has_any("lo", K.IMPACT_STDOUT), 1),
        when(has_any("lt", K.CHURN_TASK), 1),
        when(has_any("lt", K.PLAIN_TASK), -0.5),
    ),
    "explainability": _points(
        2.0,
        when(has_any("lc", K.EXPLAIN_CODE), 4),
        when(has_any("lt", X.EXPLAIN_TERMS), 2),
        when(has_any("lc", K.IMPORTANCE_REPORT_CODE), 1.5),
    ),
}

_EXEC = """CASE WHEN status IS NULL THEN 0.0 WHEN status = 'success' THEN
  CASE WHEN critical THEN 0.55 ELSE 1.0 END WHEN status = 'timeout' THEN 0.2
  WHEN status = 'blocked' THEN 0.0 ELSE 0.4 END"""
_COMPLETE = """CASE WHEN status IS NULL THEN 0.0 ELSE LEAST(1.0, 0.3
  + CASE WHEN regexp_matches(stdout, '\\S') THEN 0.3 ELSE 0.0 END
  + CASE WHEN len(files) > 0 THEN 0.2 ELSE 0.0 END
  + CASE WHEN len(expected) > 0 THEN 0.2 * len(list_filter(expected,
      lambda e: len(list_filter(files, lambda f: contains(f, e))) > 0)) / len(expected)::DOUBLE
    ELSE 0.0 END) END"""

_SCORES = f"""scores AS (
  SELECT *,
    CAST({_EXEC} AS DOUBLE) AS raw_exec,
    CAST({_COMPLETE} AS DOUBLE) AS complete,
    {', '.join(f'CAST({sql} AS DOUBLE) AS {name}' for name, sql in SQL_COMPONENTS.items())}
  FROM flags)"""
_DECISION = rnd("(" + " + ".join(COMPONENTS) + ") / 8.0 * 10.0", 1)
_TASK_SCORE = rnd(
    "0.4 * exec_score + 0.3 * complete "
    "+ CASE WHEN shows_viz OR NOT wants_viz THEN 0.15 ELSE 0 END "
    "+ CASE WHEN shows_ml OR NOT wants_ml THEN 0.15 ELSE 0 END",
    3,
)
_WANTS_FIGURE = (
    "(wants_viz OR len(list_filter(expected, lambda e: lower(e) IN ('png', 'jpg', 'svg'))) > 0)"
)
# (name, severity, condition) in gap order; missing metrics sit between figure and imputation
_GAPS = [
    ("execution", "high", "NOT ok"),
    ("execution", "medium", "ok AND warned"),
    ("visualization", "high", f"{_WANTS_FIGURE} AND NOT shows_viz"),
    ("metrics", None, None),
    ("preprocessing", "high", "impute_failed"),
    ("completeness", "medium", "wants_ba AND NOT shows_ba"),
    ("analysis", "high", "wants_ba AND shows_ba AND worse AND mode = 'feedback_loop'"),
    ("analysis", "medium", "wants_ba AND shows_ba AND worse AND mode <> 'feedback_loop'"),
    ("methodology", "medium", "mode = 'feedback_loop' AND clips_early"),
    ("feature_engineering", "medium", "lacks_eng"),
    (
        "preprocessing", "medium",
        "(wants_prep OR (data_missing AND contains(lt, 'imput'))) AND NOT shows_prep",
    ),
    ("code_quality", "medium", "drops_twice"),
    ("code_quality", "medium", "fills_inplace"),
    ("code_quality", "low", "selects_object"),
]


def _count(severity: str) -> str:
    terms = [f"CAST(({cond}) AS BIGINT)" for _, s, cond in _GAPS if s == severity]
    if severity == "high":
        terms.append("len(missing_metrics)")
    return " + ".join(terms)


_GAPS_SQL = "list_filter(list_concat(" + ", ".join(
    [
        "[" + ", ".join(f"CASE WHEN {c} THEN {text(n + ':' + s)} END" for n, s, c in _GAPS[:3]) + "]",
        "list_transform(METRIC_GAPS, lambda m: 'metrics:high')",
        "[" + ", ".join(f"CASE WHEN {c} THEN {text(n + ':' + s)} END" for n, s, c in _GAPS[4:]) + "]",
    ]
) + "), lambda g: g IS NOT NULL)"

_GAP_LIST = _GAPS_SQL.replace("METRIC_GAPS", "missing_metrics")
# a merged list drops a second gap for the same metric
_MERGED_LIST = _GAPS_SQL.replace("METRIC_GAPS", "list_distinct(missing_metrics)")

_VERDICT = f"""rated AS (
  SELECT *, {_TASK_SCORE} AS task_score, {_DECISION} AS decision_score,
    {_GAP_LIST} AS gap_list, {_MERGED_LIST} AS merged_list, {_count('high')} AS n_high, {_count('medium')} AS n_medium,
    {_count('low')} AS n_low
  FROM (SELECT *, CASE WHEN impute_failed THEN LEAST(raw_exec, 0.45) ELSE raw_exec END AS exec_score
        FROM scores)),
verdicts AS (
  SELECT *, GREATEST({rnd('1.0 - 0.4 * n_high - 0.15 * n_medium - 0.05 * n_low', 3)}, 0.0) AS gap_score
  FROM rated),
qualified AS (
  SELECT *, n_high = 0 AND gap_score >= 0.8 AND ok AS is_qualified,
    CAST(data_understanding < 7 AS INTEGER) + CAST(preprocessing < 7 AS INTEGER)
      + CAST(model_selection < 7 AS INTEGER) + CAST(evaluation_strategy < 7 AS INTEGER)
      + CAST(business_alignment < 7 AS INTEGER) + CAST(explainability < 7 AS INTEGER)
      + CAST(leakage_task AND statistical_validity < 7 AS INTEGER) AS advice,
    CASE WHEN impute_failed THEN LEAST(0.45, capped) ELSE capped END AS capped_score
  FROM (SELECT *, CASE WHEN bad THEN LEAST(task_score, 0.4)
          WHEN critical AND status IS NOT NULL THEN LEAST(task_score, 0.5) ELSE task_score END AS capped
        FROM verdicts)),
passing AS (
  SELECT *, CASE WHEN mode = 'feedback_loop'
      THEN ok AND task_score >= 0.75 AND is_qualified AND (decision_score >= 70 OR advice = 0)
      ELSE capped_score >= 0.75 AND (status IS NULL OR ok) END AS passed,
    list_filter([
      CASE WHEN bad OR (critical AND status IS NOT NULL) THEN 'execution:high' END,
      CASE WHEN impute_failed THEN 'preprocessing:high' END,
      CASE WHEN wants_viz AND NOT shows_viz THEN 'visualization:medium' END,
      CASE WHEN complete < 0.75 THEN 'completeness:medium' END,
      CASE WHEN decision_score < 70 THEN 'decision:medium' END,
      CASE WHEN business_alignment < 7 THEN 'business:medium' END,
      CASE WHEN explainability < 7 THEN 'explainability:low' END,
      CASE WHEN (wants_prep OR (data_missing AND wants_ml)) AND NOT shows_prep
        THEN 'preprocessing:low' END], lambda i: i IS NOT NULL) AS item_list
  FROM qualified)"""

WITH = f"WITH {BASE},\n" + ",\n".join([_TEXTS, _FLAGS, _SCORES, _VERDICT]) + "\n"


def scored(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return score_table(run_records(spark, sf_dir), **options)


def listed(gaps: Column) -> Column:
    """Compact text of a gap array: category and severity in order."""
    return F.array_join(
        F.transform(gaps, lambda g: F.concat(g["category"], F.lit(":"), g["severity"])), ","
    )


@query("c1_execution_score", f"{WITH} SELECT run_id, raw_exec, exec_score FROM passing")
def execution_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runscore.functions.scoring import execution_score

    return scored(spark, sf_dir).select(
        "run_id",
        execution_score(F.col("status"), F.col("is_critical")).alias("raw_exec"),
        "exec_score",
    )


@query("c2_completeness", f"{WITH} SELECT run_id, {rnd('complete', 6)} AS complete FROM passing")
def completeness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("run_id", F.round("complete", 6).alias("complete"))


@query("c3_task_score", f"{WITH} SELECT run_id, task_score FROM passing")
def task_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("run_id", "task_score")


@query("c4_critic_scores", f"{WITH} SELECT run_id, {', '.join(COMPONENTS)} FROM passing")
def critic_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(
        "run_id", *[score.alias(name) for name, score in component_columns().items()]
    )


@query("c5_critic_score", f"{WITH} SELECT run_id, decision_score FROM passing")
def critic_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("run_id", "decision_score")


@query(
    "c6_critic_notes",
    f"""{WITH} SELECT run_id,
      CAST(GREATEST(CAST(data_understanding >= 7 AS INTEGER) + CAST(preprocessing >= 7 AS INTEGER)
        + CAST(model_selection >= 7 AS INTEGER), 1) AS BIGINT) AS strengths,
      CAST(GREATEST(advice, 1) AS BIGINT) AS weaknesses, CAST(advice AS BIGINT) AS recommendations
    FROM passing""",
)
def critic_note_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = K.critic_notes(component_columns(), F.col("leakage_task"))
    return scored(spark, sf_dir).select(
        "run_id", *[F.size(lines).cast("long").alias(name) for name, lines in notes.items()]
    )


@query(
    "c7_critic_confidence",
    f"""{WITH} SELECT run_id, {rnd('LEAST(0.98, 0.6 + decision_score / 100.0 * 0.35)', 2)} AS confidence
    FROM passing""",
)
def confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(
        "run_id", K.critic_confidence(F.col("decision_score")).alias("confidence")
    )


@query(
    "c8_gaps",
    f"""{WITH} SELECT run_id, array_to_string(gap_list, ',') AS gaps,
      CAST(len(gap_list) AS BIGINT) AS n FROM passing""",
)
def gap_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(
        "run_id", listed(F.col("gaps")).alias("gaps"), F.size("gaps").cast("long").alias("n")
    )


@query("c9_gap_score", f"{WITH} SELECT run_id, gap_score FROM passing")
def gap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("run_id", "gap_score")


@query("c10_qualified", f"{WITH} SELECT run_id, is_qualified FROM passing")
def qualifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("run_id", "is_qualified")


@query(
    "c11_feedback_items",
    f"""{WITH} SELECT run_id, array_to_string(item_list, ',') AS items,
      ROUND(capped_score, 3) AS capped_score FROM passing""",
)
def feedback_item_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(
        "run_id", listed(F.col("own_items")).alias("items"), F.round("capped_score", 3).alias("capped_score")
    )


@query(
    "c12_merge_gaps",
    f"""{WITH} SELECT run_id,
      array_to_string(list_concat(item_list, merged_list), ',') AS merged
    FROM passing""",
)
def merged_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    # merging the gaps a second time must change nothing
    again = Q.merge_gaps(F.col("items"), F.col("gaps"))
    return scored(spark, sf_dir).select("run_id", listed(again).alias("merged"))


_VALID = f"COALESCE({JSON_PART} <> '' AND json_valid({JSON_PART}), FALSE)"


@query(
    "c13_apply_judge",
    f"""{WITH}, objects AS (
      SELECT *, CASE WHEN {_VALID} THEN {JSON_PART} END AS obj FROM passing),
    judged AS (
      SELECT run_id, n_high, n_medium, n_low, gap_score, obj IS NOT NULL AS is_object,
        CAST(json_extract(obj, '$.score') AS DOUBLE) AS score,
        CASE WHEN json_type(obj, '$.gaps') = 'ARRAY' THEN
            CAST(json_extract_string(obj, '$.gaps[*].severity') AS VARCHAR[]) ELSE [] END AS given,
        CASE WHEN json_type(obj, '$.gaps') = 'ARRAY' THEN
            json_array_length(obj, '$.gaps') ELSE 0 END AS n_given,
        list_transform(list_filter(list_transform(
          string_split_regex(reply, '\\r\\n|\\n|\\r'),
          lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: regexp_matches(l, {BULLET})),
          lambda l: lower(regexp_extract(l, {BULLET}, 1)) || '/' || regexp_extract(l, {BULLET}, 2)
            || '/' || regexp_extract(l, {BULLET}, 3)) AS raw_lines
      FROM objects),
    merged AS (
      SELECT *, list_filter(raw_lines, lambda l, i: list_position(list_transform(raw_lines,
        lambda k: regexp_replace(k, '^[a-z]+/', '')), regexp_replace(l, '^[a-z]+/', '')) = i) AS lines
      FROM judged),
    counted AS (
      SELECT run_id, gap_score, is_object, score,
        n_high + len(list_filter(given, lambda s: s = 'high'))
          + CASE WHEN is_object THEN 0 ELSE len(list_filter(lines, lambda l: starts_with(l, 'high/'))) END AS h,
        n_medium + n_given - len(list_filter(given, lambda s: s IN ('high', 'low')))
          + CASE WHEN is_object THEN 0 ELSE len(list_filter(lines, lambda l: starts_with(l, 'medium/'))) END AS m,
        n_low + len(list_filter(given, lambda s: s = 'low'))
          + CASE WHEN is_object THEN 0 ELSE len(list_filter(lines, lambda l: starts_with(l, 'low/'))) END AS l
      FROM merged),
    final AS (
      SELECT run_id, h, h + m + l AS n, CASE WHEN is_object THEN COALESCE(score, gap_score)
        ELSE GREATEST({rnd('1.0 - 0.4 * h - 0.15 * m - 0.05 * l', 3)}, 0.0) END AS score
      FROM counted)
    SELECT run_id, CAST(n AS BIGINT) AS gaps, score, h = 0 AND score >= 0.8 AS is_qualified
    FROM final""",
)
def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    gapped = rule_gaps(rule_scores(text_flags(run_text(run_records(spark, sf_dir)))))
    return with_judge(gapped, "reply").select(
        "run_id",
        F.size("gaps").cast("long").alias("gaps"),
        F.col("gap_score").alias("score"),
        "is_qualified",
    )


@query("c14_passed", f"{WITH} SELECT run_id, passed FROM passing")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("run_id", "passed")


@query(
    "c15_evaluate_runs",
    f"""{WITH} SELECT mode, status, COUNT(*) AS runs, {rnd('AVG(task_score)', 6)} AS task_score,
      {rnd('AVG(decision_score)', 6)} AS decision_score,
      {rnd('AVG(gap_score)', 6)} AS gap_score,
      COUNT(*) FILTER (WHERE is_qualified) AS qualified, COUNT(*) FILTER (WHERE passed) AS passed,
      CAST(SUM(len(item_list) + len(merged_list)) AS BIGINT) AS gaps,
      CAST(SUM(advice) AS BIGINT) AS recommendations
    FROM passing GROUP BY mode, status""",
)
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluate every run, then summarise the evaluations per condition and status."""
    from runscore.functions.rounding import stable_round

    done = evaluate_runs(run_records(spark, sf_dir))
    ev = F.col("evaluation")
    return done.groupBy("mode", F.col("execution.status").alias("status")).agg(
        F.count(F.lit(1)).alias("runs"),
        stable_round(F.avg(ev["task_completion_score"]), 6).alias("task_score"),
        stable_round(F.avg(ev["decision_evaluation"]["decision_score"]), 6).alias(
            "decision_score"
        ),
        stable_round(F.avg(ev["qualification_score"]), 6).alias("gap_score"),
        F.count_if(ev["task_qualified"]).alias("qualified"),
        F.count_if("feedback.passed").alias("passed"),
        F.sum(F.size("feedback.items")).alias("gaps"),
        F.sum(F.size("feedback.decision_recommendations")).alias("recommendations"),
    )
