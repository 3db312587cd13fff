"""Run scores and feedback items as Column expressions over named flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runscore.functions.qualify import gap, gap_list
from runscore.functions.rounding import bonus, is_filled, stable_round
from runscore.schemas import (
    COMPONENT_GATE,
    DECISION_GATE,
    FEEDBACK,
    PASS_THRESHOLD,
    QUALIFY_THRESHOLD,
)

# --- fixed values: score weights, caps and feedback texts -------------------
EXEC_SUCCESS, EXEC_SUCCESS_CRITICAL, EXEC_TIMEOUT, EXEC_BLOCKED, EXEC_FAILURE = (
    1.0, 0.55, 0.2, 0.0, 0.4,
)
IMPUTATION_EXEC_CAP = 0.45
CAP_FAILED, CAP_CRITICAL, CAP_IMPUTATION = 0.4, 0.5, 0.45
W_EXEC, W_COMPLETE, W_VIZ, W_ML = 0.4, 0.3, 0.15, 0.15
COMPLETE_BASE, COMPLETE_STDOUT, COMPLETE_FILES, COMPLETE_EXPECTED = 0.3, 0.3, 0.2, 0.2
COMPLETE_ENOUGH = 0.75

ITEM_FAILED = (
    "Execution failed: ",
    "Fix runtime errors, verify imports and column names, add try/except.",
)
ITEM_CRITICAL = (
    "Runtime warnings/errors in stderr: ",
    "Avoid pandas inplace chained assignment; use df['col'] = df['col'].fillna(value).",
)
ITEM_IMPUTATION = (
    "Missing values were not reduced after imputation (possible inplace fillna bug).",
    "Use df['Age'] = df['Age'].fillna(median) and verify missing count is zero.",
)
ITEM_VIZ = (
    "No visualization artifacts detected.",
    "Save plots with plt.savefig(os.path.join(os.environ['FIGURES_DIR'], 'name.png')).",
)
ITEM_INCOMPLETE = (
    "Output appears incomplete relative to task requirements.",
    "Ensure EDA summary, metrics printout, and saved outputs.",
)
ITEM_DECISION = (
    "Decision quality is only %.1f/100; the analytical choices need stronger justification.",
    "Refine the analysis plan with stronger data understanding, preprocessing, model "
    "comparison, and business-focused metrics.",
)
ITEM_BUSINESS = (
    "The chosen approach does not clearly align with the stated business objective.",
    "Reframe the solution around business impact and the primary success metric for the task.",
)
ITEM_EXPLAIN = (
    "The workflow does not provide enough explanation of why predictions or conclusions are made.",
    "Add feature importance, permutation importance, SHAP, or LIME where appropriate.",
)
ITEM_PREP = (
    "Limited evidence of preprocessing steps.",
    "Add missing value handling and feature scaling where needed.",
)
SUMMARY_PASSED = "Task meets quality threshold."
SUMMARY_REVISE = "Revisions recommended before final report."
SUMMARY_LOOP_PASSED = "Task meets heuristic and qualification thresholds."
SUMMARY_LOOP_REVISE = "Revisions needed: heuristic or qualification requirements not met."
# ----------------------------------------------------------------------------


def execution_score(status: Column, critical: Column) -> Column:
    """Score of one execution; ``status`` is null when nothing was executed."""
    success = F.when(critical, F.lit(EXEC_SUCCESS_CRITICAL)).otherwise(F.lit(EXEC_SUCCESS))
    return (
        F.when(status.isNull(), F.lit(0.0))
        .when(status == "success", success)
        .when(status == "timeout", F.lit(EXEC_TIMEOUT))
        .when(status == "blocked", F.lit(EXEC_BLOCKED))
        .otherwise(F.lit(EXEC_FAILURE))
    )


def completeness(status: Column, stdout: Column, files: Column, expected: Column) -> Column:
    wanted = F.coalesce(F.size(expected), F.lit(0))
    matched = F.size(
        F.filter(expected, lambda name: F.exists(files, lambda f: f.contains(name)))
    )
    share = F.when(wanted > 0, COMPLETE_EXPECTED * matched / wanted).otherwise(F.lit(0.0))
    score = (
        F.lit(COMPLETE_BASE)
        + bonus(is_filled(stdout), COMPLETE_STDOUT)
        + bonus(F.coalesce(F.size(files), F.lit(0)) > 0, COMPLETE_FILES)
        + share
    )
    return F.when(status.isNull(), F.lit(0.0)).otherwise(F.least(score, F.lit(1.0)))


def capped_execution_score(exec_score: Column, imputation_failed: Column) -> Column:
    return F.when(
        imputation_failed, F.least(exec_score, F.lit(IMPUTATION_EXEC_CAP))
    ).otherwise(exec_score)


def task_score(exec_score: Column, complete: Column, viz_ok: Column, ml_ok: Column) -> Column:
    raw = W_EXEC * exec_score + W_COMPLETE * complete + bonus(viz_ok, W_VIZ) + bonus(ml_ok, W_ML)
    return stable_round(raw, 3)


def capped_score(
    score: Column, failed: Column, critical: Column, imputation_failed: Column
) -> Column:
    """Task score lowered to the cap of the worst execution problem."""
    after_run = (
        F.when(failed, F.least(score, F.lit(CAP_FAILED)))
        .when(critical, F.least(score, F.lit(CAP_CRITICAL)))
        .otherwise(score)
    )
    return F.when(imputation_failed, F.least(after_run, F.lit(CAP_IMPUTATION))).otherwise(after_run)


def feedback_items(
    *,
    failed: Column,
    critical: Column,
    imputation_failed: Column,
    viz_missing: Column,
    complete: Column,
    decision_score: Column,
    business: Column,
    explainability: Column,
    prep_missing: Column,
    stderr: Column,
    error_message: Column,
) -> Column:
    cause = F.coalesce(F.nullif(error_message, F.lit("")), F.substring(stderr, 1, 500))
    return gap_list(
        F.when(
            failed,
            gap("execution", F.concat(F.lit(ITEM_FAILED[0]), cause), ITEM_FAILED[1], "high"),
        ).when(
            critical,
            gap(
                "execution",
                F.concat(F.lit(ITEM_CRITICAL[0]), F.substring(stderr, 1, 400)),
                ITEM_CRITICAL[1],
                "high",
            ),
        ),
        F.when(imputation_failed, gap("preprocessing", *ITEM_IMPUTATION, "high")),
        F.when(viz_missing, gap("visualization", *ITEM_VIZ)),
        F.when(complete < COMPLETE_ENOUGH, gap("completeness", *ITEM_INCOMPLETE)),
        F.when(
            decision_score < DECISION_GATE,
            gap("decision", F.format_string(ITEM_DECISION[0], decision_score), ITEM_DECISION[1]),
        ),
        F.when(business < COMPONENT_GATE, gap("business", *ITEM_BUSINESS)),
        F.when(explainability < COMPONENT_GATE, gap("explainability", *ITEM_EXPLAIN, "low")),
        F.when(prep_missing, gap("preprocessing", *ITEM_PREP, "low")),
    )


def passed(
    *,
    mode: Column,
    status: Column,
    capped: Column,
    score: Column,
    is_qualified: Column,
    decision_score: Column,
    has_advice: Column,
    threshold: float = PASS_THRESHOLD,
) -> Column:
    """Whether the round passes; the feedback loop has the stricter rule."""
    succeeded = F.coalesce(status == "success", F.lit(False))
    plain = (capped >= PASS_THRESHOLD) & (status.isNull() | succeeded)
    decision_ok = (decision_score >= DECISION_GATE) | ~has_advice
    loop = succeeded & (score >= threshold) & is_qualified & decision_ok
    return F.when(mode == FEEDBACK, loop).otherwise(plain)


__all__ = [
    "QUALIFY_THRESHOLD",
    "capped_execution_score",
    "capped_score",
    "completeness",
    "execution_score",
    "feedback_items",
    "passed",
    "task_score",
]
