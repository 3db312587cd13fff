"""Rule qualification: ordered gap arrays and the scores derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runscore.functions.rounding import stable_round
from runscore.schemas import (
    GAPS_DDL,
    OTHER_SEVERITY_WEIGHT,
    QUALIFY_THRESHOLD,
    SEVERITY_WEIGHT,
)

# --- fixed values: gap texts (category, message, recommendation) ------------
NOT_EXECUTED = ("execution", "Code did not execute successfully.", "Fix runtime errors and re-run.")
STDERR_WARNINGS = (
    "execution",
    "Stderr contains warnings: ",
    "Fix deprecation warnings and pandas API usage.",
)
NO_FIGURE = (
    "visualization",
    "Task requires a saved visualization but none was detected.",
    "Save plot to FIGURES_DIR with plt.savefig(...).",
)
NOT_IMPUTED = (
    "preprocessing",
    "Imputation did not reduce missing value counts.",
    "Verify before/after missing counts in stdout.",
)
NO_BEFORE_AFTER = (
    "completeness",
    "Before/after comparison not clearly reported in stdout.",
    "Print RMSE (or metric) before and after the transformation.",
)
WORSENED = (
    "analysis",
    "Metric worsened after transformation; review clipping or methodology.",
    "Compute IQR bounds on the training set only, clip train and test "
    "separately, or try alternative outlier handling.",
)
CLIPPED_EARLY = (
    "methodology",
    "Outlier bounds appear computed on the full dataset before train/test split.",
    "Split first, compute Q1/Q3/IQR on X_train only, then clip "
    "X_train and X_test with those bounds.",
)
NOT_ENGINEERED = (
    "feature_engineering",
    "Limited evidence of engineered features in code.",
    "Create and use explicit engineered columns.",
)
NOT_PREPROCESSED = (
    "preprocessing",
    "Task requires preprocessing but little evidence in code.",
    "Add imputation, encoding, or scaling as required.",
)
DROP_TWICE = (
    "code_quality",
    "pandas drop() uses both columns= and axis=1 (invalid in pandas 3.x).",
    "Use df.drop(columns=[...], inplace=True) without axis=1.",
)
FILL_INPLACE = (
    "code_quality",
    "Inplace fillna detected; may cause chained assignment issues.",
    "Use df['col'] = df['col'].fillna(value) and verify counts.",
)
OBJECT_DTYPES = (
    "code_quality",
    "select_dtypes(include='object') triggers pandas 3 deprecation warnings.",
    "Use include=['object', 'string'] or exclude= for string columns.",
)
REQUIREMENTS_MET = "Task requirements met."
# ----------------------------------------------------------------------------


def gap(
    category: str,
    message: str | Column,
    recommendation: str | Column,
    severity: str | Column = "medium",
) -> Column:
    def text(value: str | Column) -> Column:
        return F.lit(value) if isinstance(value, str) else value

    return F.struct(
        text(category).alias("category"),
        text(severity).alias("severity"),
        text(message).alias("message"),
        text(recommendation).alias("recommendation"),
    )


def gap_list(*conditional: Column) -> Column:
    """Array of the gaps whose condition held, in argument order."""
    return present(*conditional)


def present(*values: Column) -> Column:
    """Array of the non-null values in order."""
    return F.array_compact(F.array(*values))


def severity_weight(severity: Column) -> Column:
    weight = F.lit(OTHER_SEVERITY_WEIGHT)
    for name, value in SEVERITY_WEIGHT.items():
        weight = F.when(severity == name, F.lit(value)).otherwise(weight)
    return weight


def gap_score(gaps: Column) -> Column:
    """One minus the severity weights, not below zero."""
    lost = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + severity_weight(g["severity"]))
    return F.greatest(stable_round(1.0 - lost, 3), F.lit(0.0))


def counted_score(high: Column, medium: Column, low: Column) -> Column:
    """The score of :func:`gap_score` from the number of gaps of each severity."""
    lost = (
        SEVERITY_WEIGHT["high"] * high
        + SEVERITY_WEIGHT["medium"] * medium
        + OTHER_SEVERITY_WEIGHT * low
    )
    return F.greatest(stable_round(1.0 - lost, 3), F.lit(0.0))


def has_high(gaps: Column) -> Column:
    return F.exists(gaps, lambda g: g["severity"] == "high")


def qualified(
    high: Column, score: Column, succeeded: Column, threshold: float = QUALIFY_THRESHOLD
) -> Column:
    """No high gap, a sufficient score and a successful execution."""
    return (high == 0) & (score >= threshold) & succeeded


def qualify_summary(is_qualified: Column, count: Column, score: Column) -> Column:
    return F.when(is_qualified, F.lit(REQUIREMENTS_MET)).otherwise(
        F.format_string("Qualification gaps (%d); score=%.2f.", count, score)
    )


def merge_gaps(first: Column, second: Column) -> Column:
    """``first`` plus the gaps of ``second`` whose (category, message) is new."""

    def append_new(kept: Column, g: Column) -> Column:
        known = F.exists(
            kept,
            lambda k: k["category"].eqNullSafe(g["category"])
            & k["message"].eqNullSafe(g["message"]),
        )
        return F.when(known, kept).otherwise(F.array_append(kept, g)).cast(GAPS_DDL)

    empty = F.array().cast(GAPS_DDL)
    start = F.coalesce(first.cast(GAPS_DDL), empty)
    return F.aggregate(F.coalesce(second.cast(GAPS_DDL), empty), start, append_new)


def apply_judge(
    rule_gaps: Column,
    rule_score: Column,
    rule_summary: Column,
    judge: Column,
    threshold: float = QUALIFY_THRESHOLD,
) -> Column:
    """Qualification after a judge reply has been merged into the rule gaps.

    ``judge`` is the struct of :func:`runscore.functions.text.parse_judge_reply`.
    A JSON reply without a score keeps the rule score; a bullet reply is scored
    from the merged gaps.
    """
    gaps = merge_gaps(rule_gaps, judge["gaps"])
    score = F.when(judge["is_object"], F.coalesce(judge["score"], rule_score)).otherwise(
        gap_score(gaps)
    )
    return F.struct(
        gaps.alias("gaps"),
        score.alias("score"),
        (~has_high(gaps) & (score >= threshold)).alias("qualified"),
        F.coalesce(F.nullif(judge["summary"], F.lit("")), rule_summary).alias("summary"),
    )
