"""Decision critic: eight component scores from word evidence in code and text.

Each component is a base score plus points per piece of evidence. Evidence is a
substring test on lower-cased text, so the rules are plain Columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from runscore.functions import text as X
from runscore.functions.qualify import present
from runscore.functions.rounding import bonus, clamp, stable_round, total
from runscore.schemas import COMPONENT_GATE, COMPONENTS

# --- fixed values: evidence words, base scores, notes -----------------------
EXPLORE_CODE = ["describe", "shape", "info", "head", "value_counts"]
NULLS_CODE = ["isna", "isnull", "fillna", "dropna", "duplicated", "drop_duplicates"]
QUALITY_TASK = ["missing", "imbalance", "class", "duplicate", "quality", "eda", "explore"]
MISSING_SUMMARY = ["missing values", "missing"]

PREP_SIGNALS = [
    "fillna", "dropna", "imput", "onehotencoder", "get_dummies", "standardscaler",
    "minmaxscaler", "columntransformer", "train_test_split", "clip", "iqr", "quantile",
]
SPLIT_CODE = ["train_test_split", "stratify"]
SCALER_CODE = ["standardscaler", "minmaxscaler"]
TREE_CODE = ["randomforest", "gradientboosting", "xgb", "lgbm"]

SELECTION_CODE = ["corr", "correlation", "drop", "feature", "variance", "selectkbest", "pca"]
IMPORTANCE_CODE = ["permutation", "feature_importance", "importance"]
FEATURE_TASK = ["feature", "engineer", "multicollinearity"]

COMPARE_TASK = ["compare", "benchmark", "which", "why"]

METRIC_STDOUT = ["accuracy", "precision", "recall", "f1", "rmse", "mae", "r2", "auc", "roc"]
METRIC_TASK = ["precision", "recall", "accuracy", "rmse", "mae", "r2", "auc", "f1"]
OUTCOME_TASK = ["churn", "fraud", "business", "improve", "reduce", "risk"]

FILL_CODE = ["dropna", "fillna", "imput"]
VALIDATION_TASK = ["leak", "leakage", "validation", "overfit"]
TARGET_CODE = ["target", "y"]
DROP_TARGET_CODE = ["drop(columns=", "drop([", "target"]

IMPACT_STDOUT = ["recall", "precision", "f1", "auc", "rmse", "mae", "r2"]
CHURN_TASK = ["churn", "fraud"]
PLAIN_TASK = ["accuracy", "class", "predict"]

EXPLAIN_CODE = ["shap", "permutation", "feature_importance", "lime", "explain"]
IMPORTANCE_REPORT_CODE = ["feature_importance", "permutation"]

STRENGTHS = {
    "data_understanding": "The workflow shows evidence of data exploration and quality checks.",
    "preprocessing": "Preprocessing choices are reasonably aligned with the task.",
    "model_selection": "The selected model appears appropriate for the task.",
}
WEAKNESSES = {
    "data_understanding": "The analysis does not clearly demonstrate strong data understanding.",
    "preprocessing": (
        "Preprocessing decisions are weak or inconsistent with the selected model."
    ),
    "model_selection": "Model choice is under-justified or could be improved.",
    "evaluation_strategy": (
        "The evaluation strategy may not align with the business objective."
    ),
    "business_alignment": (
        "The decision-making process does not clearly reflect the business objective."
    ),
    "explainability": "The workflow lacks clear explainability steps.",
    "statistical_validity": "Potential leakage or weak validation strategy was detected.",
}
RECOMMENDATIONS = {
    "data_understanding": (
        "Inspect the target variable, missing values, class balance, and data quality before "
        "modeling."
    ),
    "preprocessing": (
        "Refine missing value handling, scaling, encoding, and leakage prevention."
    ),
    "model_selection": (
        "Compare at least one alternative model and explain why the chosen model is preferred."
    ),
    "evaluation_strategy": (
        "Choose metrics that match the task, such as recall for churn or precision-recall for "
        "fraud."
    ),
    "business_alignment": (
        "Tie the evaluation back to the business goal and prioritize the most relevant metrics."
    ),
    "explainability": (
        "Add feature importance, permutation importance, SHAP, or LIME where appropriate."
    ),
    "statistical_validity": (
        "Use a proper train/test split, avoid target leakage, and validate carefully."
    ),
}
NO_STRENGTH = "The workflow attempted to solve the requested analytical task."
NO_WEAKNESS = (
    "The current decision path is generally reasonable but can still be strengthened."
)
CRITIC_SUMMARY = (
    "Decision critique completed with a balanced view of data understanding, preprocessing, "
    "model choice, evaluation quality, and business alignment."
)
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Evidence:
    """Lower-cased inputs of the critic plus the model family count."""

    code: Column
    task: Column
    summary: Column
    stdout: Column
    families: Column

    def in_code(self, words: list[str]) -> Column:
        return X.contains_any(self.code, words)

    def in_task(self, words: list[str]) -> Column:
        return X.contains_any(self.task, words)

    def in_stdout(self, words: list[str]) -> Column:
        return X.contains_any(self.stdout, words)


def evidence(code: Column, task: Column, summary: Column, stdout: Column) -> Evidence:
    return Evidence(
        F.lower(code), F.lower(task), F.lower(summary), F.lower(stdout),
        X.model_family_count(code),
    )


def component_scores(e: Evidence) -> dict[str, Column]:
    """The eight 0-10 scores, keyed by component field name."""
    split = e.in_code(SPLIT_CODE)
    tree = e.in_code(TREE_CODE)
    prep_points = 0.5 * total([bonus(e.code.contains(s), 1) for s in PREP_SIGNALS])
    points = {
        "data_understanding": [
            F.lit(4.0),
            bonus(e.in_code(EXPLORE_CODE), 2),
            bonus(e.in_code(NULLS_CODE), 1),
            bonus(e.in_task(QUALITY_TASK), 1),
            bonus(X.contains_any(e.summary, MISSING_SUMMARY), 1),
        ],
        "preprocessing": [
            F.lit(4.0),
            F.least(F.lit(4.0), prep_points),
            bonus(split, 1),
            bonus(e.in_code(SCALER_CODE) & tree, -1.5),
        ],
        "feature_engineering": [
            F.lit(3.0),
            bonus(e.in_code(SELECTION_CODE), 2),
            bonus(e.in_code(IMPORTANCE_CODE), 2),
            bonus(e.in_task(FEATURE_TASK), 1),
        ],
        "model_selection": [
            F.lit(4.0),
            bonus(e.families > 0, 1.5),
            bonus(e.families > 1, 1.5),
            bonus(e.in_task(COMPARE_TASK), 1),
            bonus(tree, 1),
            bonus(e.families == 0, -1),
        ],
        "evaluation_strategy": [
            F.lit(4.0),
            bonus(e.in_stdout(METRIC_STDOUT), 2),
            bonus(e.in_task(METRIC_TASK), 1.5),
            bonus(e.in_task(OUTCOME_TASK), 1),
        ],
        "statistical_validity": [
            F.lit(4.0),
            bonus(split, 2),
            bonus(e.in_code(FILL_CODE) & e.code.contains("train_test_split"), 1),
            bonus(e.in_task(VALIDATION_TASK), 1),
            bonus(e.in_code(TARGET_CODE), 0.5),
            bonus(e.in_code(DROP_TARGET_CODE), -0.5),
        ],
        "business_alignment": [
            F.lit(4.0),
            bonus(e.in_task(X.BUSINESS_TERMS), 2),
            bonus(e.in_stdout(IMPACT_STDOUT), 1),
            bonus(e.in_task(CHURN_TASK), 1),
            bonus(e.in_task(PLAIN_TASK), -0.5),
        ],
        "explainability": [
            F.lit(2.0),
            bonus(e.in_code(EXPLAIN_CODE), 4),
            bonus(e.in_task(X.EXPLAIN_TERMS), 2),
            bonus(e.in_code(IMPORTANCE_REPORT_CODE), 1.5),
        ],
    }
    return {name: F.round(clamp(total(points[name]), 0, 10), 1) for name in COMPONENTS}


def critic_score(scores: dict[str, Column]) -> Column:
    """Unweighted mean of the eight scores on a 0-100 scale."""
    return stable_round(total([scores[name] for name in COMPONENTS]) / 8.0 * 10.0, 1)


def critic_confidence(score: Column) -> Column:
    return stable_round(F.least(F.lit(0.98), 0.6 + score / 100.0 * 0.35), 2)


def needs_recommendation(scores: dict[str, Column], leakage_task: Column) -> dict[str, Column]:
    """Condition under which each component is noted as weak, in note order."""
    weak = {name: scores[name] < COMPONENT_GATE for name in RECOMMENDATIONS}
    weak["statistical_validity"] = leakage_task & weak["statistical_validity"]
    return weak


def critic_notes(scores: dict[str, Column], leakage_task: Column) -> dict[str, Column]:
    """Strength, weakness and recommendation lines."""
    weak = needs_recommendation(scores, leakage_task)
    strong = [
        F.when(scores[name] >= COMPONENT_GATE, F.lit(line)) for name, line in STRENGTHS.items()
    ]
    weak_lines = [F.when(weak[name], F.lit(line)) for name, line in WEAKNESSES.items()]
    advice = [F.when(weak[name], F.lit(line)) for name, line in RECOMMENDATIONS.items()]

    def lines(conditional: list[Column], fallback: str | None = None) -> Column:
        kept = present(*conditional)
        if fallback is None:
            return kept
        return F.when(F.size(kept) == 0, F.array(F.lit(fallback))).otherwise(kept)

    return {
        "strengths": lines(strong, NO_STRENGTH),
        "weaknesses": lines(weak_lines, NO_WEAKNESS),
        "recommendations": lines(advice),
    }


def critic_struct(scores: dict[str, Column], score: Column, leakage_task: Column) -> Column:
    notes = critic_notes(scores, leakage_task)
    return F.struct(
        score.alias("decision_score"),
        F.struct(*[scores[name].alias(name) for name in COMPONENTS]).alias("scores"),
        notes["strengths"].alias("strengths"),
        notes["weaknesses"].alias("weaknesses"),
        notes["recommendations"].alias("recommendations"),
        critic_confidence(score).alias("confidence"),
        F.lit(CRITIC_SUMMARY).alias("summary"),
    )
