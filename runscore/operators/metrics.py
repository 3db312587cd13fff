"""Reliability metrics per run and per suite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscore.functions.rounding import stable_round, total
from runscore.operators.iterations import feedback_improvement
from runscore.schemas import (
    COMPLETED_THRESHOLD,
    COMPONENTS,
    CORRECT_THRESHOLD,
    DA_COMPONENTS,
    DQS_WEIGHTS,
    METRICS,
    ORS_WEIGHTS,
)

EVALUATION, EXECUTION = "evaluation", "execution"


def _score() -> Column:
    return F.col(EVALUATION)["task_completion_score"]


def _component(name: str) -> Column:
    scores = F.col(EVALUATION)["decision_evaluation"]["scores"]
    return F.coalesce(scores[name], F.lit(0.0))


def has_critic() -> Column:
    return F.col(EVALUATION)["decision_evaluation"].isNotNull()


def succeeded() -> Column:
    return F.coalesce(F.col(EXECUTION)["status"] == "success", F.lit(False))


def executed() -> Column:
    return F.col(EXECUTION)["status"].isNotNull()


def run_dqs() -> Column:
    weighted = total([_component(n) / 10.0 * w for n, w in DQS_WEIGHTS.items()])
    return F.when(has_critic(), stable_round(weighted * 100.0, 4))


def run_bas() -> Column:
    return F.when(has_critic(), stable_round(_component("business_alignment") * 10.0, 4))


def run_da() -> Column:
    """Component mean, or 1/0 by the task score where no critic ran."""
    mean = total([_component(n) / 10.0 for n in DA_COMPONENTS]) / len(DA_COMPONENTS)
    plain = F.when(_score() >= CORRECT_THRESHOLD, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(has_critic(), stable_round(mean, 4)).otherwise(plain)


def reliability_score(tcr: Column, esr: Column, da: Column, dqs: Column, bas: Column, fis: Column):
    """Weighted overall score on a 0-100 scale."""
    parts = {"tcr": tcr, "esr": esr, "da": da, "dqs": dqs / 100.0, "bas": bas / 100.0, "fis": fis}
    weighted = total([parts[name] * w for name, w in ORS_WEIGHTS.items()])
    return stable_round(stable_round(weighted, 4) * 100.0, 4)


def run_metrics(runs: DataFrame) -> DataFrame:
    """Add the seven run-level metrics; here tcr is the task score itself."""
    return runs.withColumns(
        {
            "tcr": F.coalesce(stable_round(_score(), 4), F.lit(0.0)),
            "esr": succeeded().cast("double"),
            "da": run_da(),
            "fis": feedback_improvement(),
            "dqs": F.coalesce(run_dqs(), F.lit(0.0)),
            "bas": F.coalesce(run_bas(), F.lit(0.0)),
        }
    ).withColumn(
        "ors",
        reliability_score(*[F.col(c) for c in ("tcr", "esr", "da", "dqs", "bas", "fis")]),
    )


def is_completed() -> Column:
    return (F.coalesce(_score(), F.lit(0.0)) >= COMPLETED_THRESHOLD) | succeeded()


def suite_aggregates(initial_failures: bool = False) -> list[Column]:
    """Unrounded sums and means behind the suite metrics.

    ``initial_failures`` counts recovery over runs whose first round failed
    instead of runs whose final execution failed.
    """
    failed = executed() & ~succeeded()
    if initial_failures:
        failed = F.coalesce(
            ~F.try_element_at(F.col("feedback_history"), F.lit(1))["passed"], F.lit(False)
        )
    rescued = failed & F.coalesce(F.col("recovered_from_failure"), F.lit(False))

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(F.count_if(part), F.count_if(whole)), F.lit(0.0))

    def mean(value: Column) -> Column:
        return F.coalesce(F.avg(value), F.lit(0.0))

    return [
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if(is_completed()).alias("completed_tasks"),
        share(is_completed(), F.lit(True)).alias("tcr"),
        share(succeeded(), executed()).alias("esr"),
        share(rescued, failed).alias("rr"),
        mean(feedback_improvement()).alias("fis"),
        mean(run_da()).alias("da"),
        mean(run_dqs()).alias("dqs"),
        mean(run_bas()).alias("bas"),
    ]


def finish_suite(aggregated: DataFrame, by: list[str], extra: list[str] = ()) -> DataFrame:
    """Round the aggregates and derive ORS from their unrounded values."""
    ors = reliability_score(*[F.col(c) for c in ("tcr", "esr", "da", "dqs", "bas", "fis")])
    named = {m: stable_round(F.col(m.lower()), 4) for m in METRICS if m != "ORS"}
    named["ORS"] = ors
    return aggregated.select(
        *by,
        *extra,
        *[named[m].alias(m) for m in METRICS],
        "total_tasks",
        "completed_tasks",
    )


def suite_metrics(
    runs: DataFrame,
    by: list[str] | None = None,
    *,
    rollup: bool = False,
    initial_failures: bool = False,
) -> DataFrame:
    """Eight metrics and two counts per group: one partial and one final aggregate.

    With no grouping an empty input still gives one row of zeros. ``rollup``
    adds the subtotal rows of every prefix of ``by`` and a ``level`` column
    with the number of grouping columns that are totalled.
    """
    by = list(by or [])
    if rollup:
        marks = F.lit(0)
        for name in by:
            marks = marks + F.grouping(name).cast("int")
        aggregated = runs.rollup(*by).agg(
            *suite_aggregates(initial_failures), marks.alias("level")
        )
        return finish_suite(aggregated, by, ["level"])
    return finish_suite(runs.groupBy(*by).agg(*suite_aggregates(initial_failures)), by)


def run_history_row(runs: DataFrame) -> DataFrame:
    """Flat history row per run; ``payload`` holds its values as JSON text.

    ``parse_json(payload)`` gives a variant for fields that have no column.
    """
    flat = _history_columns(runs)
    values = [c for c in flat.columns if c not in ("run_id", "mode", "created_at")]
    return flat.withColumn("payload", F.to_json(F.struct(*values), {"ignoreNullFields": "false"}))


def _history_columns(runs: DataFrame) -> DataFrame:
    return runs.select(
        "run_id",
        "mode",
        F.try_element_at(F.col("metadata"), F.lit("task_id")).alias("task_id"),
        "query",
        "dataset_path",
        is_completed().cast("int").alias("completed"),
        succeeded().cast("int").alias("execution_success"),
        _score().alias("score"),
        F.coalesce(F.col("recovered_from_failure"), F.lit(False)).cast("int").alias("recovered"),
        F.coalesce(F.col("iterations"), F.lit(1)).alias("iterations"),
        "created_at",
    )


__all__ = [
    "COMPONENTS",
    "run_history_row",
    "run_metrics",
    "suite_metrics",
]
