"""Summaries and rankings over the long pair table.

Input rows: task_id, metric, baseline, feedback, delta, improved. Values may be
null where a side is missing. ``from_comparison`` converts the output of
``compare_pairs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runscore.functions.rounding import stable_round
from runscore.operators.compare import with_task_meta
from runscore.operators.ordered import attach, exact_percentiles, medians, running_totals
from runscore.schemas import COMPONENTS, DIFFICULTY_RANK, METRICS

LEADER_METRICS = ["ORS", "DQS", "FIS", "BAS"]


def from_comparison(comparison: DataFrame) -> DataFrame:
    return comparison.withColumnRenamed("feedback_loop", "feedback")


def _order_of(names: list[str], column: str) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column))


def overall_metrics(pairs: DataFrame) -> DataFrame:
    """Means, median and population spread of delta, and improvement per metric."""
    means = pairs.groupBy("metric").agg(
        F.coalesce(F.avg("baseline"), F.lit(0.0)).alias("b"),
        F.coalesce(F.avg("feedback"), F.lit(0.0)).alias("f"),
        F.coalesce(F.avg("delta"), F.lit(0.0)).alias("d"),
        F.coalesce(F.stddev_pop("delta"), F.lit(0.0)).alias("s"),
    )
    joined = attach(means, medians(pairs, "delta", ["metric"], "m"), ["metric"], "left")
    percent = F.coalesce(F.try_divide(F.col("d"), F.col("b")) * 100.0, F.lit(0.0))
    return joined.select(
        "metric",
        stable_round(F.col("b"), 4).alias("baseline_mean"),
        stable_round(F.col("f"), 4).alias("feedback_mean"),
        stable_round(F.col("d"), 4).alias("mean_delta"),
        stable_round(F.coalesce(F.col("m"), F.lit(0.0)), 4).alias("median_delta"),
        stable_round(F.col("s"), 4).alias("std_dev"),
        stable_round(percent, 2).alias("improvement_pct"),
    )


def benchmark_statistics(pairs: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """One wide row per task with presence tags."""

    def pick(metric: str, column: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col(column)))

    known = pairs.where(F.col("metric").isin(METRICS))
    wide = known.groupBy("task_id").agg(
        *[
            pick(m, column).alias(f"{m}_{column.title()}")
            for m in METRICS
            for column in ("baseline", "feedback", "delta", "improved")
        ]
    )

    def tags(side: str) -> list[Column]:
        return [
            F.when(F.col(f"{m}_{side.title()}").isNotNull(), F.lit(f"{side}:ok")).otherwise(
                F.lit(f"{side}:missing")
            )
            for m in METRICS
        ]

    presence = F.array(*tags("baseline"), *tags("feedback"))
    wide = wide.withColumn(
        "Execution_Status", F.array_join(F.array_sort(F.array_distinct(presence)), ";")
    )
    return wide if tasks is None else with_task_meta(wide, tasks)


def overall_breakdown(breakdown: DataFrame) -> DataFrame:
    """Mean per side, difference of means and improved count per component."""
    b = F.coalesce(F.avg("baseline"), F.lit(0.0))
    f = F.coalesce(F.avg("feedback_loop"), F.lit(0.0))
    return breakdown.groupBy("component").agg(
        stable_round(b, 4).alias("baseline"),
        stable_round(f, 4).alias("feedback"),
        stable_round(f - b, 4).alias("delta"),
        F.count_if(F.coalesce(F.col("improved"), F.lit(False))).alias("improved_count"),
    )


def leaderboard(pairs: DataFrame) -> DataFrame:
    """Four deltas, the improved count and the rank per task, best ORS gain first.

    Tasks of equal gain share a rank; they are ordered by id.
    """

    def delta(metric: str) -> Column:
        return F.coalesce(
            F.max(F.when(F.col("metric") == metric, F.col("delta"))), F.lit(0.0)
        ).alias(f"{metric}_Delta")

    improved = F.col("improved") & F.col("metric").isin(METRICS)
    board = pairs.groupBy("task_id").agg(
        *[delta(m) for m in LEADER_METRICS],
        F.count_if(F.coalesce(improved, F.lit(False))).alias("Execution_Improved_Count"),
    )
    ties = board.groupBy((-F.col("ORS_Delta")).alias("falling")).agg(F.count(F.lit(1)).alias("n"))
    ahead = running_totals(ties, "falling", ["n"]).select(
        (-F.col("falling")).alias("ORS_Delta"), (F.col("n_before") + 1).alias("rank")
    )
    return attach(board, ahead, ["ORS_Delta"], "left").orderBy(F.col("ORS_Delta").desc(), F.col("task_id"))


def _ranked(pairs: DataFrame) -> DataFrame:
    delta = F.coalesce(F.col("delta"), F.lit(0.0)).alias("delta")
    values = pairs.select("metric", "task_id", delta)
    order = F.col("delta").desc()
    return values.withColumn(
        "position",
        F.row_number().over(Window.partitionBy("metric").orderBy(order, "task_id")),
    )


def top_improvements(pairs: DataFrame, k: int = 5, metrics: list[str] | None = None) -> DataFrame:
    """Best ``k`` tasks per metric; absent deltas count as 0, ties by task id."""
    wanted = pairs if metrics is None else pairs.where(F.col("metric").isin(metrics))
    return _ranked(wanted).where(F.col("position") <= k)


def extreme_tasks(pairs: DataFrame) -> DataFrame:
    """First and last task of every metric's ranking."""
    delta = F.coalesce(F.col("delta"), F.lit(0.0))
    values = pairs.select("metric", "task_id", delta.alias("delta"))
    # the last task of a stable descending sort is the largest id of the lowest delta
    falling = F.struct((-F.col("delta")).alias("key"), "task_id", "delta")
    ends = values.where(F.col("task_id").isNotNull()).groupBy("metric").agg(
        F.min(falling).alias("first"), F.max(falling).alias("last")
    )
    return ends.select(
        "metric",
        F.col("first.task_id").alias("first_task"),
        F.col("first.delta").alias("first_delta"),
        F.col("last.task_id").alias("last_task"),
        F.col("last.delta").alias("last_delta"),
    )


def presence_counts(pairs: DataFrame) -> DataFrame:
    """Tasks in total and with any value on each side.

    Counts over one row per task, so no wide distinct expansion is needed.
    """
    known = F.col("metric").isin(METRICS)
    per_task = pairs.groupBy("task_id").agg(
        F.bool_or(known & F.col("baseline").isNotNull()).alias("b"),
        F.bool_or(known & F.col("feedback").isNotNull()).alias("f"),
    )
    return per_task.agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if("b").alias("with_baseline"),
        F.count_if("f").alias("with_feedback"),
    )


def average_feedback(pairs: DataFrame) -> DataFrame:
    mean = F.coalesce(F.avg("feedback"), F.lit(0.0))
    return pairs.groupBy("metric").agg(stable_round(mean, 4).alias("mean_feedback"))


def hardest_task(tasks: DataFrame) -> DataFrame:
    """Task of the highest difficulty; the first id on ties."""
    rank = F.lit(0)
    for name, value in DIFFICULTY_RANK.items():
        rank = F.when(F.col("difficulty") == name, F.lit(value)).otherwise(rank)
    first = F.struct((-rank).alias("rank"), F.col("task_id"))
    return tasks.agg(
        F.min_by("task_id", first).alias("task_id"),
        F.min_by("difficulty", first).alias("difficulty"),
    )


def dataset_ranking(pairs: DataFrame) -> DataFrame:
    """Mean feedback ORS per dataset, flagged best and worst.

    Input needs a ``dataset`` column. Ties go to the dataset of the first task.
    """
    scored = pairs.where((F.col("metric") == "ORS") & F.col("feedback").isNotNull())
    means = scored.groupBy(F.coalesce(F.col("dataset"), F.lit("")).alias("dataset")).agg(
        F.avg("feedback").alias("mean_ors"), F.min("task_id").alias("first_task")
    )
    high = F.struct((-F.col("mean_ors")).alias("key"), F.col("first_task"))
    low = F.struct(F.col("mean_ors").alias("key"), F.col("first_task"))
    best = means.agg(F.min_by("dataset", high)).scalar()
    worst = means.agg(F.min_by("dataset", low)).scalar()
    return means.select(
        "dataset",
        stable_round(F.col("mean_ors"), 4).alias("mean_ors"),
        (F.col("dataset") == best).alias("is_best"),
        (F.col("dataset") == worst).alias("is_worst"),
    )


def case_studies(pairs: DataFrame) -> DataFrame:
    """Representative tasks: best ORS, DQS and FIS gain and largest ORS loss; one pass over the pairs."""
    delta = F.coalesce(F.col("delta"), F.lit(0.0))

    def first(metric: str, key: Column) -> Column:
        entry = F.struct(key.alias("key"), F.col("task_id"), delta.alias("delta"))
        return F.min(F.when(F.col("metric") == metric, entry))

    picks = {
        "highest_ors_improvement": first("ORS", -delta),
        "highest_dqs_improvement": first("DQS", -delta),
        "highest_fis_improvement": first("FIS", -delta),
        "largest_degradation": first("ORS", delta),
    }
    row = pairs.agg(*[pick.alias(name) for name, pick in picks.items()])
    found = F.array(
        *[
            F.when(F.col(name).isNotNull(), F.struct(F.lit(name).alias("category"), f"{name}.task_id", f"{name}.delta"))
            for name in picks
        ]
    )
    return row.select(F.explode(F.array_compact(found)).alias("pick")).select("pick.*")


def case_study_rows(pairs: DataFrame) -> DataFrame:
    """The pair rows that belong to the representative tasks."""
    return pairs.join(case_studies(pairs).select("task_id"), "task_id", "left_semi")


def delta_distribution(
    pairs: DataFrame, bins: int = 20, by: list[str] | None = None
) -> DataFrame:
    """Equal-width histogram of deltas per group; the top edge is in the last bin.

    ``by`` defaults to the metric; an empty list gives one histogram over all.
    """
    by = ["metric"] if by is None else list(by)
    values = pairs.where(F.col("delta").isNotNull()).select(*by, "delta")
    edges = [F.min("delta").alias("low"), F.max("delta").alias("high")]
    if by:
        spread = attach(values, values.groupBy(*by).agg(*edges), by)
    else:
        spread = values.withColumns(
            {
                "low": values.agg(F.min("delta")).scalar(),
                "high": values.agg(F.max("delta")).scalar(),
            }
        )
    # a constant column gets a unit range around its value
    flat = F.col("low") == F.col("high")
    low = F.when(flat, F.col("low") - 0.5).otherwise(F.col("low"))
    high = F.when(flat, F.col("high") + 0.5).otherwise(F.col("high"))
    number = F.floor((F.col("delta") - low) * bins / (high - low))
    return (
        spread.withColumn("bin", F.least(F.lit(bins - 1), number).cast("int"))
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def delta_boxplot(pairs: DataFrame, whisker: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends and outlier count of the deltas per metric."""
    values = pairs.where(F.col("delta").isNotNull()).select("metric", "delta")
    quartiles = exact_percentiles(values, "delta", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, ["metric"])
    reach = whisker * (F.col("q3") - F.col("q1"))
    joined = attach(values, quartiles, ["metric"])
    inside = F.col("delta").between(F.col("q1") - reach, F.col("q3") + reach)
    return joined.groupBy("metric", "q1", "q2", "q3").agg(
        F.min(F.when(inside, F.col("delta"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("delta"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def metric_mean_correlation(pairs: DataFrame) -> DataFrame:
    """Correlation of the baseline means with the feedback means over the metrics."""
    return overall_metrics(pairs).agg(
        stable_round(F.corr("baseline_mean", "feedback_mean"), 4).alias("correlation")
    )


def in_metric_order(table: DataFrame) -> DataFrame:
    return table.orderBy(_order_of(METRICS, "metric"))


def in_component_order(table: DataFrame) -> DataFrame:
    return table.orderBy(_order_of(list(COMPONENTS.values()), "component"))
