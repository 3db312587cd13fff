"""Pairing of two conditions by task, and the tables derived from the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runscore.functions.rounding import stable_round
from runscore.operators.iterations import gap_trend, latest_feedback
from runscore.operators.metrics import suite_metrics
from runscore.schemas import BASELINE, COMPONENT_GATE, COMPONENTS, FEEDBACK, METRICS
from runscore.sources.batches import append_batch
from runscore.sources.runs import SUITE_PREFIX

# --- fixed values: interpretation texts -------------------------------------
READ_GAIN = (
    "The feedback improved analytical decision quality, especially where component scores "
    "increased."
)
READ_LOSS = (
    "The feedback did not improve the highest-impact analytical decisions, so the overall "
    "feedback improvement score remained negative."
)
READ_FLAT = "Feedback had no net effect on the analytical decision quality profile."
# ----------------------------------------------------------------------------

LOGGED_METRICS = [m for m in METRICS if m != "RR"]


def with_task_id(runs: DataFrame) -> DataFrame:
    """Add ``task_id`` from the metadata map unless the column exists."""
    if "task_id" in runs.columns:
        return runs
    return runs.withColumn("task_id", F.try_element_at(F.col("metadata"), F.lit("task_id")))


def latest_per_task(
    runs: DataFrame,
    *,
    task_id: str | None = None,
    first_result_only: bool = False,
) -> DataFrame:
    """Run per (mode, task) of the newest file; within a file the first one.

    ``file_name`` is required. ``position`` is the place of a run in its file;
    without that column the smallest run_id counts as the first.

    The ``row_number() = 1`` filter becomes a group limit ahead of the shuffle,
    so each input partition ships at most one row per key, however many runs a
    single task has. ``first_result_only`` sees only the first run of a file.
    """
    placed = "position" in runs.columns
    if first_result_only and not placed:
        raise ValueError("first_result_only needs a position column")
    keyed = with_task_id(runs).where(F.coalesce(F.col("task_id"), F.lit("")) != "")
    if task_id is not None:
        keyed = keyed.where(F.col("task_id") == task_id)
    if first_result_only:
        keyed = keyed.where(F.col("position") == 0)
    order = [F.col("file_name").desc(), *(["position"] if placed else []), "run_id"]
    newest = Window.partitionBy("mode", "task_id").orderBy(*order)
    return (
        keyed.withColumn("newest_rank", F.row_number().over(newest))
        .where(F.col("newest_rank") == 1)
        .drop("newest_rank")
    )


def match_task(runs: DataFrame, task_id: str | None) -> DataFrame:
    """Per file the run of the asked task, else the file's first run."""
    keyed = with_task_id(runs)
    asked = F.coalesce(F.col("task_id") == F.lit(task_id), F.lit(False))
    choice = Window.partitionBy("mode", "file_name").orderBy(asked.desc(), F.col("position"))
    return (
        keyed.withColumn("choice", F.row_number().over(choice))
        .where(F.col("choice") == 1)
        .drop("choice")
    )


def by_mode(runs: DataFrame, mode: str) -> DataFrame:
    return runs.where(F.col("mode") == mode)


def paired_ids(runs: DataFrame) -> DataFrame:
    """Task ids present in both conditions."""
    keyed = with_task_id(runs)
    return by_mode(keyed, BASELINE).select("task_id").intersect(
        by_mode(keyed, FEEDBACK).select("task_id")
    )


def unpaired(runs: DataFrame) -> DataFrame:
    """Task ids present in one condition only, with that condition."""
    return (
        with_task_id(runs)
        .groupBy("task_id")
        .agg(F.min("mode").alias("mode"), F.max("mode").alias("other"))
        .where(F.col("task_id").isNotNull() & (F.col("mode") == F.col("other")))
        .select("task_id", "mode")
    )


def pair_runs(runs: DataFrame, **latest) -> DataFrame:
    """Latest baseline run joined with the latest feedback run of the same task.

    Each side has one row per task, so the join cannot multiply a hot task.
    The result holds the two records as structs ``b`` and ``f``.
    """
    chosen = latest_per_task(runs, **latest)

    def side(mode: str, name: str) -> DataFrame:
        picked = by_mode(chosen, mode)
        record = F.struct(*[F.col(c) for c in picked.columns if c != "task_id"])
        return picked.select("task_id", record.alias(name))

    return side(BASELINE, "b").join(side(FEEDBACK, "f"), "task_id")


def long_comparison(
    values: DataFrame, keys: list[str], names: list[str], label: str = "metric"
) -> DataFrame:
    """Wide values per (keys, mode) to rows (label, baseline, feedback_loop, delta, improved).

    Reshapes and pairs in a single aggregate: every (keys, name) has at most
    one row per mode.
    """
    tall = values.unpivot([*keys, "mode"], names, label, "value")

    def pick(mode: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("mode") == mode, F.col("value"))), F.lit(0.0))

    paired = tall.groupBy(*keys, label).agg(
        pick(BASELINE).alias("baseline"), pick(FEEDBACK).alias("feedback_loop")
    )
    return with_delta(paired)


def with_delta(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns(
        {
            "delta": stable_round(F.col("feedback_loop") - F.col("baseline"), 4),
            "improved": F.col("feedback_loop") > F.col("baseline"),
        }
    )


def compare_metrics(runs: DataFrame) -> DataFrame:
    """Eight rows comparing the suite metrics of the two conditions."""
    return long_comparison(suite_metrics(runs, ["mode"]), [], METRICS)


def compare_latest(runs: DataFrame) -> DataFrame:
    """Comparison of the newest suite file of each condition, tasks unpaired.

    A condition without suite files takes all of its files. A file without runs
    is not seen here; ``read_latest`` of both folders takes it into account.
    """
    is_suite = F.col("file_name").startswith(SUITE_PREFIX)
    newest = runs.groupBy("mode").agg(F.max(F.when(is_suite, F.col("file_name"))).alias("newest"))
    chosen = runs.join(newest, "mode").where(F.col("newest").isNull() | (F.col("file_name") == F.col("newest")))
    return compare_metrics(chosen.drop("newest"))


def compare_two_files(baseline: DataFrame, feedback: DataFrame) -> DataFrame:
    """Eight rows comparing the first run of each of two files, whatever their tasks and modes."""
    return compare_metrics(_first_of_each(baseline, feedback))


def breakdown_of_two_files(baseline: DataFrame, feedback: DataFrame) -> DataFrame:
    """Eight component rows for the first run of each of two files; 0 where a side has no critic."""
    return _long_breakdown(_first_of_each(baseline, feedback), [])


def _first_of_each(baseline: DataFrame, feedback: DataFrame) -> DataFrame:
    """The first runs of two files, taken as the two conditions; an error if a file has none (action)."""

    def first(runs: DataFrame, mode: str) -> DataFrame:
        return runs.orderBy("position").limit(1).withColumn("mode", F.lit(mode))

    both = first(baseline, BASELINE).unionByName(first(feedback, FEEDBACK))
    if both.select("mode").count() < 2:
        raise ValueError("one or both files hold no run")
    return both


def paired_runs_long(runs: DataFrame, **latest) -> DataFrame:
    """Latest runs of paired tasks in long form, one row per (task, mode)."""
    chosen = latest_per_task(runs, **latest)
    both = Window.partitionBy("task_id")
    return (
        chosen.where(F.col("mode").isin(BASELINE, FEEDBACK))
        .withColumn("sides", F.count(F.lit(1)).over(both))
        .where(F.col("sides") == 2)
        .drop("sides")
    )


def compare_final(runs: DataFrame, **latest) -> DataFrame:
    """Eight rows over all paired tasks."""
    return compare_metrics(paired_runs_long(runs, **latest))


def compare_pairs(runs: DataFrame, **latest) -> DataFrame:
    """Eight rows for every paired task at once."""
    metrics = suite_metrics(paired_runs_long(runs, **latest), ["task_id", "mode"])
    return long_comparison(metrics, ["task_id"], METRICS)


def decision_breakdown(runs: DataFrame, **latest) -> DataFrame:
    """Eight component rows for every paired task; 0 where a side has no critic."""
    return _long_breakdown(paired_runs_long(runs, **latest), ["task_id"])


def _long_breakdown(runs: DataFrame, keys: list[str]) -> DataFrame:
    scores = F.col("evaluation")["decision_evaluation"]["scores"]
    wide = runs.select(
        *keys,
        "mode",
        *[
            F.coalesce(F.round(scores[field], 4), F.lit(0.0)).alias(name)
            for field, name in COMPONENTS.items()
        ],
    )
    return long_comparison(wide, keys, list(COMPONENTS.values()), "component")


def radar_series(breakdown: DataFrame) -> DataFrame:
    """Component profile per task and condition."""
    return breakdown.unpivot(
        ["task_id", "component"], ["baseline", "feedback_loop"], "mode", "score"
    ).withColumn("axis", component_index())


def comparison_details(runs: DataFrame, **latest) -> DataFrame:
    """One row per pair with scores, verdicts, iterations and gap counts."""
    facts = {
        "score": F.coalesce(F.col("evaluation")["task_completion_score"], F.lit(0.0)),
        "passed": F.coalesce(latest_feedback()["passed"], F.lit(False)),
        "iterations": F.coalesce(F.col("iterations"), F.lit(0)),
        "qualified": F.coalesce(
            F.col("evaluation")["task_qualified"], latest_feedback()["qualified"], F.lit(False)
        ),
        "recovered": F.coalesce(F.col("recovered_from_failure"), F.lit(False)),
        "gaps": gap_trend(),
    }
    flat = latest_per_task(runs, **latest).select(
        "task_id", "mode", *[value.alias(name) for name, value in facts.items()]
    )
    baseline = by_mode(flat, BASELINE).alias("b")
    feedback = by_mode(flat, FEEDBACK).alias("f")
    return baseline.join(feedback, "task_id").select(
        "task_id",
        F.col("b.score").alias("baseline_score"),
        F.col("f.score").alias("feedback_score"),
        F.col("b.passed").alias("baseline_passed"),
        F.col("f.passed").alias("feedback_passed"),
        F.col("b.iterations").alias("baseline_iterations"),
        F.col("f.iterations").alias("feedback_iterations"),
        F.col("b.qualified").alias("baseline_qualified"),
        F.col("f.qualified").alias("feedback_qualified"),
        F.col("f.recovered").alias("feedback_recovered"),
        F.col("b.gaps").alias("qualification_gap_count_baseline"),
        F.col("f.gaps").alias("qualification_gap_count_feedback"),
    )


def component_index() -> Column:
    names = F.array(*[F.lit(n) for n in COMPONENTS.values()])
    return F.array_position(names, F.col("component"))


def _component_lists(breakdown: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Per task the components meeting each condition, in component order.

    A task has eight components, so the lists have at most eight entries.
    """

    def names(condition: Column) -> Column:
        entry = F.struct(component_index().alias("at"), F.col("component").alias("name"))
        found = F.array_sort(F.collect_list(F.when(condition, entry)))
        return F.transform(found, lambda e: e["name"])

    return breakdown.groupBy("task_id").agg(
        *[names(condition).alias(name) for name, condition in conditions.items()]
    )


def impact_lists(breakdown: DataFrame) -> DataFrame:
    delta = F.col("delta")
    return _component_lists(
        breakdown,
        {"positive": delta > 0, "neutral": F.abs(delta) < 1e-9, "negative": delta < 0},
    )


def needs_attention(breakdown: DataFrame) -> DataFrame:
    weak = (F.col("feedback_loop") < COMPONENT_GATE) | (F.col("delta") < 1.0)
    return _component_lists(breakdown, {"components": weak})


def breakdown_extremes(breakdown: DataFrame) -> DataFrame:
    """Best and worst score, largest gain and loss, and mean delta per task."""
    at = component_index()
    score, delta, name = F.col("feedback_loop"), F.col("delta"), F.col("component")
    highest, lowest = F.struct(score, -at), F.struct(score, at)
    gain = F.when(delta > 0, F.struct(delta, -at))
    loss = F.when(delta < 0, F.struct(delta, at))
    return breakdown.groupBy("task_id").agg(
        F.max_by(name, highest).alias("highest_component"),
        F.max(score).alias("highest_score"),
        F.min_by(name, lowest).alias("lowest_component"),
        F.min(score).alias("lowest_score"),
        F.max_by(name, gain).alias("gain_component"),
        F.max(F.when(delta > 0, delta)).alias("gain"),
        F.min_by(name, loss).alias("loss_component"),
        F.min(F.when(delta < 0, delta)).alias("loss"),
        stable_round(F.avg(delta), 4).alias("mean_delta"),
    )


def interpretation(comparison: DataFrame) -> DataFrame:
    """Reading of the feedback improvement per task."""
    return comparison.where(F.col("metric") == "FIS").select(
        "task_id",
        "delta",
        F.when(F.col("delta") > 0, F.lit(READ_GAIN))
        .when(F.col("delta") < 0, F.lit(READ_LOSS))
        .otherwise(F.lit(READ_FLAT))
        .alias("interpretation"),
    )


def comparison_log(runs: DataFrame, *, logged_at: Column | None = None, **latest) -> DataFrame:
    """One wide row per pair: files, ids, seven metrics per side, critic confidence."""
    values = compare_pairs(runs, **latest).where(F.col("metric").isin(LOGGED_METRICS))
    wide = values.groupBy("task_id").agg(
        *[
            F.max(F.when(F.col("metric") == m, F.col(source))).alias(f"{m}_{suffix}")
            for m in LOGGED_METRICS
            for source, suffix in (("baseline", "baseline"), ("feedback_loop", "feedback"))
        ]
    )

    def of(mode: str, value: Column) -> Column:
        return F.max(F.when(F.col("mode") == mode, value))

    # a paired task has one run per mode
    files = paired_runs_long(runs, **latest).groupBy("task_id").agg(
        of(BASELINE, F.col("file_name")).alias("baseline_file"),
        of(FEEDBACK, F.col("file_name")).alias("feedback_file"),
        F.concat(F.lit("comparison_metrics_"), F.col("task_id"), F.lit(".csv")).alias(
            "output_file"
        ),
        of(FEEDBACK, F.col("evaluation")["decision_evaluation"]["confidence"]).alias("decision_critic_confidence"),
    )
    stamp = F.current_timestamp() if logged_at is None else logged_at
    return (
        files.join(wide, "task_id")
        .withColumn("timestamp", stamp)
        .withColumnRenamed("task_id", "baseline_task_id")
        .withColumn("feedback_task_id", F.col("baseline_task_id"))
    )


def log_comparisons(runs: DataFrame, path: str, batch: str, **options) -> None:
    """Append the comparison log of new runs as a batch (action).

    The same batch again replaces its rows; read with ``read_batches``.
    """
    append_batch(comparison_log(runs, **options), path, batch)


def with_task_meta(table: DataFrame, tasks: DataFrame) -> DataFrame:
    """Add dataset and difficulty from the task catalogue; missing ones are empty.

    The catalogue is joined without a hint: Spark broadcasts it when its size
    is under the session's limit and shuffles otherwise.
    """
    meta = tasks.select(
        F.col("id").alias("task_id"), F.col("dataset"), F.col("difficulty")
    )
    return table.join(meta, "task_id", "left").na.fill("", ["dataset", "difficulty"])


def before_after(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Two metric tables (keys, value) joined on their keys, with delta and improved.

    Both tables must have one row per key.
    """
    left = before.select(*keys, F.col("value").alias("baseline"))
    right = after.select(*keys, F.col("value").alias("feedback_loop"))
    return with_delta(left.join(right, keys))
