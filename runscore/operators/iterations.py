"""Operators over the ordered feedback rounds of a run.

Array forms read ``feedback_history``; row forms read one row per round with
``run_id`` and ``iteration``. The row forms use plain aggregates or a
``row_number`` filter that Spark applies before the shuffle, so a run with very
many rounds does not end up whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runscore.functions.rounding import stable_round
from runscore.schemas import FEEDBACK_DDL, MAX_ROUNDS


# --- array forms ------------------------------------------------------------
def latest_feedback(
    history: str = "feedback_history", evaluation: str = "evaluation"
) -> Column:
    """Last round, else the feedback kept in the evaluation, else null."""
    kept = F.col(evaluation)["structured_feedback"].cast(FEEDBACK_DDL)
    return F.coalesce(F.try_element_at(F.col(history), F.lit(-1)).cast(FEEDBACK_DDL), kept)


def feedback_improvement(history: str = "feedback_history") -> Column:
    """Last score minus the one before; 0 with fewer than two rounds."""
    rounds = F.col(history)
    last = F.try_element_at(rounds, F.lit(-1))["score"]
    previous = F.try_element_at(rounds, F.lit(-2))["score"]
    return F.coalesce(stable_round(last - previous, 4), F.lit(0.0))


def gap_trend(history: str = "feedback_history", evaluation: str = "evaluation") -> Column:
    """Number of gaps in the latest round."""
    items = latest_feedback(history, evaluation)["items"]
    return F.when(items.isNull(), F.lit(0)).otherwise(F.size(items))


def feedback_digest(history: str = "feedback_history") -> Column:
    """Readable text of all rounds, in order."""

    def item_lines(item: Column) -> Column:
        return F.concat(
            F.lit("  - ["), item["severity"], F.lit("] "), item["category"], F.lit(": "),
            item["message"], F.lit("\n    Recommendation: "), item["recommendation"],
        )

    def round_text(fb: Column) -> Column:
        head = F.format_string(
            "Iteration %d (score=%.2f): %s",
            fb["iteration"], fb["score"], F.coalesce(fb["summary"], F.lit("")),
        )
        decision = F.when(
            fb["decision_score"].isNotNull(),
            F.format_string(
                "  - Decision score: %.1f/100\n  - Decision summary: %s",
                fb["decision_score"], F.coalesce(fb["decision_summary"], F.lit("")),
            ),
        )
        gaps = F.when(
            F.size(fb["items"]) > 0, F.array_join(F.transform(fb["items"], item_lines), "\n")
        )
        advice = F.when(
            F.size(fb["decision_recommendations"]) > 0,
            F.concat(
                F.lit("  - Decision recommendations:\n"),
                F.array_join(
                    F.transform(
                        fb["decision_recommendations"],
                        lambda line: F.concat(F.lit("    * "), line),
                    ),
                    "\n",
                ),
            ),
        )
        return F.concat_ws("\n", head, decision, gaps, advice)

    rounds = F.col(history)
    return F.when(
        F.coalesce(F.size(rounds), F.lit(0)) > 0,
        F.array_join(F.transform(rounds, round_text), "\n"),
    ).otherwise(F.lit("No prior feedback."))


# --- row forms --------------------------------------------------------------
def explode_rounds(runs: DataFrame) -> DataFrame:
    """One row per (run, round); runs without rounds disappear."""
    return runs.select(
        "run_id", F.posexplode("feedback_history").alias("position", "round")
    ).select("run_id", "position", "round.*")


def round_improvement(rounds: DataFrame) -> DataFrame:
    """Last minus previous score per run, from rows."""
    recent_first = Window.partitionBy("run_id").orderBy(F.col("iteration").desc())
    last_two = rounds.withColumn("recency", F.row_number().over(recent_first)).where(
        F.col("recency") <= 2
    )

    def score_at(rank: int) -> Column:
        return F.max(F.when(F.col("recency") == rank, F.col("score")))

    return last_two.groupBy("run_id").agg(
        F.coalesce(stable_round(score_at(1) - score_at(2), 4), F.lit(0.0)).alias("improvement")
    )


def recovered(rounds: DataFrame, failed: str = "failed") -> DataFrame:
    """Runs where some round failed and a later round succeeded.

    That holds exactly when the first failure comes before the last success.
    """
    return rounds.groupBy("run_id").agg(
        F.coalesce(
            F.min(F.when(F.col(failed), F.col("iteration")))
            < F.max(F.when(~F.col(failed), F.col("iteration"))),
            F.lit(False),
        ).alias("recovered")
    )


def effective_rounds(rounds: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Rounds up to and including the first pass, at most ``max_rounds``."""
    in_order = Window.partitionBy("run_id").orderBy("iteration")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        rounds.withColumn("round_rank", F.row_number().over(in_order))
        .where(F.col("round_rank") <= max_rounds)
        .withColumn("passed_before", F.max(F.col("passed").cast("int")).over(earlier))
        .where(F.coalesce(F.col("passed_before"), F.lit(0)) == 0)
        .drop("round_rank", "passed_before")
    )
