"""Scoring of whole run tables in one narrow pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscore.functions import critic as K
from runscore.functions import qualify as Q
from runscore.functions import scoring as S
from runscore.functions import text as X
from runscore.schemas import (
    COMPONENTS,
    FEEDBACK,
    PASS_THRESHOLD,
    QUALIFY_THRESHOLD,
)

TEXT_COLUMNS = [
    "task", "code", "stdout", "stderr", "summary", "files", "expected", "status",
    "error_message", "run_mode", "round_no",
]


def run_text(
    runs: DataFrame,
    *,
    expected: str | None = "expected_outputs",
    summary: str | None = "dataset_summary",
    iteration: str | None = None,
) -> DataFrame:
    """Add the flat text columns the scoring rules read, with nulls made empty.

    ``expected`` and ``summary`` name optional columns of ``runs``; a run record
    does not hold them, they come from the task catalogue and the data profile.
    """

    def optional(name: str | None, kind: str) -> Column:
        if name and name in runs.columns:
            return F.col(name)
        return F.lit(None).cast(kind)

    ex = F.col("execution")
    return runs.withColumns(
        {
            "task": F.coalesce(F.col("query"), F.lit("")),
            "code": F.coalesce(F.col("generated_code"), F.lit("")),
            "stdout": F.coalesce(ex["stdout"], F.lit("")),
            "stderr": F.coalesce(ex["stderr"], F.lit("")),
            "summary": F.coalesce(optional(summary, "string"), F.lit("")),
            "files": F.coalesce(ex["output_files"], F.array().cast("array<string>")),
            "expected": F.coalesce(
                optional(expected, "array<string>"), F.array().cast("array<string>")
            ),
            "status": ex["status"],
            "error_message": ex["error_message"],
            "run_mode": F.col("mode"),
            "round_no": F.coalesce(optional(iteration, "int"), F.lit(0)),
        }
    )


def text_flags(flat: DataFrame) -> DataFrame:
    """Add one boolean per text rule, each text scanned here and nowhere else."""
    task, code, stdout, stderr = (F.col(c) for c in ("task", "code", "stdout", "stderr"))
    status = F.col("status")
    executed = status.isNotNull()
    impute_failed = X.imputation_failed(stdout, task)
    return flat.withColumns(
        {
            "is_success": F.coalesce(status == "success", F.lit(False)),
            "is_failed": executed & (status != "success"),
            "is_critical": X.critical_stderr(stderr),
            "is_warned": X.warning_stderr(stderr),
            "impute_failed": impute_failed,
            "wants_viz": X.needs_viz(task),
            "wants_prep": X.needs_prep(task),
            "wants_ml": X.needs_ml(task),
            "shows_viz": X.has_viz(code, F.col("files")),
            "shows_prep": X.has_prep(code),
            "shows_ml": X.has_ml_metrics(stdout),
            "data_missing": X.summary_has_missing(F.col("summary")),
            "wants_before_after": X.needs_before_after(task),
            "shows_before_after": X.has_before_after(stdout),
            "got_worse": X.found(stdout, X.WORSE_WORD),
            "clips_early": X.involves_outliers(task) & X.clips_before_split(code),
            "lacks_engineering": X.lacks_engineering(task, code),
            "drops_twice": X.misuse_drop(code),
            "fills_inplace": X.misuse_fillna(code),
            "selects_object": X.misuse_select_dtypes(code),
            "leakage_task": X.is_leakage_task(task),
            "missing_metrics": X.missing_metrics(F.col("expected"), stdout),
        }
    )


def rule_scores(flagged: DataFrame) -> DataFrame:
    """Add execution, completeness, task and critic scores."""
    status = F.col("status")
    scored = flagged.withColumns(
        {
            "exec_score": S.capped_execution_score(
                S.execution_score(status, F.col("is_critical")), F.col("impute_failed")
            ),
            "complete": S.completeness(
                status, F.col("stdout"), F.col("files"), F.col("expected")
            ),
            **{
                f"c_{name}": score
                for name, score in K.component_scores(
                    K.evidence(F.col("code"), F.col("task"), F.col("summary"), F.col("stdout"))
                ).items()
            },
        }
    )
    return scored.withColumns(
        {
            "task_score": S.task_score(
                F.col("exec_score"),
                F.col("complete"),
                F.col("shows_viz") | ~F.col("wants_viz"),
                F.col("shows_ml") | ~F.col("wants_ml"),
            ),
            "decision_score": K.critic_score(component_columns()),
        }
    )


def component_columns(prefix: str = "c_") -> dict[str, Column]:
    return {name: F.col(prefix + name) for name in COMPONENTS}


def rule_gaps(
    flagged: DataFrame,
    *,
    require_clean_stderr: bool = False,
    fail_on_worsened: bool = True,
    threshold: float = QUALIFY_THRESHOLD,
) -> DataFrame:
    """Add the ordered rule gaps, their score, the verdict and its summary."""
    in_loop = F.col("run_mode") == FEEDBACK
    wants_figure = F.col("wants_viz") | F.exists(
        "expected", lambda name: F.lower(name).isin("png", "jpg", "svg")
    )
    prep_wanted = F.col("wants_prep") | (
        F.col("data_missing") & F.lower(F.col("task")).contains("imput")
    )
    metric_gaps = F.transform(
        "missing_metrics",
        lambda m: Q.gap(
            "metrics",
            F.concat(F.lit("Expected metric '"), m, F.lit("' not found in stdout.")),
            F.concat(F.lit("Print "), m, F.lit(" clearly in the output.")),
            "high",
        ),
    )
    warned = (
        Q.STDERR_WARNINGS[0],
        F.concat(F.lit(Q.STDERR_WARNINGS[1]), F.substring("stderr", 1, 300)),
        Q.STDERR_WARNINGS[2],
    )
    before_after = F.col("wants_before_after")
    got_worse = before_after & F.col("shows_before_after") & F.col("got_worse")
    worse_severity = "high" if fail_on_worsened else "medium"
    # (condition, gap, severity) in report order; metric gaps follow the leading ones
    leading = [
        (~F.col("is_success"), Q.NOT_EXECUTED, "high"),
        (
            F.col("is_success") & F.col("is_warned"),
            warned,
            "high" if require_clean_stderr else "medium",
        ),
        (wants_figure & ~F.col("shows_viz"), Q.NO_FIGURE, "high"),
    ]
    trailing = [
        (F.col("impute_failed"), Q.NOT_IMPUTED, "high"),
        (before_after & ~F.col("shows_before_after"), Q.NO_BEFORE_AFTER, "medium"),
        (got_worse & in_loop, Q.WORSENED, worse_severity),
        (got_worse & ~in_loop, Q.WORSENED, "medium"),
        (in_loop & F.col("clips_early"), Q.CLIPPED_EARLY, "medium"),
        (F.col("lacks_engineering"), Q.NOT_ENGINEERED, "medium"),
        (prep_wanted & ~F.col("shows_prep"), Q.NOT_PREPROCESSED, "medium"),
        (F.col("drops_twice"), Q.DROP_TWICE, "medium"),
        (F.col("fills_inplace"), Q.FILL_INPLACE, "medium"),
        (F.col("selects_object"), Q.OBJECT_DTYPES, "low"),
    ]

    def listed(rules: list[tuple]) -> Column:
        return Q.gap_list(*[F.when(c, Q.gap(*texts, level)) for c, texts, level in rules])

    def count(level: str) -> Column:
        hits = F.size("missing_metrics") if level == "high" else F.lit(0)
        for condition, _, severity in (*leading, *trailing):
            if severity == level:
                hits = hits + condition.cast("int")
        return hits

    # scores come from the conditions, so the arrays are built only if asked for
    counted = flagged.withColumns(
        {"n_high": count("high"), "n_medium": count("medium"), "n_low": count("low")}
    )
    scored = counted.withColumn(
        "gap_score", Q.counted_score(F.col("n_high"), F.col("n_medium"), F.col("n_low"))
    )
    verdict = Q.qualified(F.col("n_high"), F.col("gap_score"), F.col("is_success"), threshold)
    found = F.col("n_high") + F.col("n_medium") + F.col("n_low")
    return (
        scored.withColumn("is_qualified", verdict)
        .withColumn(
            "gap_summary", Q.qualify_summary(F.col("is_qualified"), found, F.col("gap_score"))
        )
        .withColumn("gaps", F.concat(listed(leading), metric_gaps, listed(trailing)))
    )


def with_judge(gapped: DataFrame, reply: str, threshold: float = QUALIFY_THRESHOLD) -> DataFrame:
    """Merge a judge reply column into the rule gaps; rows without one keep theirs."""
    merged = gapped.withColumn(
        "judged",
        Q.apply_judge(
            F.col("gaps"),
            F.col("gap_score"),
            F.col("gap_summary"),
            X.parse_judge_reply(F.col(reply)),
            threshold,
        ),
    )
    has_reply = F.col(reply).isNotNull()

    def pick(field: str, current: str) -> Column:
        return F.when(has_reply, F.col("judged")[field]).otherwise(F.col(current))

    return merged.withColumns(
        {
            "gaps": pick("gaps", "gaps"),
            "gap_score": pick("score", "gap_score"),
            "is_qualified": pick("qualified", "is_qualified"),
            "gap_summary": pick("summary", "gap_summary"),
        }
    ).drop("judged")


def with_feedback(
    gapped: DataFrame, threshold: float = PASS_THRESHOLD, judged: bool = False
) -> DataFrame:
    """Add feedback items merged with the gaps, the capped score and the verdict.

    Rule gaps with the same category and message are equal in all fields, so an
    array union merges them. Judge gaps may differ and need the keyed merge.
    """
    scores = component_columns()
    prep_wanted = F.col("wants_prep") | (F.col("data_missing") & F.col("wants_ml"))
    items = S.feedback_items(
        failed=F.col("is_failed"),
        critical=F.col("is_critical") & F.col("status").isNotNull(),
        imputation_failed=F.col("impute_failed"),
        viz_missing=F.col("wants_viz") & ~F.col("shows_viz"),
        complete=F.col("complete"),
        decision_score=F.col("decision_score"),
        business=scores["business_alignment"],
        explainability=scores["explainability"],
        prep_missing=prep_wanted & ~F.col("shows_prep"),
        stderr=F.col("stderr"),
        error_message=F.col("error_message"),
    )
    merge = Q.merge_gaps if judged else F.array_union
    has_advice = F.lit(False)
    for weak in K.needs_recommendation(scores, F.col("leakage_task")).values():
        has_advice = has_advice | weak
    return (
        gapped.withColumn(
            "capped_score",
            S.capped_score(
                F.col("task_score"),
                F.col("is_failed"),
                F.col("is_critical") & F.col("status").isNotNull(),
                F.col("impute_failed"),
            ),
        )
        .withColumn(
            "passed",
            S.passed(
                mode=F.col("run_mode"),
                status=F.col("status"),
                capped=F.col("capped_score"),
                score=F.col("task_score"),
                is_qualified=F.col("is_qualified"),
                decision_score=F.col("decision_score"),
                has_advice=has_advice,
                threshold=threshold,
            ),
        )
        .withColumn("own_items", items)
        .withColumn("items", merge(F.col("own_items"), F.col("gaps")))
    )


def score_table(
    runs: DataFrame,
    *,
    judge_reply: str | None = None,
    require_clean_stderr: bool = False,
    fail_on_worsened: bool = True,
    qualify_threshold: float = QUALIFY_THRESHOLD,
    pass_threshold: float = PASS_THRESHOLD,
    **inputs: str | None,
) -> DataFrame:
    """All rule columns in flat form; columns nobody reads are pruned."""
    gapped = rule_gaps(
        rule_scores(text_flags(run_text(runs, **inputs))),
        require_clean_stderr=require_clean_stderr,
        fail_on_worsened=fail_on_worsened,
        threshold=qualify_threshold,
    )
    if judge_reply:
        gapped = with_judge(gapped, judge_reply, qualify_threshold)
    return with_feedback(gapped, pass_threshold, judged=judge_reply is not None)


def evaluate_runs(runs: DataFrame, **options) -> DataFrame:
    """Replace ``evaluation`` by a fresh one and add the ``feedback`` struct.

    One projection chain, no shuffle. The structs are built without casts, so a
    reader of a few fields does not pay for the others. Options are those of :func:`score_table`.
    """
    table = score_table(runs, **options)
    scores = component_columns()
    critic = K.critic_struct(scores, F.col("decision_score"), F.col("leakage_task"))
    in_loop = F.col("run_mode") == FEEDBACK
    summary = (
        F.when(in_loop & F.col("passed"), F.lit(S.SUMMARY_LOOP_PASSED))
        .when(in_loop, F.lit(S.SUMMARY_LOOP_REVISE))
        .when(F.col("passed"), F.lit(S.SUMMARY_PASSED))
        .otherwise(F.lit(S.SUMMARY_REVISE))
    )
    table = table.withColumn("critic", critic)
    feedback = F.struct(
        F.col("round_no").alias("iteration"),
        F.round("capped_score", 3).alias("score"),
        F.col("passed"),
        F.col("items"),
        summary.alias("summary"),
        F.col("gap_score").alias("qualification_score"),
        F.col("is_qualified").alias("qualified"),
        F.col("decision_score"),
        F.col("critic.summary").alias("decision_summary"),
        F.col("critic.recommendations").alias("decision_recommendations"),
    )
    notes = F.concat(
        F.lit("Evaluated for: "), F.substring("task", 1, 200), F.lit(" | "), F.col("gap_summary")
    )
    evaluation = F.struct(
        F.col("task_score").alias("task_completion_score"),
        (F.col("exec_score") >= 1.0).alias("execution_success"),
        F.col("complete").alias("output_completeness"),
        F.col("shows_viz").alias("visualization_present"),
        F.col("shows_ml").alias("ml_metrics_valid"),
        notes.alias("notes"),
        F.col("gap_score").alias("qualification_score"),
        F.col("is_qualified").alias("task_qualified"),
        F.col("critic").alias("decision_evaluation"),
        F.col("decision_score").alias("decision_quality_score"),
        F.col("feedback").alias("structured_feedback"),
    )
    kept = [c for c in runs.columns if c not in ("evaluation", "feedback")]
    return (
        table.withColumn("feedback", feedback)
        .withColumn("evaluation", evaluation)
        .select(*kept, "evaluation", "feedback")
    )
