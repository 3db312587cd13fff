"""Scoring rules on single records, with the whole result of each."""

import pytest
from helpers import frame, run
from pyspark.sql import functions as F

from runscore.functions import text as X
from runscore.operators.scoring import evaluate_runs, score_table
from runscore.plans.fixtures import logs, run_records


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def scored(spark, record, **options):
    return score_table(frame(spark, record), **options).first()


@pytest.mark.parametrize(
    ("task", "needs"),
    [
        ("Draw a heatmap of the tides", (True, False, False)),
        ("One-hot the harbour names", (False, True, False)),
        ("Report recall per harbour", (False, False, True)),
        ("List the stations", (False, False, False)),
        ("Fill  missing depths, train on them and savefig the residuals", (True, True, True)),
    ],
)
def test_what_a_task_asks_for(spark, task, needs):
    text = F.lit(task)
    assert tuple(one(spark, f(text)) for f in (X.needs_viz, X.needs_prep, X.needs_ml)) == needs


@pytest.mark.parametrize(
    ("summary", "missing"),
    [
        ("12 columns\nMissing values: {'depth': 0, 'salt': 3}", True),
        ("Missing values: {'depth': 0, 'salt': 0}", False),
        ("Missing values: {}", False),
        ("depth: 4", False),
    ],
)
def test_gaps_in_the_data_summary(spark, summary, missing):
    assert one(spark, X.summary_has_missing(F.lit(summary))) is missing


@pytest.mark.parametrize(
    ("task", "initial", "after", "failed"),
    [
        ("Fill missing mm with the mean", 7, 7, True), ("Fill missing mm with the mean", 7, 2, False),
        ("Fill missing mm with the mean", 0, 0, False), ("Sum up mm", 7, 7, False),
    ],
)
def test_counts_that_did_not_fall(spark, task, initial, after, failed):
    out = F.lit(f"Missing mm (initial): {initial}\nMissing mm (after mean): {after}")
    assert one(spark, X.imputation_failed(out, F.lit(task))) is failed


# status, stderr, stdout, files, expected files -> execution score, completeness, score, capped score.
# A task without any need has both bonuses: 0.4 x execution + 0.3 x completeness + 0.3.
SCORES = [
    ("success", "", "3 stations", (), (), 1.0, 0.6, 0.88, 0.88),
    ("success", "", "", (), (), 1.0, 0.3, 0.79, 0.79),
    ("success", "", "3 stations", ("stations.txt", "rest.txt"), ("stations", "lines", "rest", "q"), 1.0, 0.9, 0.97, 0.97),
    ("success", "ParserError: line 8 has too few fields", "3 stations", ("stations.txt",), ("stations", "lines"), 0.55, 0.9, 0.79, 0.5),
    ("failure", "ZeroDivisionError", "", (), (), 0.4, 0.3, 0.55, 0.4),
    ("timeout", "", "", (), (), 0.2, 0.3, 0.47, 0.4),
    ("blocked", "", "", (), (), 0.0, 0.3, 0.39, 0.39),
]


@pytest.mark.parametrize(("status", "stderr", "stdout", "files", "expected", "execution", "complete", "score", "capped"), SCORES)
def test_scores_of_a_plain_task(spark, status, stderr, stdout, files, expected, execution, complete, score, capped):
    row = scored(spark, run("show()", "List the stations", stdout, stderr, status, files, expected))
    found = [row[c] for c in ("exec_score", "complete", "task_score", "capped_score")]
    assert found == pytest.approx([execution, complete, score, capped])


def test_nothing_was_executed(spark):
    record = run("show()", "List the stations")
    row = scored(spark, {**record, "execution": None})
    assert (row["exec_score"], row["complete"], row["task_score"]) == (0.0, 0.0, 0.3)


def test_every_component_of_the_critic(spark):
    record = run(
        "rides = rides.dropna()\nrides['temp'].clip(0, 40)\nmodel = LinearRegression()\nprint(rides.head())",
        "Compare two ways to forecast bike rentals and reduce waiting risk", "mae 3.1",
        summary="Missing values: {'temp': 4}",
    )
    evaluation = evaluate_runs(frame(spark, record)).first()["evaluation"]
    critic = evaluation["decision_evaluation"]
    assert critic["scores"].asDict() == {
        "data_understanding": 4 + 2 + 1 + 1,  # head, dropna, the summary
        "preprocessing": 4 + 2 * 0.5,  # dropna, clip
        "feature_engineering": 3 + 2,  # dropna holds "drop"
        "model_selection": 4 + 1.5 + 1,  # one family, compare
        "evaluation_strategy": 4 + 2 + 1,  # mae, reduce
        "statistical_validity": 4,
        "business_alignment": 4 + 2 + 1,  # reduce and risk, mae
        "explainability": 2,
    }
    assert critic["decision_score"] == 55.6 and critic["confidence"] == 0.79
    assert len(critic["strengths"]) == 1 and len(critic["weaknesses"]) == 3
    assert [line.split()[0] for line in critic["recommendations"]] == ["Refine", "Compare", "Add"]
    assert evaluation["decision_quality_score"] == 55.6


ADVICE = [("decision", "medium"), ("business", "medium"), ("explainability", "low")]
THIN = [("completeness", "medium"), *ADVICE]
BUS = run(
    "df['delay'] = df['delay'].clip(0, 90)\ntrain_test_split(df, delay)",
    "Clip extreme bus delays by IQR and compare RMSE before vs after",
    "RMSE before: 4.0\nRMSE after: 4.5\nworse by 0.5", expected=("rmse",),
)
SORTED = run("print(sorted(stations))", "List the stations", "3 stations", "FutureWarning: sorted order will change")
# record, options -> gap score, qualified, passed, items in order
VERDICTS = {
    "plain": (run("count(loaves)", "List the loaves of each bakery", "north 12, south 9"), {}, 1.0, True, True, THIN),
    "all there": (
        run("plt.savefig('tides.png')", "Draw a heatmap of the tides", "4.2 m", files=("tides.png",), expected=("png",)),
        {}, 1.0, True, True, ADVICE,
    ),
    "no picture": (
        run("print(tides.max())", "Draw a heatmap of the tides", "4.2 m", files=("tides.csv",), expected=("png",)),
        {}, 0.6, False, True, [("visualization", "medium"), *ADVICE, ("visualization", "high")],
    ),
    "counts stay": (
        run("rain.mean()", "Fill missing rain gauge values", "Missing mm (initial): 7\nMissing mm (after mean): 7"),
        {}, 0.45, False, False, [("preprocessing", "high"), *THIN, ("preprocessing", "low"), ("preprocessing", "high"), ("preprocessing", "medium")],
    ),
    "ended early": (
        run("1 / 0", "List the stations", "", "ZeroDivisionError", "failure", error="division by zero"),
        {}, 0.6, False, False, [("execution", "high"), *THIN, ("execution", "high")],
    ),
    "worse": (BUS, {}, 0.85, True, True, [*THIN, ("analysis", "medium")]),
    "worse in the loop": (
        {**BUS, "mode": "feedback_loop"}, {}, 0.45, False, False, [*THIN, ("analysis", "high"), ("methodology", "medium")],
    ),
    "warned": (SORTED, {}, 0.85, True, True, [*THIN, ("execution", "medium")]),
    "warned, clean wanted": (SORTED, {"require_clean_stderr": True}, 0.6, False, True, [*THIN, ("execution", "high")]),
    "warned in the loop": ({**SORTED, "mode": "feedback_loop"}, {}, 0.85, True, False, [*THIN, ("execution", "medium")]),
}


@pytest.mark.parametrize("name", VERDICTS)
def test_verdicts(spark, name):
    record, options, gap_score, qualified, passed, items = VERDICTS[name]
    row = evaluate_runs(frame(spark, record), **options).first()
    feedback = row["feedback"]
    assert [(g["category"], g["severity"]) for g in feedback["items"]] == items
    assert (feedback["qualification_score"], feedback["qualified"], feedback["passed"]) == (gap_score, qualified, passed)
    assert row["evaluation"]["structured_feedback"] == feedback
    assert row["evaluation"]["task_qualified"] is qualified


def test_the_cause_of_a_failure_is_named(spark):
    for error, stderr, cause in (("division by zero", "x", "division by zero"), ("", "y" * 600, "y" * 500)):
        row = scored(spark, run("1 / 0", "List the stations", "", stderr, "failure", error=error))
        assert row["items"][0]["message"] == "Execution failed: " + cause


def test_every_flag_takes_both_values(spark, sf):
    flags = [
        "is_success", "is_failed", "is_critical", "is_warned", "impute_failed", "wants_viz",
        "wants_prep", "wants_ml", "shows_viz", "shows_prep", "shows_ml", "data_missing",
        "wants_before_after", "shows_before_after", "got_worse", "clips_early",
        "lacks_engineering", "drops_twice", "fills_inplace", "selects_object", "leakage_task",
        "is_qualified", "passed",
    ]
    seen = score_table(run_records(spark, sf)).agg(
        *[F.count_distinct(c).alias(c) for c in flags]
    ).first()
    assert {c: seen[c] for c in flags} == {c: 2 for c in flags}


def test_every_gap_and_item_occurs(spark, sf):
    table = score_table(run_records(spark, sf))
    kinds = {
        (r["category"], r["severity"])
        for r in table.select(F.explode("items").alias("g")).select("g.*").distinct().collect()
    }
    assert {
        ("execution", "high"), ("execution", "medium"), ("visualization", "high"),
        ("metrics", "high"), ("preprocessing", "high"), ("completeness", "medium"),
        ("analysis", "high"), ("methodology", "medium"), ("feature_engineering", "medium"),
        ("code_quality", "medium"), ("code_quality", "low"), ("visualization", "medium"),
        ("decision", "medium"), ("business", "medium"), ("explainability", "low"),
        ("preprocessing", "low"),
    } <= kinds


def test_gap_texts(spark):
    row = score_table(
        frame(spark, run("print(1)", "Train", "nothing", expected=["F1 ", "x", "auc"]))
    ).first()
    assert [g["message"] for g in row["gaps"]] == [
        "Expected metric 'f1' not found in stdout.",
        "Expected metric 'auc' not found in stdout.",
    ]
    assert row["gaps"][0]["recommendation"] == "Print f1 clearly in the output."
    assert row["gap_summary"] == "Qualification gaps (2); score=0.20."


def test_judge_reply_json_and_bullets(spark):
    reply = (
        'Sure: {"score": 0.9, "summary": "good", "gaps": [{"category": "a", "severity": "low", '
        '"message": "m", "recommendation": "r"}, {"message": "n"}]}'
    )
    parsed = one(spark, X.parse_judge_reply(F.lit(reply)))
    assert (parsed["score"], parsed["summary"]) == (0.9, "good")
    assert [tuple(g) for g in parsed["gaps"]] == [
        ("a", "low", "m", "r"), ("general", "medium", "n", ""),
    ]
    bullets = "Gaps:\n- [HIGH] metrics: f1 missing → print f1\n  * [low] style: long\n- none"
    parsed = one(spark, X.parse_judge_reply(F.lit(bullets)))
    assert parsed["score"] is None
    assert [tuple(g) for g in parsed["gaps"]] == [
        ("metrics", "high", "f1 missing", "print f1"), ("style", "low", "long", ""),
    ]


def test_whole_log_text_is_read(spark, sf):
    tail = logs(spark, sf).select(
        X.found(F.concat("stdout", F.lit(" worsened")), X.WORSE_WORD).alias("hit")
    )
    assert tail.where(~F.col("hit")).count() == 0


def test_scoring_plan_is_narrow_and_native(spark, sf):
    records = frame(spark, run("print(1)", "Train a model"))
    plan = evaluate_runs(records)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "Python" not in plan and "ArrowEval" not in plan
