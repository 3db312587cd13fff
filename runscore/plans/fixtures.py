"""Run records derived from the given tables.

``events`` becomes one run per event, ``documents`` one log per document with
the whole text in code and output. The rule texts come from a fixed list of
templates, because the tables hold no code.
"""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runscore.runtime import spread_rows, spread_small
from runscore.schemas import (
    BASELINE,
    COMPONENTS,
    CRITIC_DDL,
    EVALUATION_DDL,
    EXECUTION_DDL,
    FEEDBACK,
    FEEDBACK_DDL,
    GAPS_DDL,
    PASS_THRESHOLD,
)


@dataclass(frozen=True)
class Template:
    task: str
    code: str
    stdout: str = ""
    stderr: str = ""
    files: tuple[str, ...] = ()
    expected: tuple[str, ...] = ()
    summary: str = ""
    snippet: str = "print('safe')"
    reply: str = ""
    error: str = ""
    name: str = "run"


TEMPLATES = [
    Template(
        "Explore the tide gauges: row count, empty cells and correlation",
        "print(tides.describe(), tides.shape)",
        "412 rows, 8 columns",
        summary="Rows: 412\nMissing values: {'level': 0, 'wind': 0}",
        snippet="import subprocess",
        reply='{"score": 0.9, "summary": "fine", "gaps": []}',
        error="429 retry in 12.5s",
        name="run one_i2",
    ),
    Template(
        "Draw the share of late buses as a chart",
        "plt.savefig('late.png')",
        "drawn",
        files=("late.png", "late.csv", "late.png"),
        expected=("png",),
        snippet="eval (x)",
        reply="- [HIGH] metrics: f1 is missing → Print f1\nnot a bullet\n* [low] style: long lines",
        error='RESOURCE_EXHAUSTED "retryDelay": "40s"',
        name="churn/plot#1",
    ),
    Template(
        "Draw the share of late buses as a chart",
        "print(late.mean())",
        "accuracy 0.87",
        expected=("png",),
        snippet="open('f','w')",
        reply=(
            'Answer: {"score": 0.4, "summary": "weak", "gaps": [{"category": "metrics", '
            '"severity": "high", "message": "no recall", "recommendation": "print recall"}]}'
        ),
        error="quota",
        name="abc123_i0",
    ),
    Template(
        "Compare classifiers of fraud alerts, explain them by permutation; print accuracy and f1",
        "wood = RandomForestClassifier(); LogisticRegression(); train_test_split(X, y, stratify=y); "
        "StandardScaler(); permutation_importance(m)",
        "accuracy 0.93, f1 0.71",
        expected=("accuracy", "f1"),
        snippet="os.remove(p)",
        reply="* [medium] analysis: too short",
        error="KeyError",
        name="abc123_i10_x",
    ),
    Template(
        "Compare classifiers of fraud alerts, explain them by permutation; print accuracy and f1",
        "LogisticRegression()",
        "accuracy 0.93",
        expected=("accuracy", "f1"),
        snippet="x = 1",
        reply='{"summary": "", "gaps": [{"message": "vague"}, {"category": "style"}]}',
        error="rate limit hit, retry in 3 s",
        name="a-b.c_d",
    ),
    Template(
        "Fill missing rain gauge values with the mean",
        "df['mm'].fillna(m, inplace=True)",
        "Missing mm (initial): 7\nMissing mm (after mean): 7",
        expected=("stdout",),
        summary="Missing values: {'mm': 7, 'site': 0}",
        snippet="shutil.rmtree(p)",
        reply="plain words only",
        error="timeout",
        name="  spaced  name  ",
    ),
    Template(
        "Clip extreme bus delays by IQR and compare RMSE before vs after",
        "df['delay'].quantile(0.1); df_clipped['delay'] = df_clipped['delay'].clip(0, 90); "
        "train_test_split(df_clipped, y)",
        "RMSE before: 4.0\nRMSE after: 4.5\nRMSE worsened by 0.5",
        expected=("rmse",),
        snippet="  from telnetlib import Telnet",
        reply='{"score": 1.0, "gaps": [{"category": "a", "severity": "low", "message": "b"}]',
        error="Rate-Limit",
        name="x" * 150,
    ),
    Template(
        "Engineer inputs, encode the bus lines and train a model",
        "df.drop(columns=['a'], axis=1); df.select_dtypes(include='object')",
        "  \n",
        "UserWarning: late\nKeyError: 'line'",
        expected=("accuracy",),
        snippet="__import__ ('os')",
        reply="- [low] code: fine → keep\r\n- [medium] code: fine → keep",
        error="retryDelay: 7",
        name="_i3",
    ),
    Template(
        "Predict late arrivals and print Accuracy",
        "SVC(); LinearRegression(); df.head()",
        "Accuracy: 0.8\nrecall 0.5",
        "UserWarning: convergence",
        files=("out/model.pkl", "out/f1.txt", "out/plot.SVG"),
        expected=(" Accuracy ", "f1", "f1", "notes"),
        snippet="requests.post(url)",
        reply='{"score": 0.95, "summary": "good", "gaps": [{"category": "x", "severity": "medium"}]}',
        error="",
        name="r_i12",
    ),
    Template(
        "Handle missing depths by imputation; check for target leakage and validation",
        "df.fillna(0)\nX_train['a'] = X_train['a'].clip(0, 1)\ntrain_test_split(X, y)",
        "Missing depth (initial): 5\nMissing depth (after fill): 0",
        "ChainedAssignmentError: a copy was changed",
        summary="Missing values: {'depth': 5, 'salt': 0}",
        snippet="import urllib.request",
        reply="- [medium] analysis: too short\n- [medium] analysis: too short",
        error="Quota exceeded; retry in 20s",
        name="été 1",
    ),
    Template(
        "Find outlier fares by IQR; RMSE before vs after the clip",
        "train_test_split(df, y)\nX_train['a'].quantile(0.25)",
        "RMSE initial: 2\nRMSE clipped: 1\nRMSE improved",
        "FutureWarning: later",
        expected=("rmse", "stdout"),
        snippet="exec(code)",
        reply='```json\n{"score": 0.8, "summary": "ok", "gaps": []}\n```',
        error="HTTP 429",
        name="n_i1_i2",
    ),
    Template(
        "Compare RMSE before vs after scaling; handle missing rows",
        "MinMaxScaler(); df.dropna()",
        "done",
        "Traceback (most recent call last)",
        summary="Missing values: {'x': 12}",
        snippet="socket.create()",
        reply="",
        error="retry in five s",
        name="",
    ),
    Template(
        "Engineer a ratio feature per room to improve revenue",
        "df['rooms_per_household'] = df.rooms / df.households; SelectKBest(); plt.hist(x)",
        "ok r2=0.4",
        files=("fig/a.html", "fig/a.PNG", "b.pdf"),
        expected=("html", "r2", "auc"),
        snippet="os.system('x')",
        reply='{"score": 0.2, "summary": "bad", "gaps": 3}',
        error="a rate limit",
        name="é_i5",
    ),
    Template(
        "Why do customers leave? Which features reduce fraud risk, and is there overfitting",
        "import shap\nGradientBoostingRegressor(); df.corr(); feature_importance(m)",
        "AUC: 0.7 ROC",
        "DeprecationWarning: old",
        snippet="y = open('f', 'r')",
        reply="* [High] a b: two words",
        error="x",
        name="q",
    ),
    Template(
        "Benchmark models for customer churn: duplicates, class imbalance, multicollinearity",
        "XGBClassifier(); LGBMRegressor(); DecisionTreeRegressor(); df.drop_duplicates(); "
        "df.info(); pca(x); lime(x); target = df['y']",
        "precision 0.3 mae 2",
        "ParserError: bad line",
        expected=("precision", "model_comparison"),
        snippet="from requests import get",
        reply='text {"score": 0.85, "summary": "x", "gaps": []} text',
        error="429",
        name="z_i",
    ),
    Template(
        "Train a model with one-hot encoding and report recall",
        "OneHotEncoder(); StandardScaler(); ColumnTransformer(); randomforest = 1; "
        "df['a'].quantile(0.5)\ntrain_test_split(df, y)",
        "Recall: 0.82",
        "ValueError: bad input",
        files=("r.jpeg",),
        expected=("recall", "jpg"),
        summary="Missing values: none",
        snippet="os.unlink(p)",
        reply="-[low] x: y → ",
        error="resource_exhausted",
        name="p.q-r",
    ),
]

COUNT = len(TEMPLATES)
DOCUMENT_CODE_PREFIX = "\n# "


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def template_at(index: Column) -> Column:
    """Template struct by number; a constant array, so no join is needed."""
    fields = ",".join(
        f"{f.name}:{'array<string>' if f.name in ('files', 'expected') else 'string'}"
        for f in dataclasses.fields(Template)
    )
    rows = json.dumps([dataclasses.asdict(t) for t in TEMPLATES])
    constant = F.from_json(F.lit(rows), f"array<struct<{fields}>>")
    return F.element_at(constant, (index + 1).cast("int"))


def templated(rows: DataFrame, index: Column) -> DataFrame:
    """Add the template columns of the numbered template."""
    picked = rows.withColumn("tpl", template_at(index))
    return picked.select(*rows.columns, "tpl.*")


def agent_runs(spark: SparkSession, sf_dir: str, tasks_per_core: int = 1) -> DataFrame:
    """Flat run columns, one per event."""
    e = spread_rows(load(spark, sf_dir, "events"), tasks_per_core)
    event, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    return e.select(
        event,
        user,
        "ts",
        "props",
        event.cast("string").alias("run_id"),
        F.concat(F.lit("task_"), F.lpad((user % 45 + 1).cast("string"), 3, "0")).alias("task_id"),
        F.when(event % 2 == 0, F.lit(BASELINE)).otherwise(F.lit(FEEDBACK)).alias("mode"),
        F.concat(
            F.lit("benchmark_"), F.lpad(F.expr("event_id div 50").cast("string"), 8, "0")
        ).alias("file_name"),
        (event % 50).cast("int").alias("position"),
        F.when(event % 101 == 0, F.lit(None))
        .when(event % 97 == 0, F.lit("blocked"))
        .when(kind == "error", F.lit("failure"))
        .when(kind == "signup", F.lit("timeout"))
        .otherwise(F.lit("success"))
        .alias("status"),
        (F.expr("event_id div 2") % COUNT).alias("template"),
        (1 + event % 3).cast("int").alias("rounds"),
    )


def round_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per feedback round of every run."""
    runs = agent_runs(spark, sf_dir)
    i = F.col("iteration")
    return (
        runs.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
        .withColumn("score", round_score(i))
        .select(
            "run_id", "event_id", "iteration", "score",
            (F.col("score") >= PASS_THRESHOLD).alias("passed"),
            ((F.col("event_id") + i * 5) % 4 == 0).alias("failed"),
        )
    )


def round_score(i: Column) -> Column:
    return ((F.col("user_id") * 13 + F.col("event_id") * 7 + i * 29) % 1001) / 1000


def component_score(k: int) -> Column:
    return ((2.0 + ((F.col("event_id") * 7 + k * 3) % 17) * 0.5)).cast("double")


def _history() -> Column:
    def one(i: Column) -> Column:
        score = round_score(i)
        items = F.transform(
            F.slice(
                F.array(F.lit("metrics"), F.lit("analysis")),
                F.lit(1),
                ((F.col("event_id") + i) % 3).cast("int"),
            ),
            lambda c: F.struct(
                c.alias("category"), F.lit("medium").alias("severity"),
                F.concat(F.lit("check "), c).alias("message"),
                F.lit("revise").alias("recommendation"),
            ),
        ).cast(GAPS_DDL)
        return F.struct(
            i.cast("int").alias("iteration"), score.alias("score"),
            (score >= PASS_THRESHOLD).alias("passed"), items.alias("items"),
            F.concat(F.lit("round "), i.cast("string")).alias("summary"),
            score.alias("qualification_score"), (score >= 0.8).alias("qualified"),
            F.when(F.col("event_id") % 11 != 0, component_score(0) * 10).alias("decision_score"),
            F.lit("").alias("decision_summary"),
            F.array().cast("array<string>").alias("decision_recommendations"),
        ).cast(FEEDBACK_DDL)

    # every seventh run kept no history
    rounds = F.transform(F.sequence(F.lit(0), F.col("rounds") - 1), one)
    return F.when(F.col("event_id") % 7 == 0, F.array().cast(f"array<{FEEDBACK_DDL}>")).otherwise(
        rounds
    )


def _recovered() -> Column:
    def bad(i: Column) -> Column:
        return (F.col("event_id") + i * 5) % 4 == 0

    numbers = F.sequence(F.lit(0), F.col("rounds") - 1)
    first_bad = F.array_min(F.filter(numbers, bad))
    last_good = F.array_max(F.filter(numbers, lambda i: ~bad(i)))
    return F.coalesce(first_bad < last_good, F.lit(False))


def run_records(spark: SparkSession, sf_dir: str, tasks_per_core: int = 1) -> DataFrame:
    """Full run records; every 53rd run has no evaluation, every 11th no critic."""
    flat = templated(agent_runs(spark, sf_dir, tasks_per_core), F.col("template"))
    stdout = F.when(
        F.col("stdout").rlike(r"\S"), F.concat("stdout", F.lit("\n"), "props")
    ).otherwise(F.col("stdout"))
    execution = F.struct(
        F.col("status"), stdout.alias("stdout"), F.col("stderr"),
        F.lit(0).alias("return_code"), F.lit(1.0).alias("duration_seconds"),
        F.col("files").alias("output_files"), F.lit(None).cast("string").alias("error_message"),
    ).cast(EXECUTION_DDL)
    mean = sum((component_score(k) for k in range(1, 8)), component_score(0)) / 8.0 * 10.0
    critic = F.struct(
        F.round(mean, 1).alias("decision_score"),
        F.struct(
            *[component_score(k).alias(name) for k, name in enumerate(COMPONENTS)]
        ).alias("scores"),
        *[
            F.array().cast("array<string>").alias(c)
            for c in ("strengths", "weaknesses", "recommendations")
        ],
        F.round(0.6 + F.round(mean, 1) / 100.0 * 0.35, 2).alias("confidence"),
        F.lit("ok").alias("summary"),
    ).cast(CRITIC_DDL)
    score = round_score(F.col("rounds") - 1)
    none = F.lit(None)
    evaluation = F.struct(
        score.alias("task_completion_score"), (F.col("status") == "success").alias("ok"),
        F.lit(1.0).alias("complete"), F.lit(False).alias("viz"), F.lit(False).alias("ml"),
        F.lit("").alias("notes"), score.alias("qualification_score"),
        F.when(F.col("event_id") % 5 != 0, score >= 0.8).alias("task_qualified"),
        F.when(F.col("event_id") % 11 != 0, critic).alias("critic"),
        none.cast("double").alias("quality"), none.cast(FEEDBACK_DDL).alias("feedback"),
    ).cast(EVALUATION_DDL)
    return flat.select(
        "run_id", "mode", F.col("task").alias("query"),
        F.lit("data.csv").alias("dataset_path"), F.lit("").alias("plan"),
        F.col("code").alias("generated_code"),
        F.when(F.col("status").isNotNull(), execution).alias("execution"),
        F.when(F.col("event_id") % 53 != 0, evaluation).alias("evaluation"),
        _history().alias("feedback_history"), F.lit("").alias("final_report"),
        F.col("rounds").alias("iterations"), _recovered().alias("recovered_from_failure"),
        F.create_map(F.lit("task_id"), F.col("task_id")).alias("metadata"),
        F.col("ts").cast("timestamp").alias("created_at"), "task_id", "file_name", "position",
        F.col("event_id").alias("run_order"), F.col("expected").alias("expected_outputs"),
        F.col("summary").alias("dataset_summary"), "reply",
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns of all runs and of all documents, the whole text included."""
    fields = ["log_id", "task", "code", "stdout", "stderr", "files", "expected", "summary",
              "snippet", "reply", "error", "name"]
    runs = templated(
        agent_runs(spark, sf_dir).withColumn(
            "log_id", F.concat(F.lit("event-"), F.col("run_id"))
        ),
        F.col("template"),
    ).select(fields)
    documents = templated(
        spread_small(load(spark, sf_dir, "documents")).withColumn(
            "log_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
        ),
        F.col("doc_id") % COUNT,
    )
    prefix = F.lit(DOCUMENT_CODE_PREFIX)
    texts = documents.withColumns(
        {
            "code": F.concat("code", prefix, "text"),
            "stdout": F.concat("stdout", F.lit("\n"), "text"),
            "snippet": F.concat("text", F.lit("\n"), "snippet"),
            "reply": F.concat("reply", F.lit("\n"), "text"),
            "error": F.concat("text", F.lit(" "), "error"),
            "task": F.concat("task", F.lit(" "), "text"),
            "stderr": F.concat("stderr", F.lit("\n"), "text"),
            "summary": F.concat("text", F.lit("\n"), "summary"),
            "name": F.concat("name", F.lit(" "), "text"),
            "files": F.array_append("files", F.concat("text", F.lit(".png"))),
            "expected": F.array_append("expected", F.col("text")),
        }
    ).select(fields)
    return runs.unionAll(texts)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task catalogue with dataset and difficulty; every tenth task is not listed.

    Derived from the task ids that occur in ``events``.
    """
    number = F.col("user_id") % 45 + 1
    names = F.array(*[F.lit(n) for n in ("easy", "medium", "hard", "very_hard", "expert", "other")])
    return (
        load(spark, sf_dir, "events")
        .select(number.alias("number"))
        .distinct()
        .where(F.col("number") % 10 != 0)
        .select(
            F.concat(F.lit("task_"), F.lpad(F.col("number").cast("string"), 3, "0")).alias("id"),
            F.concat(F.lit("dataset_"), (F.col("number") % 6).cast("string")).alias("dataset"),
            F.element_at(names, (F.col("number") % 6 + 1).cast("int")).alias("difficulty"),
        )
    )
