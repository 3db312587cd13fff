"""Text predicates over the logs of all runs and documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runscore.functions import text as X
from runscore.plans.fixtures import logs
from runscore.plans.oracle import BASE, LOG_CTE, has_any, matches, text
from runscore.plans.registry import query

WITH = f"WITH {BASE},\n{LOG_CTE}\n"


def flags(
    name: str, columns: Callable[[DataFrame], dict[str, Column]], sql: dict[str, str]
) -> None:
    """Register a per-log query of several columns."""
    body = ", ".join(f"{expr} AS {column}" for column, expr in sql.items())

    @query(name, f"{WITH} SELECT log_id, {body} FROM logs")
    def job(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = logs(spark, sf_dir)
        return table.select(
            "log_id", *[value.alias(column) for column, value in columns(table).items()]
        )


FILLED_ERR = r"regexp_matches(stderr, '\S')"

flags(
    "x1_critical_stderr",
    lambda df: {"is_critical": X.critical_stderr(df["stderr"])},
    {"is_critical": f"{FILLED_ERR} AND {has_any('stderr', X.CRITICAL_MARKERS)}"},
)
flags(
    "x2_warning_stderr",
    lambda df: {"is_warned": X.warning_stderr(df["stderr"])},
    {"is_warned": f"{FILLED_ERR} AND {has_any('stderr', X.WARNING_MARKERS)}"},
)

SQL_DATA_MISSING = (
    f"len(list_filter(regexp_extract_all(regexp_extract(summary, {text(X.MISSING_COUNTS)}, 1), "
    f"{text(X.COUNT_VALUE)}, 1), lambda n: CAST(n AS BIGINT) > 0)) > 0"
)
flags(
    "x3_summary_has_missing",
    lambda df: {"has_missing": X.summary_has_missing(F.col("summary"))},
    {"has_missing": SQL_DATA_MISSING},
)


def _first_number(pattern: str) -> str:
    return f"TRY_CAST(regexp_extract(stdout, {text('(?i)' + pattern)}, 1) AS BIGINT)"


SQL_IMPUTE_FAILED = (
    f"({matches('task', X.IMPUTE_TASK)} AND COALESCE({_first_number(X.MISSING_INITIAL)} > 0 "
    f"AND {_first_number(X.MISSING_INITIAL)} = {_first_number(X.MISSING_AFTER)}, FALSE))"
)
flags(
    "x4_imputation_failed",
    lambda df: {"failed": X.imputation_failed(df["stdout"], df["task"])},
    {"failed": SQL_IMPUTE_FAILED},
)
flags(
    "x5_task_needs",
    lambda df: {
        "needs_viz": X.needs_viz(df["task"]),
        "needs_prep": X.needs_prep(df["task"]),
        "needs_ml": X.needs_ml(df["task"]),
    },
    {
        "needs_viz": matches("task", X.VIZ_TASK),
        "needs_prep": matches("task", X.PREP_TASK),
        "needs_ml": matches("task", X.ML_TASK),
    },
)

SQL_HAS_VIZ = (
    "(len(list_filter(files, lambda f: regexp_matches(lower(f), "
    f"{text(X.VIZ_FILE)}))) > 0 OR {matches('code', X.VIZ_CODE)})"
)
flags("x6_has_viz", lambda df: {"has_viz": X.has_viz(df["code"], F.col("files"))}, {"has_viz": SQL_HAS_VIZ})
flags(
    "x7_prep_and_metrics",
    lambda df: {"has_prep": X.has_prep(df["code"]), "has_ml_metrics": X.has_ml_metrics(df["stdout"])},
    {
        "has_prep": matches("code", X.PREP_CODE),
        "has_ml_metrics": matches("stdout", X.ML_STDOUT),
    },
)
flags(
    "x8_reports_metric",
    lambda df: {f"reports_{m}": X.reports_metric(df["stdout"], m) for m in X.KNOWN_METRICS},
    {f"reports_{m}": matches("stdout", rf"\b{m}\b") for m in X.KNOWN_METRICS},
)

SQL_KNOWN = (
    "list_filter(list_transform(expected, lambda e: lower(trim(e))), lambda e: e IN ("
    + ", ".join(text(m) for m in X.KNOWN_METRICS)
    + "))"
)
flags(
    "x9_expected_metrics",
    lambda df: {"metrics": F.array_join(X.expected_metrics(F.col("expected")), ",")},
    {"metrics": f"COALESCE(array_to_string({SQL_KNOWN}, ','), '')"},
)
SQL_BEFORE_AFTER = (
    f"({matches('stdout', X.BEFORE_WORD)} AND {matches('stdout', X.AFTER_WORD)} "
    rf"AND {matches('stdout', r'\brmse\b')})"
)
flags(
    "x10_before_after",
    lambda df: {"needs": X.needs_before_after(df["task"]), "has": X.has_before_after(df["stdout"])},
    {"needs": matches("task", X.BEFORE_AFTER_TASK), "has": SQL_BEFORE_AFTER},
)
flags(
    "x11_involves_outliers",
    lambda df: {"outliers": X.involves_outliers(df["task"])},
    {"outliers": matches("task", X.OUTLIER_TASK)},
)

SQL_HEAD = (
    f"string_split_regex(code, {text(X.SPLIT_CALL)})[1]"
)
SQL_CLIPS = (
    f"({matches('code', X.SPLIT_CALL, '')} AND NOT {matches(SQL_HEAD, X.TRAIN_CLIP_BEFORE)} "
    f"AND NOT {matches('code', X.TRAIN_CLIP_ANYWHERE)} AND {matches(SQL_HEAD, X.FULL_CLIP)})"
)
flags(
    "x12_clips_before_split",
    lambda df: {"clips_early": X.clips_before_split(df["code"])},
    {"clips_early": SQL_CLIPS},
)
SQL_MISUSE = {
    "drops_twice": f"({matches('code', X.DROP_COLUMNS, '')} AND {matches('code', X.AXIS_ONE, '')})",
    "fills_inplace": matches("code", X.INPLACE_FILLNA, ""),
    "selects_object": matches("code", X.SELECT_OBJECT, ""),
}
flags(
    "x13_api_misuse",
    lambda df: {
        "drops_twice": X.misuse_drop(df["code"]),
        "fills_inplace": X.misuse_fillna(df["code"]),
        "selects_object": X.misuse_select_dtypes(df["code"]),
    },
    SQL_MISUSE,
)
flags(
    "x14_model_names",
    lambda df: {"models": F.array_join(X.model_names(df["code"]), ",")},
    {
        "models": "COALESCE(array_to_string(list_filter(["
        + ", ".join(
            f"regexp_extract(code, {text('(?i)' + p)}, 0)" for p in X.MODEL_FAMILIES
        )
        + "], lambda m: m <> ''), ','), '')"
    },
)
flags(
    "x15_topic_flags",
    lambda df: {
        "business": X.is_business_task(df["task"]),
        "explain": X.is_explain_task(df["task"]),
        "leakage": X.is_leakage_task(df["task"]),
    },
    {
        "business": has_any("lower(task)", X.BUSINESS_TERMS),
        "explain": has_any("lower(task)", X.EXPLAIN_TERMS),
        "leakage": has_any("lower(task)", X.LEAKAGE_TERMS),
    },
)


def _md5(value: str) -> str:
    return f"md5({value})"


FENCED = (
    "CASE (hash_kind) WHEN 0 THEN '```Python' || chr(10) || code || chr(10) || '```' || reply "
    "WHEN 1 THEN reply || '```' || code || '```' || reply ELSE '  ' || code || chr(10) END"
)


@query(
    "x16_extract_code",
    f"""{WITH}, replies AS (
      SELECT log_id, {FENCED} AS r
      FROM (SELECT *, length(code) % 3 AS hash_kind FROM logs))
    SELECT log_id, md5(regexp_replace(CASE
      WHEN regexp_matches(r, {text('(?is)' + X.PYTHON_FENCE)})
        THEN regexp_extract(r, {text('(?is)' + X.PYTHON_FENCE)}, 1)
      WHEN regexp_matches(r, {text('(?s)' + X.ANY_FENCE)})
        THEN regexp_extract(r, {text('(?s)' + X.ANY_FENCE)}, 1)
      ELSE r END, '^\\s+|\\s+$', '', 'g')) AS code_md5
    FROM replies""",
)
def extract_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.length("code") % 3
    tail = F.col("reply")
    fenced = (
        F.when(kind == 0, F.concat(F.lit("```Python\n"), F.col("code"), F.lit("\n```"), tail))
        .when(kind == 1, F.concat(tail, F.lit("```"), F.col("code"), F.lit("```"), tail))
        .otherwise(F.concat(F.lit("  "), F.col("code"), F.lit("\n")))
    )
    return logs(spark, sf_dir).select(
        "log_id", F.md5(X.extract_code(fenced).cast("binary")).alias("code_md5")
    )


def _safety_sql() -> str:
    rules = [
        f"WHEN {matches('snippet', p)} THEN {text('Blocked pattern detected: ' + p)}"
        for p in X.BLOCKED_CALLS
    ]
    rules += [
        "WHEN "
        + matches("snippet", rf"^\s*import\s+{name}\b|^\s*from\s+{name}\b", "(?m)")
        + f" THEN {text('Blocked import: ' + name)}"
        for name in X.BLOCKED_IMPORTS
    ]
    return "CASE " + " ".join(rules) + " END"


@query(
    "x17_code_safety",
    f"{WITH} SELECT log_id, {_safety_sql()} IS NULL AS allowed, {_safety_sql()} AS reason FROM logs",
)
def code_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = logs(spark, sf_dir).select("log_id", X.code_safety(F.col("snippet")).alias("s"))
    return checked.select("log_id", "s.allowed", "s.reason")


flags(
    "x18_rate_limits",
    lambda df: {
        "limited": X.rate_limit_error(F.col("error")),
        "delay": X.retry_delay(F.col("error")),
    },
    {
        "limited": has_any("lower(error)", X.RATE_LIMIT_MARKERS),
        "delay": (
            f"COALESCE(TRY_CAST(regexp_extract(error, {text('(?i)' + X.RETRY_IN)}, 1) AS DOUBLE) + 1, "
            f"TRY_CAST(regexp_extract(error, {text('(?i)' + X.RETRY_DELAY)}, 1) AS DOUBLE) + 1, 35.0::DOUBLE)"
        ),
    },
)


@query(
    "x19_truncate_text",
    f"""{WITH} SELECT log_id, md5(CASE WHEN length(stdout) <= 400 THEN stdout
      ELSE substring(stdout, 1, 350) || chr(10) || '... [truncated]' END) AS shown
    FROM logs""",
)
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).select(
        "log_id", F.md5(X.truncate_text(F.col("stdout"), 400).cast("binary")).alias("shown")
    )


flags(
    "x20_names",
    lambda df: {
        "file_part": X.safe_name(F.col("name")),
        "base_id": X.base_run_id(F.col("name")),
    },
    {
        "file_part": (
            r"substring(regexp_replace(name, '[^\p{L}\p{N}_\-.]', '_', 'g'), 1, 128)"
        ),
        "base_id": r"regexp_replace(name, '_i\d+$', '')",
    },
)
flags(
    "x21_figure_files",
    lambda df: {
        "figures": F.array_join(X.figure_files(F.col("files")), ","),
        "report_figures": F.array_join(
            X.figure_files(F.col("files"), X.REPORT_FIGURE_SUFFIXES), ","
        ),
        "merged": F.array_join(X.merge_files(F.col("files"), F.col("expected")), ","),
    },
    {
        "figures": (
            "COALESCE(array_to_string(list_filter(files, lambda f: regexp_matches(lower(f), "
            r"'\.(png|jpg|jpeg|svg|html|pdf)$')), ','), '')"
        ),
        "report_figures": (
            "COALESCE(array_to_string(list_filter(files, lambda f: regexp_matches(lower(f), "
            r"'\.(png|jpg|jpeg|svg)$')), ','), '')"
        ),
        "merged": (
            "COALESCE((SELECT string_agg(f, ',' ORDER BY pos) FROM (SELECT f, MIN(i) AS pos FROM ("
            "SELECT UNNEST(list_concat(files, expected)) AS f, "
            "UNNEST(generate_series(1, len(files) + len(expected))) AS i) GROUP BY f)), '')"
        ),
    },
)

JSON_PART = r"regexp_extract(reply, '(?s)\{.*\}', 0)"
BULLET = text(r"(?i)^[-*]\s*\[(high|medium|low)\]\s*([\p{L}\p{N}_]+):\s*(.+?)(?:\s*→\s*(.+))?$")


@query(
    "x22_judge_replies",
    f"""{WITH}, parsed AS (
      SELECT log_id, reply, {JSON_PART} AS obj,
        COALESCE({JSON_PART} <> '' AND json_valid({JSON_PART}), FALSE) AS is_object,
        list_filter(list_transform(string_split_regex(reply, '\\r\\n|\\n|\\r'),
          lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')),
          lambda l: regexp_matches(l, {BULLET})) AS bullets
      FROM logs)
    SELECT log_id, is_object,
      CASE WHEN is_object THEN CAST(json_extract(obj, '$.score') AS DOUBLE) END AS score,
      CASE WHEN is_object THEN COALESCE(json_extract_string(obj, '$.summary'), '') ELSE '' END AS summary,
      CAST(CASE WHEN is_object THEN COALESCE(CASE WHEN json_type(obj, '$.gaps') = 'ARRAY'
             THEN json_array_length(obj, '$.gaps') END, 0)
           ELSE len(bullets) END AS BIGINT) AS gaps,
      CASE WHEN is_object THEN COALESCE(json_extract_string(obj, '$.gaps[0].message'),
             CASE WHEN json_array_length(obj, '$.gaps') > 0 THEN '' END)
           WHEN len(bullets) > 0 THEN regexp_extract(bullets[1], {BULLET}, 3) END AS first_message,
      CASE WHEN is_object THEN COALESCE(json_extract_string(obj, '$.gaps[0].severity'),
             CASE WHEN json_array_length(obj, '$.gaps') > 0 THEN 'medium' END)
           WHEN len(bullets) > 0 THEN lower(regexp_extract(bullets[1], {BULLET}, 1)) END AS first_severity
    FROM parsed""",
)
def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = logs(spark, sf_dir).select("log_id", X.parse_judge_reply(F.col("reply")).alias("j"))
    first = F.try_element_at(F.col("j.gaps"), F.lit(1))
    return judged.select(
        "log_id",
        "j.is_object",
        "j.score",
        "j.summary",
        F.size("j.gaps").cast("long").alias("gaps"),
        first["message"].alias("first_message"),
        first["severity"].alias("first_severity"),
    )
