"""Predicates and extractors over task text, code and captured output.

Every function takes and returns Columns, so a whole set of them stays in one
projection without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from runscore.functions.rounding import any_of, is_filled
from runscore.schemas import GAPS_DDL

# --- fixed values: markers, word lists and patterns -------------------------
CRITICAL_MARKERS = [
    "ChainedAssignmentError",
    "Traceback (most recent call last)",
    "ValueError:",
    "KeyError:",
    "ParserError:",
]
WARNING_MARKERS = [
    "Warning:",
    "Pandas4Warning",
    "FutureWarning",
    "DeprecationWarning",
    "UserWarning",
]

MISSING_COUNTS = r"Missing values:\s*(\{.*\})"
COUNT_VALUE = r":\s*(\d+)"

IMPUTE_TASK = r"imput|fillna|fill\s+missing"
MISSING_INITIAL = r"Missing.*\(initial\):\s*(\d+)"
MISSING_AFTER = r"Missing.*\(after[^)]*\):\s*(\d+)"

VIZ_TASK = r"plot|chart|figure|visualiz|heatmap|pairplot|hist|bar chart|savefig|save figure"
PREP_TASK = r"imput|encode|scale|preprocess|engineer|one-?hot|fill\s+missing|handle\s+missing"
ML_TASK = r"accuracy|f1|rmse|r2|precision|recall|classif|regress|predict|model|train"

VIZ_FILE = r"\.(png|html|jpg|jpeg|svg)$"
VIZ_CODE = r"plt\.savefig|\.savefig\(|write_image|to_html"
PREP_CODE = r"imput|fillna|OneHotEncoder|get_dummies|StandardScaler|ColumnTransformer|preprocess"
ML_STDOUT = r"accuracy|f1|r2|rmse|precision|recall|auc"

KNOWN_METRICS = ["accuracy", "f1", "precision", "recall", "rmse", "r2", "auc"]

BEFORE_AFTER_TASK = r"before\s+vs\s+after|compare\s+rmse|compare.*before|rmse\s+before"
BEFORE_WORD = r"before|initial"
AFTER_WORD = r"after|clipped|worsened|improved"
WORSE_WORD = r"worsened|worse"
OUTLIER_TASK = r"outlier|iqr|clip"

SPLIT_CALL = r"train_test_split\s*\("
TRAIN_CLIP_BEFORE = r"X_train\s*\[.*\]\.quantile|X_train\s*\[.*\]\.clip"
TRAIN_CLIP_ANYWHERE = r"X_train.*quantile|X_train.*\.clip"
FULL_CLIP = (
    r"df(_clipped)?\s*\[[^\]]+\]\s*=\s*[^\n]*\.clip"
    r"|df(_clipped)?\s*\[[^\]]+\]\s*\.quantile"
    r"|df(_clipped)?\['[^']+'\]\.quantile"
)

DROP_COLUMNS = r"\.drop\s*\(\s*columns\s*="
AXIS_ONE = r"axis\s*=\s*1"
INPLACE_FILLNA = r"\.fillna\s*\([^)]*inplace\s*=\s*True"
SELECT_OBJECT = r"select_dtypes\s*\(\s*include\s*=\s*['\"]object['\"]"

ENGINEER_TASK = r"engineer|feature engineering"
ENGINEER_CODE = r"engineer|avg_|per_|ratio|_feat|rooms_per"

MODEL_FAMILIES = [
    r"RandomForest(?:Classifier|Regressor)?",
    r"GradientBoosting(?:Classifier|Regressor)?",
    r"XGB(?:Classifier|Regressor)?",
    r"LGBM(?:Classifier|Regressor)?",
    r"LogisticRegression",
    r"DecisionTree(?:Classifier|Regressor)?",
    r"LinearRegression",
    r"SVC",
]

BUSINESS_TERMS = [
    "churn", "fraud", "customer", "business", "revenue", "cost", "risk", "profit",
    "retention", "reduce", "improve", "optimiz",
]
EXPLAIN_TERMS = ["explain", "shap", "feature importance", "permutation", "lime", "interpretable"]
LEAKAGE_TERMS = [
    "leak", "leakage", "target leakage", "split", "validation", "overfit", "overfitting",
]

PYTHON_FENCE = r"```python\s*(.*?)```"
ANY_FENCE = r"```\s*(.*?)```"

BLOCKED_CALLS = [
    r"\bos\.system\b",
    r"\bsubprocess\b",
    r"\bshutil\.rmtree\b",
    r"\bos\.remove\b",
    r"\bos\.unlink\b",
    r"\bsocket\b",
    r"\brequests\.(get|post|put|delete)\b",
    r"\burllib\b",
    r"\beval\s*\(",
    r"\bexec\s*\(",
    r"\b__import__\s*\(",
    r"\bopen\s*\([^)]*['\"]w",
]
BLOCKED_IMPORTS = ["subprocess", "socket", "requests", "urllib", "ftplib", "telnetlib"]

RATE_LIMIT_MARKERS = ["429", "resource_exhausted", "quota", "rate limit", "rate-limit"]
RETRY_IN = r"retry in (\d+(?:\.\d+)?)\s*s"
RETRY_DELAY = r"retryDelay['\"]?\s*:\s*['\"]?(\d+)"
DEFAULT_RETRY_SECONDS = 35.0

FIGURE_SUFFIXES = ["png", "jpg", "jpeg", "svg", "html", "pdf"]
REPORT_FIGURE_SUFFIXES = ["png", "jpg", "jpeg", "svg"]

JUDGE_OBJECT = r"\{[\s\S]*\}"
JUDGE_BULLET = r"^[-*]\s*\[(high|medium|low)\]\s*(\w+):\s*(.+?)(?:\s*→\s*(.+))?$"
# ----------------------------------------------------------------------------


def ci(pattern: str) -> str:
    """Ignore case; ``.`` stops at newline only."""
    return "(?id)" + pattern


_PLAIN = re.compile(r"(?:[A-Za-z0-9_ -]|\\[.(])+")
_OPTIONAL_TAIL = re.compile(r"\(\?:[^()]*\)\?$")


def _literal(alternative: str) -> str | None:
    """Lower-case text an alternative stands for, or None if it is a real pattern.

    A trailing optional group never decides whether there is a match.
    """
    core = _OPTIONAL_TAIL.sub("", alternative)
    return core.replace("\\", "").lower() if _PLAIN.fullmatch(core) else None


def _alternatives(pattern: str) -> list[str]:
    """Top-level alternatives of a pattern."""
    parts, depth, start = [], 0, 0
    for i, char in enumerate(pattern):
        escaped = i > 0 and pattern[i - 1] == "\\"
        if char in "([" and not escaped:
            depth += 1
        elif char in ")]" and not escaped:
            depth -= 1
        elif char == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
    return [*parts, pattern[start:]]


def found(text: Column, pattern: str) -> Column:
    """Case-insensitive search.

    Plain alternatives become substring tests on the lower-cased text, which are
    several times cheaper than a regular expression; only the rest is matched
    as a pattern.
    """
    lowered = F.lower(text)
    literals, patterns = [], []
    for alternative in _alternatives(pattern):
        word = _literal(alternative)
        if word is None:
            patterns.append(alternative)
        else:
            literals.append(lowered.contains(word))
    if patterns:
        literals.append(text.rlike(ci("|".join(patterns))))
    return any_of(literals)


def contains_any(text: Column, terms: list[str]) -> Column:
    """Substring test against a word list; ``text`` must already be lower case
    when the list is."""
    return any_of([text.contains(term) for term in terms])


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# --- stderr -----------------------------------------------------------------
def critical_stderr(stderr: Column) -> Column:
    return is_filled(stderr) & contains_any(stderr, CRITICAL_MARKERS)


def warning_stderr(stderr: Column) -> Column:
    return is_filled(stderr) & contains_any(stderr, WARNING_MARKERS)


# --- task and data needs ----------------------------------------------------
def summary_has_missing(summary: Column) -> Column:
    counts = F.regexp_extract_all(
        F.regexp_extract(summary, "(?d)" + MISSING_COUNTS, 1), F.lit(COUNT_VALUE), 1
    )
    return F.coalesce(F.exists(counts, lambda n: n.rlike("[1-9]")), F.lit(False))


def imputation_failed(stdout: Column, task: Column) -> Column:
    before = F.regexp_extract(stdout, ci(MISSING_INITIAL), 1).try_cast("decimal(38,0)")
    after = F.regexp_extract(stdout, ci(MISSING_AFTER), 1).try_cast("decimal(38,0)")
    return found(task, IMPUTE_TASK) & F.coalesce((before > 0) & (before == after), F.lit(False))


def needs_viz(task: Column) -> Column:
    return found(task, VIZ_TASK)


def needs_prep(task: Column) -> Column:
    return found(task, PREP_TASK)


def needs_ml(task: Column) -> Column:
    return found(task, ML_TASK)


def has_viz(code: Column, files: Column) -> Column:
    saved = F.exists(files, lambda f: f.rlike(ci(VIZ_FILE)))
    return F.coalesce(saved, F.lit(False)) | found(code, VIZ_CODE)


def has_prep(code: Column) -> Column:
    return found(code, PREP_CODE)


def has_ml_metrics(stdout: Column) -> Column:
    return found(stdout, ML_STDOUT)


def reports_metric(stdout: Column, metric: str) -> Column:
    """Whole-word mention; word characters are Unicode letters and digits."""
    return F.lower(stdout).contains(metric) & stdout.rlike(rf"(?iU)\b{metric}\b")


def expected_metrics(expected: Column) -> Column:
    """Expected outputs that name a known metric, in order, duplicates kept."""
    named = F.transform(expected, lambda item: F.lower(trim_space(item)))
    kept = F.filter(named, lambda item: item.isin(KNOWN_METRICS))
    return F.coalesce(kept, F.array().cast("array<string>"))


def missing_metrics(expected: Column, stdout: Column) -> Column:
    """Expected metrics that the output never mentions."""
    reported = F.array_compact(
        F.array(*[F.when(reports_metric(stdout, m), F.lit(m)) for m in KNOWN_METRICS])
    )
    return F.filter(expected_metrics(expected), lambda m: ~F.array_contains(reported, m))


def needs_before_after(task: Column) -> Column:
    return found(task, BEFORE_AFTER_TASK)


def has_before_after(stdout: Column) -> Column:
    return found(stdout, BEFORE_WORD) & found(stdout, AFTER_WORD) & reports_metric(stdout, "rmse")


def involves_outliers(task: Column) -> Column:
    return found(task, OUTLIER_TASK)


def clips_before_split(code: Column) -> Column:
    """Outlier bounds taken from the whole frame ahead of the first split call."""
    split_at = F.regexp_instr(code, F.lit(SPLIT_CALL))
    head = F.substring(code, F.lit(1), split_at - 1)
    return (
        (split_at > 0)
        & ~found(head, TRAIN_CLIP_BEFORE)
        & ~found(code, TRAIN_CLIP_ANYWHERE)
        & found(head, FULL_CLIP)
    )


def misuse_drop(code: Column) -> Column:
    return code.rlike(DROP_COLUMNS) & code.rlike(AXIS_ONE)


def misuse_fillna(code: Column) -> Column:
    return code.rlike(INPLACE_FILLNA)


def misuse_select_dtypes(code: Column) -> Column:
    return code.rlike(SELECT_OBJECT)


def lacks_engineering(task: Column, code: Column) -> Column:
    return found(task, ENGINEER_TASK) & ~found(code, ENGINEER_CODE)


# --- models and topics ------------------------------------------------------
def model_names(code: Column) -> Column:
    """First mention of each model family, in family order."""
    hits = F.array(*[F.regexp_extract(code, ci(p), 0) for p in MODEL_FAMILIES])
    return F.filter(hits, lambda name: name != "")


def model_family_count(code: Column) -> Column:
    """Number of model families mentioned, without building the name array."""
    count = F.lit(0)
    for pattern in MODEL_FAMILIES:
        count = count + found(code, pattern).cast("int")
    return count


def is_business_task(task: Column) -> Column:
    return contains_any(F.lower(task), BUSINESS_TERMS)


def is_explain_task(task: Column) -> Column:
    return contains_any(F.lower(task), EXPLAIN_TERMS)


def is_leakage_task(task: Column) -> Column:
    return contains_any(F.lower(task), LEAKAGE_TERMS)


# --- replies, safety, error text --------------------------------------------
def extract_code(reply: Column) -> Column:
    """Text of the first python fence, else of the first fence, else all of it."""
    python, fence = "(?is)" + PYTHON_FENCE, "(?s)" + ANY_FENCE
    body = (
        F.when(reply.rlike(python), F.regexp_extract(reply, python, 1))
        .when(reply.rlike(fence), F.regexp_extract(reply, fence, 1))
        .otherwise(reply)
    )
    return trim_space(body)


def unsafe_reason(code: Column) -> Column:
    """Why the code may not run, or null when it may."""
    calls = [
        F.when(code.rlike("(?i)" + p), F.lit(f"Blocked pattern detected: {p}"))
        for p in BLOCKED_CALLS
    ]
    imports = [
        F.when(
            code.rlike(rf"(?m)^\s*import\s+{name}\b|^\s*from\s+{name}\b"),
            F.lit(f"Blocked import: {name}"),
        )
        for name in BLOCKED_IMPORTS
    ]
    return F.coalesce(*calls, *imports)


def code_safety(code: Column) -> Column:
    reason = unsafe_reason(code)
    return F.struct(reason.isNull().alias("allowed"), reason.alias("reason"))


def rate_limit_error(message: Column) -> Column:
    return contains_any(F.lower(message), RATE_LIMIT_MARKERS)


def retry_delay(message: Column, default: float = DEFAULT_RETRY_SECONDS) -> Column:
    stated = F.regexp_extract(message, ci(RETRY_IN), 1).try_cast("double")
    field = F.regexp_extract(message, ci(RETRY_DELAY), 1).try_cast("double")
    return F.coalesce(stated + 1.0, field + 1.0, F.lit(float(default)))


def truncate_text(text: Column, limit: int = 4000) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit - 50), F.lit("\n... [truncated]"))
    )


def safe_name(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, r"(?U)[^\w\-.]", "_"), 1, 128)


def base_run_id(run_id: Column) -> Column:
    return F.regexp_replace(run_id, r"_i\d+$", "")


def figure_files(files: Column, suffixes: list[str] = FIGURE_SUFFIXES) -> Column:
    pattern = r"(?i)\.(" + "|".join(suffixes) + r")$"
    return F.filter(files, lambda f: f.rlike(pattern))


def merge_files(*lists: Column) -> Column:
    """All files once, in order of first appearance."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(files, empty) for files in lists]))


# --- judge replies ----------------------------------------------------------
_JUDGE_DDL = f"struct<score:double,summary:string,gaps:{GAPS_DDL}>"


def _gap(category: Column, severity: Column, message: Column, recommendation: Column) -> Column:
    return F.struct(
        category.alias("category"),
        severity.alias("severity"),
        message.alias("message"),
        recommendation.alias("recommendation"),
    )


def parse_judge_reply(reply: Column) -> Column:
    """Judge text as ``struct<is_object, score, summary, gaps>``.

    A valid JSON object is read as such. Anything else is read as bullet lines
    ``- [severity] category: message → recommendation``; it has no score.
    """
    text = F.regexp_extract(reply, JUDGE_OBJECT, 0)
    is_object = F.try_parse_json(F.nullif(text, F.lit(""))).isNotNull()
    parsed = F.from_json(text, _JUDGE_DDL)

    from_object = F.transform(
        F.coalesce(parsed["gaps"], F.array().cast(GAPS_DDL)),
        lambda g: _gap(
            F.coalesce(g["category"], F.lit("general")),
            F.coalesce(g["severity"], F.lit("medium")),
            F.coalesce(g["message"], F.lit("")),
            F.coalesce(g["recommendation"], F.lit("")),
        ),
    ).cast(GAPS_DDL)

    bullet = "(?iU)" + JUDGE_BULLET
    lines = F.filter(
        F.transform(F.split(reply, r"\r\n|\n|\r"), trim_space), lambda line: line.rlike(bullet)
    )
    from_lines = F.transform(
        lines,
        lambda line: _gap(
            F.regexp_extract(line, bullet, 2),
            F.lower(F.regexp_extract(line, bullet, 1)),
            trim_space(F.regexp_extract(line, bullet, 3)),
            trim_space(F.regexp_extract(line, bullet, 4)),
        ),
    ).cast(GAPS_DDL)

    return F.struct(
        is_object.alias("is_object"),
        F.when(is_object, parsed["score"]).alias("score"),
        F.when(is_object, F.coalesce(parsed["summary"], F.lit("")))
        .otherwise(F.lit(""))
        .alias("summary"),
        F.when(is_object, from_object).otherwise(from_lines).alias("gaps"),
    )
