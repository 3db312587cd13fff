"""SQL building blocks of the checks: the derived tables of ``fixtures`` in SQL."""

from __future__ import annotations

from runscore.plans.fixtures import COUNT, DOCUMENT_CODE_PREFIX, TEMPLATES
from runscore.schemas import COMPONENTS


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values: list[str] | tuple[str, ...]) -> str:
    return "CAST([" + ", ".join(text(v) for v in values) + "] AS VARCHAR[])"


def rnd(expr: str, digits: int) -> str:
    """Round half up through a decimal, so that summation noise does not matter."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(30,{digits + 5})), {digits}) AS DOUBLE)"


def matches(column: str, pattern: str, flags: str = "(?i)") -> str:
    return f"regexp_matches({column}, {text(flags + pattern)})"


def has_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"


def when(condition: str, points: float) -> str:
    return f"(CASE WHEN {condition} THEN {float(points)!r} ELSE 0.0 END)"


_ROWS = ",\n".join(
    "("
    + ", ".join(
        [
            str(i), text(t.task), text(t.code), text(t.stdout), text(t.stderr), texts(t.files),
            texts(t.expected), text(t.summary), text(t.snippet), text(t.reply), text(t.error),
            text(t.name),
        ]
    )
    + ")"
    for i, t in enumerate(TEMPLATES)
)

TEMPLATE_CTE = f"""run_templates(template, task, code, stdout, stderr, files, expected, summary,
  snippet, reply, error, name) AS (VALUES {_ROWS})"""

AGENT_CTE = f"""agent_runs AS (
  SELECT event_id, user_id, ts, props, CAST(event_id AS VARCHAR) AS run_id,
    CONCAT('task_', LPAD(CAST(user_id % 45 + 1 AS VARCHAR), 3, '0')) AS task_id,
    CASE WHEN event_id % 2 = 0 THEN 'baseline' ELSE 'feedback_loop' END AS mode,
    CONCAT('benchmark_', LPAD(CAST(event_id // 50 AS VARCHAR), 8, '0')) AS file_name,
    event_id % 50 AS position,
    CASE WHEN event_id % 101 = 0 THEN NULL
         WHEN event_id % 97 = 0 THEN 'blocked'
         WHEN event_type = 'error' THEN 'failure'
         WHEN event_type = 'signup' THEN 'timeout'
         ELSE 'success' END AS status,
    (event_id // 2) % {COUNT} AS template,
    1 + event_id % 3 AS rounds
  FROM events)"""

LOG_CTE = f"""logs AS (
  SELECT 'event-' || a.run_id AS log_id, t.task, t.code, t.stdout, t.stderr, t.files, t.expected,
    t.summary, t.snippet, t.reply, t.error, t.name
  FROM agent_runs a JOIN run_templates t USING (template)
  UNION ALL
  SELECT 'doc-' || CAST(d.doc_id AS VARCHAR), t.task || ' ' || d.text, t.code || {text(DOCUMENT_CODE_PREFIX)} || d.text,
    t.stdout || chr(10) || d.text, t.stderr || chr(10) || d.text, list_append(t.files, d.text || '.png'),
    list_append(t.expected, d.text), d.text || chr(10) || t.summary,
    d.text || chr(10) || t.snippet, t.reply || chr(10) || d.text, d.text || ' ' || t.error, t.name || ' ' || d.text
  FROM documents d JOIN run_templates t ON t.template = d.doc_id % {COUNT})"""

ROUND_CTE = """round_rows AS (
  SELECT run_id, event_id, mode, i AS iteration,
    ((user_id * 13 + event_id * 7 + i * 29) % 1001) / 1000.0::DOUBLE AS score,
    ((user_id * 13 + event_id * 7 + i * 29) % 1001) >= 750 AS passed,
    (event_id + i * 5) % 4 = 0 AS failed
  FROM (SELECT *, UNNEST(generate_series(0, rounds - 1)) AS i FROM agent_runs))"""


def component(k: int) -> str:
    return f"CAST(2.0 + ((event_id * 7 + {k * 3}) % 17) * 0.5 AS DOUBLE)"


_COMPONENTS = ",\n    ".join(
    f"CASE WHEN event_id % 53 <> 0 AND event_id % 11 <> 0 THEN {component(k)} END AS {name}"
    for k, name in enumerate(COMPONENTS)
)

# one row per run with everything the metrics read
RECORD_CTE = f"""records AS (
  SELECT a.*,
    CASE WHEN event_id % 53 <> 0
      THEN ((user_id * 13 + event_id * 7 + (rounds - 1) * 29) % 1001) / 1000.0::DOUBLE END AS score,
    event_id % 53 <> 0 AND event_id % 11 <> 0 AS has_critic,
    {_COMPONENTS},
    CASE WHEN event_id % 7 = 0 THEN 0 ELSE rounds END AS kept_rounds,
    CASE WHEN event_id % 7 <> 0 AND rounds >= 2 THEN
      {rnd('((user_id * 13 + event_id * 7 + (rounds - 1) * 29) % 1001 - (user_id * 13 + event_id * 7 + (rounds - 2) * 29) % 1001) / 1000.0::DOUBLE', 4)}
      ELSE 0.0 END AS fis,
    COALESCE(r.first_bad < r.last_good, FALSE) AS recovered
  FROM agent_runs a
  JOIN (SELECT run_id, MIN(iteration) FILTER (WHERE failed) AS first_bad,
               MAX(iteration) FILTER (WHERE NOT failed) AS last_good
        FROM round_rows GROUP BY run_id) r USING (run_id))"""

_DQS = (
    "data_understanding * 0.10 + preprocessing * 0.15 + feature_engineering * 0.15 "
    "+ model_selection * 0.20 + evaluation_strategy * 0.15 + statistical_validity * 0.10 "
    "+ explainability * 0.05 + business_alignment * 0.10"
)
_DA = (
    "(data_understanding + preprocessing + model_selection + evaluation_strategy "
    "+ statistical_validity + business_alignment) / 60.0"
)
ORS = (
    "0.15 * tcr + 0.15 * esr + 0.20 * da + 0.20 * dqs / 100.0 + 0.15 * bas / 100.0 + 0.15 * fis"
)

RUN_METRIC_CTE = f"""run_values AS (
  SELECT *, CASE WHEN has_critic THEN {rnd('(' + _DQS + ') * 10', 4)} END AS dqs_c,
    CASE WHEN has_critic THEN {rnd('business_alignment * 10', 4)} END AS bas_c,
    CASE WHEN has_critic THEN {rnd(_DA, 4)}
         WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END AS da
  FROM records)"""


def suite(by: str, source: str = "run_values") -> str:
    """Suite metrics per group as a SELECT; ``by`` is a comma list or empty."""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {keys}{', '.join(rnd(m, 4) + f' AS "{m.upper()}"' for m in ('tcr', 'esr', 'rr', 'fis', 'da', 'dqs', 'bas'))},
      {rnd(rnd(ORS, 4) + ' * 100', 4)} AS "ORS", total_tasks, completed_tasks
    FROM (
      SELECT {keys}COUNT(*) AS total_tasks,
        CAST(COUNT(*) FILTER (WHERE done) AS BIGINT) AS completed_tasks,
        COUNT(*) FILTER (WHERE done) / COUNT(*)::DOUBLE AS tcr,
        COALESCE(COUNT(*) FILTER (WHERE status = 'success') / NULLIF(COUNT(status), 0)::DOUBLE, 0) AS esr,
        COALESCE(COUNT(*) FILTER (WHERE status <> 'success' AND recovered)
          / NULLIF(COUNT(*) FILTER (WHERE status <> 'success'), 0)::DOUBLE, 0) AS rr,
        AVG(fis) AS fis, AVG(da) AS da, COALESCE(AVG(dqs_c), 0) AS dqs, COALESCE(AVG(bas_c), 0) AS bas
      FROM (SELECT *, COALESCE(score, 0) >= 0.7 OR COALESCE(status = 'success', FALSE) AS done
            FROM {source})
      {group})"""


LATEST_CTE = """latest AS (
  SELECT * FROM run_values
  QUALIFY ROW_NUMBER() OVER (PARTITION BY mode, task_id ORDER BY file_name DESC, position) = 1),
paired AS (SELECT * FROM latest WHERE task_id IN (
  SELECT task_id FROM latest GROUP BY task_id HAVING COUNT(DISTINCT mode) = 2))"""

METRIC_NAMES = ["TCR", "ESR", "RR", "FIS", "DA", "DQS", "BAS", "ORS"]


def unpivoted(source: str, keys: str, names: list[str], label: str) -> str:
    """Long comparison rows of a table with one row per (keys, mode)."""
    key_list = f"{keys}, " if keys else ""
    parts = " UNION ALL ".join(
        f"""SELECT {key_list}mode, {text(n)} AS {label}, "{n}" AS v FROM {source}""" for n in names
    )
    return f"""SELECT {key_list}{label}, baseline, feedback_loop,
      {rnd('feedback_loop - baseline', 4)} AS delta, feedback_loop > baseline AS improved
    FROM (SELECT {key_list}{label},
            COALESCE(MAX(v) FILTER (WHERE mode = 'baseline'), 0) AS baseline,
            COALESCE(MAX(v) FILTER (WHERE mode = 'feedback_loop'), 0) AS feedback_loop
          FROM ({parts}) GROUP BY {key_list}{label})"""


BASE = ",\n".join([TEMPLATE_CTE, AGENT_CTE])
METRIC_BASE = ",\n".join([AGENT_CTE, ROUND_CTE, RECORD_CTE, RUN_METRIC_CTE])
PAIR_BASE = ",\n".join([METRIC_BASE, LATEST_CTE])
PAIRS_CTE = (
    f"pair_suite AS ({suite('task_id, mode', 'paired')}),\n"
    f"comparison AS ({unpivoted('pair_suite', 'task_id', METRIC_NAMES, 'metric')})"
)
# the pair table with the gaps of the published results: no DQS, BAS, ORS for tasks 1-12
GAPPY_CTE = PAIRS_CTE + """,
pairs AS (
  SELECT task_id, metric,
    CASE WHEN gap THEN NULL ELSE baseline END AS baseline,
    CASE WHEN gap THEN NULL ELSE feedback_loop END AS feedback,
    CASE WHEN gap THEN NULL ELSE delta END AS delta,
    CASE WHEN gap THEN NULL ELSE improved END AS improved
  FROM (SELECT *, metric IN ('DQS', 'BAS', 'ORS') AND task_id <= 'task_012' AS gap FROM comparison))"""
BREAKDOWN_CTE = "wide AS (SELECT task_id, mode, " + ", ".join(
    f'COALESCE({field}, 0) AS "{name}"' for field, name in COMPONENTS.items()
) + " FROM paired),\nbreakdown AS (" + unpivoted(
    "wide", "task_id", list(COMPONENTS.values()), "component"
) + ")"
CATALOGUE_CTE = """catalogue AS (
  SELECT CONCAT('task_', LPAD(CAST(n AS VARCHAR), 3, '0')) AS task_id,
    'dataset_' || CAST(n % 6 AS VARCHAR) AS dataset,
    ['easy', 'medium', 'hard', 'very_hard', 'expert', 'other'][n % 6 + 1] AS difficulty
  FROM (SELECT DISTINCT user_id % 45 + 1 AS n FROM events) WHERE n % 10 <> 0)"""
