"""Summaries, rankings and paired statistics over the pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runscore.functions.rounding import stable_round
from runscore.operators import stats as Q
from runscore.operators import summary as R
from runscore.operators.compare import compare_pairs, decision_breakdown, radar_series, with_task_meta
from runscore.plans.fixtures import catalogue, load, run_records
from runscore.plans.oracle import (
    BREAKDOWN_CTE,
    CATALOGUE_CTE,
    GAPPY_CTE,
    METRIC_NAMES,
    PAIR_BASE,
    rnd,
    text,
)
from runscore.plans.registry import query
from runscore.schemas import COMPONENTS

WITH = f"WITH {PAIR_BASE},\n{GAPPY_CTE}\n"
WITH_META = f"WITH {PAIR_BASE},\n{GAPPY_CTE},\n{CATALOGUE_CTE}\n"
WITH_BREAKDOWN = f"WITH {PAIR_BASE},\n{BREAKDOWN_CTE}\n"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair table with the gaps of the published results."""
    table = R.from_comparison(compare_pairs(run_records(spark, sf_dir)))
    gap = F.col("metric").isin("DQS", "BAS", "ORS") & (F.col("task_id") <= "task_012")
    return table.withColumns(
        {c: F.when(~gap, F.col(c)) for c in ("baseline", "feedback", "delta", "improved")}
    )


@query(
    "r1_overall_metrics",
    f"""{WITH} SELECT metric, {rnd('COALESCE(b, 0)', 4)} AS baseline_mean,
      {rnd('COALESCE(f, 0)', 4)} AS feedback_mean, {rnd('COALESCE(d, 0)', 4)} AS mean_delta,
      {rnd('COALESCE(m, 0)', 4)} AS median_delta, {rnd('COALESCE(s, 0)', 4)} AS std_dev,
      {rnd('COALESCE(d / NULLIF(b, 0) * 100, 0)', 2)} AS improvement_pct
    FROM (SELECT metric, AVG(baseline) AS b, AVG(feedback) AS f, AVG(delta) AS d,
            MEDIAN(delta) AS m, STDDEV_POP(delta) AS s FROM pairs GROUP BY metric)""",
)
def overall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overall_metrics(pairs(spark, sf_dir))


def _wide_sql() -> str:
    picks = ", ".join(
        f"""MAX({c}) FILTER (WHERE metric = {text(m)}) AS "{m}_{c.title()}\""""
        for m in METRIC_NAMES
        for c in ("baseline", "feedback", "delta", "improved")
    )
    return f"""{WITH_META} SELECT p.*, COALESCE(c.dataset, '') AS dataset,
      COALESCE(c.difficulty, '') AS difficulty FROM (
        SELECT task_id, {picks}, CONCAT_WS(';',
          CASE WHEN BOOL_OR(baseline IS NULL) THEN 'baseline:missing' END,
          CASE WHEN BOOL_OR(baseline IS NOT NULL) THEN 'baseline:ok' END,
          CASE WHEN BOOL_OR(feedback IS NULL) THEN 'feedback:missing' END,
          CASE WHEN BOOL_OR(feedback IS NOT NULL) THEN 'feedback:ok' END) AS "Execution_Status"
        FROM pairs GROUP BY task_id) p LEFT JOIN catalogue c USING (task_id)"""


@query("r2_benchmark_statistics", _wide_sql())
def benchmark_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.benchmark_statistics(pairs(spark, sf_dir), catalogue(spark, sf_dir))


@query(
    "r3_overall_breakdown",
    f"""{WITH_BREAKDOWN} SELECT component, {rnd('AVG(baseline)', 4)} AS baseline,
      {rnd('AVG(feedback_loop)', 4)} AS feedback,
      {rnd('AVG(feedback_loop) - AVG(baseline)', 4)} AS delta,
      COUNT(*) FILTER (WHERE improved) AS improved_count
    FROM breakdown GROUP BY component""",
)
def overall_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overall_breakdown(decision_breakdown(run_records(spark, sf_dir)))


_LEADER = ", ".join(
    f"""COALESCE(MAX(delta) FILTER (WHERE metric = {text(m)}), 0) AS "{m}_Delta\""""
    for m in R.LEADER_METRICS
)


@query(
    "r4_leaderboard",
    f"""{WITH} SELECT *, ROW_NUMBER() OVER (ORDER BY "ORS_Delta" DESC, task_id) AS place,
      RANK() OVER (ORDER BY "ORS_Delta" DESC) AS rank FROM (
      SELECT task_id, {_LEADER}, COUNT(*) FILTER (WHERE improved) AS "Execution_Improved_Count"
      FROM pairs GROUP BY task_id)""",
)
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one row per task: the board is as long as the catalogue, so it can be numbered
    from pyspark.sql import Window

    order = Window.orderBy(F.col("ORS_Delta").desc(), "task_id")
    return R.leaderboard(pairs(spark, sf_dir)).withColumn(
        "place", F.row_number().over(order).cast("long")
    )


@query(
    "r5_top_improvements",
    f"""{WITH} SELECT metric, task_id, delta, position FROM (
      SELECT metric, task_id, COALESCE(delta, 0) AS delta, ROW_NUMBER() OVER (
        PARTITION BY metric ORDER BY COALESCE(delta, 0) DESC, task_id) AS position FROM pairs)
    WHERE position <= 5""",
)
def top_improvements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_improvements(pairs(spark, sf_dir)).withColumn(
        "position", F.col("position").cast("long")
    )


@query(
    "r5_extreme_tasks",
    f"""{WITH}, ranked AS (
      SELECT metric, task_id, COALESCE(delta, 0) AS delta, ROW_NUMBER() OVER (
        PARTITION BY metric ORDER BY COALESCE(delta, 0) DESC, task_id) AS place,
        COUNT(*) OVER (PARTITION BY metric) AS n FROM pairs)
    SELECT metric, MAX(task_id) FILTER (WHERE place = 1) AS first_task,
      MAX(delta) FILTER (WHERE place = 1) AS first_delta,
      MAX(task_id) FILTER (WHERE place = n) AS last_task,
      MAX(delta) FILTER (WHERE place = n) AS last_delta
    FROM ranked GROUP BY metric""",
)
def extreme_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.extreme_tasks(pairs(spark, sf_dir))


@query(
    "r6_presence_counts",
    f"""{WITH} SELECT COUNT(DISTINCT task_id) AS total_tasks,
      COUNT(DISTINCT task_id) FILTER (WHERE baseline IS NOT NULL) AS with_baseline,
      COUNT(DISTINCT task_id) FILTER (WHERE feedback IS NOT NULL) AS with_feedback FROM pairs""",
)
def presence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.presence_counts(pairs(spark, sf_dir))


@query(
    "r7_average_feedback",
    f"""{WITH} SELECT metric, {rnd('COALESCE(AVG(feedback), 0)', 4)} AS mean_feedback
    FROM pairs GROUP BY metric""",
)
def average_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.average_feedback(pairs(spark, sf_dir))


@query(
    "r8_hardest_task",
    f"""WITH {CATALOGUE_CTE} SELECT task_id, difficulty FROM catalogue
    ORDER BY CASE difficulty WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 WHEN 'hard' THEN 3
      WHEN 'very_hard' THEN 4 WHEN 'expert' THEN 5 ELSE 0 END DESC, task_id LIMIT 1""",
)
def hardest_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hardest_task(catalogue(spark, sf_dir).withColumnRenamed("id", "task_id"))


@query(
    "r9_dataset_ranking",
    f"""{WITH_META}, means AS (
      SELECT COALESCE(dataset, '') AS dataset, AVG(feedback) AS m, MIN(task_id) AS first_task
      FROM pairs LEFT JOIN catalogue USING (task_id)
      WHERE metric = 'ORS' AND feedback IS NOT NULL GROUP BY 1)
    SELECT dataset, {rnd('m', 4)} AS mean_ors,
      ROW_NUMBER() OVER (ORDER BY m DESC, first_task) = 1 AS is_best,
      ROW_NUMBER() OVER (ORDER BY m, first_task) = 1 AS is_worst FROM means""",
)
def dataset_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dataset_ranking(with_task_meta(pairs(spark, sf_dir), catalogue(spark, sf_dir)))


def _case(metric: str, order: str, category: str) -> str:
    return f"""(SELECT {text(category)} AS category, task_id, COALESCE(delta, 0) AS delta FROM pairs
      WHERE metric = {text(metric)} ORDER BY COALESCE(delta, 0) {order}, task_id LIMIT 1)"""


_CASES = " UNION ALL ".join(
    [
        _case("ORS", "DESC", "highest_ors_improvement"),
        _case("DQS", "DESC", "highest_dqs_improvement"),
        _case("FIS", "DESC", "highest_fis_improvement"),
        _case("ORS", "ASC", "largest_degradation"),
    ]
)


@query("r10_case_studies", f"{WITH} {_CASES}")
def case_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.case_studies(pairs(spark, sf_dir))


@query(
    "r10_case_study_rows",
    f"{WITH} SELECT * FROM pairs WHERE task_id IN (SELECT task_id FROM ({_CASES}))",
)
def case_study_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.case_study_rows(pairs(spark, sf_dir))


def _histogram_sql(by: str, bins: int) -> str:
    keys = f"{by}, " if by else ""
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    group = f"{by}, bin" if by else "bin"
    return f"""{WITH}, spread AS (
      SELECT {keys}delta, MIN(delta) {over} AS lo, MAX(delta) {over} AS hi
      FROM pairs WHERE delta IS NOT NULL)
    SELECT {keys}CAST(LEAST({bins - 1}, FLOOR((delta - a) * {bins} / (b - a))) AS INTEGER) AS bin,
      COUNT(*) AS n
    FROM (SELECT *, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS a,
            CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS b FROM spread)
    GROUP BY {group}"""


@query("r11_delta_distribution", _histogram_sql("metric", 20))
def delta_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.delta_distribution(pairs(spark, sf_dir), 20)


@query("r11_improvement_histogram", _histogram_sql("", 50))
def improvement_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.delta_distribution(pairs(spark, sf_dir), 50, by=[])


@query(
    "r12_delta_boxplot",
    f"""{WITH}, q AS (
      SELECT metric, QUANTILE_CONT(delta, 0.25) AS q1, MEDIAN(delta) AS q2,
        QUANTILE_CONT(delta, 0.75) AS q3 FROM pairs WHERE delta IS NOT NULL GROUP BY metric)
    SELECT metric, {rnd('q1', 6)} AS q1, {rnd('q2', 6)} AS q2, {rnd('q3', 6)} AS q3,
      MIN(delta) FILTER (WHERE inside) AS whisker_low, MAX(delta) FILTER (WHERE inside) AS whisker_high,
      COUNT(*) FILTER (WHERE NOT inside) AS outliers
    FROM (SELECT *, delta BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
          FROM pairs JOIN q USING (metric) WHERE delta IS NOT NULL)
    GROUP BY metric, q1, q2, q3""",
)
def delta_boxplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = R.delta_boxplot(pairs(spark, sf_dir))
    return table.withColumns({c: stable_round(F.col(c), 6) for c in ("q1", "q2", "q3")})


@query(
    "r13_metric_mean_correlation",
    f"""{WITH} SELECT {rnd('CORR(b, f)', 4)} AS correlation FROM (
      SELECT {rnd('AVG(baseline)', 4)} AS b, {rnd('AVG(feedback)', 4)} AS f
      FROM pairs GROUP BY metric)""",
)
def metric_mean_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.metric_mean_correlation(pairs(spark, sf_dir))


_AXIS = "list_position([" + ", ".join(text(n) for n in COMPONENTS.values()) + "], component)"


@query(
    "r14_radar_series",
    f"""{WITH_BREAKDOWN} SELECT task_id, component, mode, score, CAST({_AXIS} AS BIGINT) AS axis FROM (
      SELECT task_id, component, 'baseline' AS mode, baseline AS score FROM breakdown UNION ALL
      SELECT task_id, component, 'feedback_loop', feedback_loop FROM breakdown)""",
)
def radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radar_series(decision_breakdown(run_records(spark, sf_dir)))


# --- paired statistics over the line items ----------------------------------
def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity against a price step per line; many ties and some zero differences."""
    keys = ["l_returnflag", "l_orderkey", "l_linenumber"]
    return load(spark, sf_dir, "lineitem").groupBy(*keys).agg(
        F.min("l_quantity").alias("baseline"),
        F.floor(F.min("l_extendedprice") / 2000).cast("double").alias("feedback"),
    )


LINE_CTE = """line_pairs AS (
  SELECT l_returnflag, MIN(l_quantity) AS baseline,
    CAST(FLOOR(MIN(l_extendedprice) / 2000) AS DOUBLE) AS feedback
  FROM lineitem GROUP BY l_returnflag, l_orderkey, l_linenumber)"""
MOMENTS = """SELECT l_returnflag, COUNT(*) AS n, AVG(feedback - baseline) AS m,
  STDDEV_SAMP(feedback - baseline) AS s, STDDEV_POP(feedback - baseline) AS p,
  AVG(feedback) - AVG(baseline) AS g FROM line_pairs GROUP BY l_returnflag"""
SIGNED = """signed AS (
  SELECT l_returnflag, d, RANK() OVER w + (COUNT(*) OVER (PARTITION BY l_returnflag, ABS(d)) - 1) / 2.0 AS r,
    COUNT(*) OVER (PARTITION BY l_returnflag, ABS(d)) AS c
  FROM (SELECT l_returnflag, feedback - baseline AS d FROM line_pairs WHERE feedback <> baseline)
  WINDOW w AS (PARTITION BY l_returnflag ORDER BY ABS(d))),
ranks AS (
  SELECT l_returnflag, SUM(r) FILTER (WHERE d > 0) AS up, SUM(r) FILTER (WHERE d < 0) AS down,
    COUNT(*)::DOUBLE AS m, SUM(c::DOUBLE * c - 1) AS tie FROM signed GROUP BY l_returnflag),
scores AS (
  SELECT *, LEAST(up, down) AS w, (LEAST(up, down) - m * (m + 1) / 4)
    / SQRT(m * (m + 1) * (2 * m + 1) / 24 - tie / 48) AS z FROM ranks)"""
BY = ["l_returnflag"]


@query(
    "q1_paired_ttest",
    f"WITH {LINE_CTE} SELECT l_returnflag, n, {rnd('m / (s / SQRT(n))', 6)} AS t FROM ({MOMENTS})",
)
def paired_ttest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Q.paired_ttest(line_pairs(spark, sf_dir), BY)
    return table.select(*BY, "n", stable_round(F.col("t"), 6).alias("t"))


@query(
    "q2_wilcoxon",
    f"""WITH {LINE_CTE}, {SIGNED} SELECT l_returnflag, CAST(w AS DOUBLE) AS w,
      {rnd('z', 6)} AS z FROM scores""",
)
def wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Q.wilcoxon(line_pairs(spark, sf_dir), BY)
    return table.select(*BY, "w", stable_round(F.col("z"), 6).alias("z"))


@query(
    "q3_mean_diff_ci",
    # with tens of thousands of pairs the t quantile equals its expansion around the normal one
    f"""WITH {LINE_CTE}, q AS (SELECT 1.959963984540054::DOUBLE AS x)
    SELECT l_returnflag, {rnd('m - h', 4)} AS ci_low, {rnd('m + h', 4)} AS ci_high FROM (
      SELECT l_returnflag, m, p / SQRT(n) * (x + (x * x * x + x) / (4 * (n - 1))
        + (5 * x ** 5 + 16 * x ** 3 + 3 * x) / (96 * (n - 1.0::DOUBLE) ** 2)) AS h FROM ({MOMENTS}), q)""",
)
def mean_diff_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Q.mean_diff_ci(line_pairs(spark, sf_dir), BY)
    return table.select(*BY, *[stable_round(F.col(c), 4).alias(c) for c in ("ci_low", "ci_high")])


@query("q4_cohen_d", f"WITH {LINE_CTE} SELECT l_returnflag, {rnd('g / p', 6)} AS cohen_d FROM ({MOMENTS})")
def cohen_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Q.cohen_d(line_pairs(spark, sf_dir), BY)
    return table.select(*BY, stable_round(F.col("cohen_d"), 6).alias("cohen_d"))


@query(
    "q5_paired_stats",
    f"""WITH {LINE_CTE}, {SIGNED} SELECT l_returnflag, n, {rnd('mo.m / (s / SQRT(n))', 6)} AS t,
      CAST(w AS DOUBLE) AS w, {rnd('z', 6)} AS z, {rnd('mo.m', 6)} AS mean_diff, {rnd('p', 6)} AS sd_diff,
      {rnd('g / p', 6)} AS cohen_d
    FROM ({MOMENTS}) mo JOIN scores USING (l_returnflag)""",
)
def paired_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Q.paired_stats(line_pairs(spark, sf_dir), BY)
    rounded = [
        stable_round(F.col(c), 6).alias(c) for c in ("t", "z", "mean_diff", "sd_diff", "cohen_d")
    ]
    return table.select(*BY, "n", "w", *rounded)


@query("q5_metric_stats")
def metric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tests of the eight metrics over the paired tasks, p values included."""
    return Q.paired_stats(pairs(spark, sf_dir), ["metric"])
