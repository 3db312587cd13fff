"""Spark ML jobs over all line items. Rows are split by order key."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runscore.functions.rounding import stable_round
from runscore.operators import models as M
from runscore.operators.linear import fit_linear
from runscore.plans.data_queries import FEATURES, _spread, lineitem, rounded
from runscore.plans.oracle import rnd
from runscore.plans.registry import query
from runscore.runtime import spread_small

GROUPS = {"price": ["l_quantity", "l_extendedprice"], "terms": ["l_discount", "l_tax", "l_linestatus"]}


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a yes/no target and some missing inputs."""
    line = F.col("l_linenumber")
    return spread_small(lineitem(spark, sf_dir)).select(
        "l_orderkey",
        *FEATURES[1:],
        F.when(line != 7, F.col("l_quantity")).alias("l_quantity"),
        F.when(line != 6, F.col("l_linestatus")).alias("l_linestatus"),
        (F.col("l_returnflag") == "R").cast("int").alias("returned"),
        F.col("l_returnflag"),
    )


def spec(**changes) -> M.ModelSpec:
    base = M.ModelSpec(
        "returned", "l_orderkey", tuple(FEATURES), ("l_linestatus",), "random_forest", params=M.FOREST
    )
    return replace(base, **changes)


def price_spec(**changes) -> M.ModelSpec:
    return spec(
        target="l_extendedprice", numeric=("l_quantity", "l_discount", "l_tax"),
        task="regression", **changes,
    )


# Least squares again in SQL: every input is cleared of the inputs before it
# (Gram-Schmidt over the training rows), then the target is regressed on what is left.
SPLIT_SQL = f"""lines AS (
  SELECT l_orderkey, l_extendedprice AS y, l_discount AS d, l_tax AS t,
    CASE WHEN l_linenumber <> 7 THEN l_quantity END AS q0,
    CASE WHEN l_linenumber <> 6 THEN l_linestatus END AS s0, h FROM {_spread('lineitem', 'l_orderkey')}),
cut AS (
  SELECT h AS last FROM (SELECT h, ROW_NUMBER() OVER (ORDER BY h) AS rn, COUNT(*) OVER () AS n FROM lines)
  WHERE rn = FLOOR(0.8 * n)),
parts AS (SELECT *, h <= last AS is_train FROM lines, cut),
usual AS (SELECT s0 AS s FROM parts WHERE is_train AND s0 IS NOT NULL GROUP BY s0 ORDER BY COUNT(*) DESC, s0 LIMIT 1),
filled AS (
  SELECT *, COALESCE(q0, (SELECT AVG(q0) FROM parts WHERE is_train)) AS q,
    CAST(COALESCE(s0, (SELECT s FROM usual)) <> (SELECT s FROM usual) AS DOUBLE) AS s FROM parts)"""


def least_squares_sql(name: str, inputs: list[str]) -> str:
    """CTEs that end in ``<name>``: the filled rows with ``prediction``."""
    parts, last = [], "filled"
    for i, x in enumerate(inputs):
        before = range(i)
        slopes = "".join(f", REGR_SLOPE({x}, {name}_r{k}) AS b{k}" for k in before)
        cleared = "".join(f" - b{k} * {name}_r{k}" for k in before)
        parts.append(
            f"{name}_{i} AS (SELECT {last}.*, {x} - m{cleared} AS {name}_r{i} FROM {last}, "
            f"(SELECT AVG({x}) AS m{slopes} FROM {last} WHERE is_train))"
        )
        last = f"{name}_{i}"
    slopes = "".join(f", REGR_SLOPE(y, {name}_r{k}) AS b{k}" for k in range(len(inputs)))
    line = "".join(f" + b{k} * {name}_r{k}" for k in range(len(inputs)))
    parts.append(
        f"{name} AS (SELECT {last}.*, m{line} AS prediction FROM {last}, "
        f"(SELECT AVG(y) AS m{slopes} FROM {last} WHERE is_train))"
    )
    return ",\n".join(parts)


R2_SQL = "(SELECT 1 - SUM((y - prediction) ** 2) / (VAR_POP(y) * COUNT(*)) FROM {} WHERE NOT is_train)"


@query("p8_baseline_model")
def baseline_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).drop("returned")
    return M.baseline_model(rows, "l_returnflag", "l_orderkey")


@query("w11_logistic_balanced")
def logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.train_eval(labelled(spark, sf_dir), spec(model="logistic", balanced=True, params={}))


@query("w11_gradient_boosting")
def boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.train_eval(labelled(spark, sf_dir), spec(model="gradient_boosting", params={}))


@query(
    "w11_linear",
    f"""WITH {SPLIT_SQL}, {least_squares_sql('fitted', ['q', 'd', 't', 's'])}
    SELECT {rnd('SQRT(AVG((y - prediction) ** 2))', 4)} AS rmse, {rnd(R2_SQL.format('fitted'), 8)} AS r2
    FROM fitted WHERE NOT is_train""",
)
def linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = M.train_eval(labelled(spark, sf_dir), price_spec(model="linear", params={}))
    return rounded(rounded(scored, 4, "rmse"), 8, "r2")


@query("w11_forest_regression")
def forest_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.train_eval(labelled(spark, sf_dir), price_spec())


@query("w13_compare_models")
def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.compare_models(
        labelled(spark, sf_dir),
        {
            "logistic": spec(model="logistic", params={}),
            "random_forest": spec(),
            "gradient_boosting": spec(model="gradient_boosting", params={}),
        },
        "f1_macro",
    )


@query("w14_feature_importance")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.feature_importance(labelled(spark, sf_dir), price_spec(categorical=()))


@query("w17_counterfactuals")
def counterfactuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest changes of quantity and discount that turn a large line into a small one.

    Lines that are equal in every column have the same answer and count once.
    """
    table = lineitem(spark, sf_dir).distinct()
    lines = table.withColumns(
        {
            "dear": (F.col("l_quantity") * (1 - F.col("l_discount")) > 24).cast("int"),
            "line_id": F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns]),
        }
    )
    wanted = spec(
        target="dear", key="line_id", numeric=("l_quantity", "l_discount"), categorical=(),
        model="logistic", params={},
    )
    edits = [
        {"l_discount": 0.1}, {"l_quantity": 20.0}, {"l_quantity": 10.0},
        {"l_quantity": 10.0, "l_discount": 0.1},
    ]
    with M.prepare(lines, wanted) as split:
        model = M.fit(split, wanted)
        chosen = model.transform(split.rows).where(F.col(M.PREDICTION) == 1.0).select(
            "row_key", *wanted.numeric
        )
        return M.counterfactuals(chosen, model, edits, "row_key", 0.0)


@query(
    "w20_model_contributions",
    # the weight of an input: the slope of what is left of it after all the others
    f"""WITH {SPLIT_SQL}, {least_squares_sql('qd', ['d', 't', 'q'])},
    {least_squares_sql('dd', ['q', 't', 'd'])}, {least_squares_sql('td', ['q', 'd', 't'])}, weights AS (
      SELECT (SELECT REGR_SLOPE(y, qd_r2) FROM qd WHERE is_train) AS q, (SELECT REGR_SLOPE(y, dd_r2) FROM dd WHERE is_train) AS d,
        (SELECT REGR_SLOPE(y, td_r2) FROM td WHERE is_train) AS t),
    whole AS (SELECT AVG(q0) AS q, AVG(d) AS d, AVG(t) AS t FROM lines WHERE q0 IS NOT NULL),
    means AS (
      SELECT AVG(ABS(w.q * (l.q0 - m.q))) AS l_quantity, AVG(ABS(w.d * (l.d - m.d))) AS l_discount,
        AVG(ABS(w.t * (l.t - m.t))) AS l_tax FROM lines l, whole m, weights w WHERE l.q0 IS NOT NULL)
    SELECT feature, {rnd('value', 4)} AS mean_abs_contribution
    FROM (UNPIVOT means ON l_quantity, l_discount, l_tax INTO NAME feature VALUE value)""",
)
def model_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global contributions of a fitted linear model."""
    wanted = price_spec(model="linear", params={}, categorical=())
    fitted = fit_linear(labelled(spark, sf_dir), wanted)
    complete = fitted.rows.na.drop(subset=list(wanted.numeric))
    explained = M.local_contributions(complete, fitted.coefficients())
    return rounded(M.global_contributions(explained, list(wanted.numeric)), 4, "mean_abs_contribution")


@query(
    "w21_model_residuals",
    f"""WITH {SPLIT_SQL}, {least_squares_sql('fitted', ['q', 'd', 't', 's'])},
    scored AS (SELECT l_orderkey, y - prediction AS residual, STDDEV_SAMP(y - prediction) OVER () AS spread FROM fitted)
    SELECT l_orderkey AS row_key, {rnd('residual', 3)} AS residual, {rnd('residual / spread', 5)} AS z
    FROM scored WHERE residual / spread > 1.5""",
)
def model_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies against a model's expectation instead of a group mean."""
    from runscore.operators.workload import score_residuals

    fitted = fit_linear(labelled(spark, sf_dir), price_spec(model="linear", params={}))
    rows = fitted.rows.select("row_key", (F.col(M.LABEL) - fitted.prediction()).alias("residual"))
    unusual = score_residuals(rows, 1.5).where("is_anomaly")
    return unusual.select(
        "row_key", stable_round(F.col("residual"), 3).alias("residual"), stable_round(F.col("z"), 5).alias("z")
    )


@query(
    "w22_feature_group_ablation",
    f"""WITH {SPLIT_SQL}, {least_squares_sql('whole', ['q', 'd', 't', 's'])}, {least_squares_sql('quantity', ['q'])},
    {least_squares_sql('terms', ['d', 't', 's'])}, scores AS (
      SELECT {R2_SQL.format('whole')} AS w, {R2_SQL.format('quantity')} AS q, {R2_SQL.format('terms')} AS t),
    rows AS (
      SELECT 'quantity' AS feature_group, q AS alone, t AS removed, w FROM scores
      UNION ALL SELECT 'terms', t, q, w FROM scores)
    SELECT feature_group, {rnd('alone', 8)} AS alone, {rnd('removed', 8)} AS removed, {rnd('w', 8)} AS all_features,
      {rnd('w - removed', 8)} AS loss_when_removed, ROW_NUMBER() OVER (ORDER BY w - removed DESC, feature_group) AS place
    FROM rows""",
)
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = {"quantity": ["l_quantity"], "terms": ["l_discount", "l_tax", "l_linestatus"]}
    table = M.feature_group_ablation(
        labelled(spark, sf_dir), price_spec(model="linear", params={}), groups, "r2"
    )
    return rounded(table, 8, "alone", "removed", "all_features", "loss_when_removed")
