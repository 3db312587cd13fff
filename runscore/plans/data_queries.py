"""Profiling, preparation and labelled-table analyses over the given tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runscore.functions.rounding import stable_round
from runscore.operators import models as M
from runscore.operators import prep
from runscore.operators import profile as P
from runscore.operators import workload as W
from runscore.operators.ordered import few_groups
from runscore.plans.fixtures import load
from runscore.plans.oracle import rnd, text
from runscore.plans.registry import query

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *FEATURES, "l_returnflag",
    "l_linestatus", "l_shipdate",
]


def rounded(table: DataFrame, digits: int, *columns: str) -> DataFrame:
    return table.withColumns({c: stable_round(F.col(c), digits) for c in columns})


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem")


def returned() -> Column:
    return F.col("l_returnflag") == "R"


def messy_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with missing balances and segment markers put in."""
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    return load(spark, sf_dir, "customer").withColumns(
        {
            "c_acctbal": F.when(key % 7 != 0, F.col("c_acctbal")),
            "c_mktsegment": F.when(key % 9 == 0, F.lit("?"))
            .when(key % 13 == 0, F.lit("  "))
            .otherwise(F.concat(segment, F.lit("."))),
        }
    )


MESSY = """messy AS (
  SELECT c_custkey, c_name, c_nationkey,
    CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal,
    CASE WHEN c_custkey % 9 = 0 THEN '?' WHEN c_custkey % 13 = 0 THEN '  '
      ELSE c_mktsegment || '.' END AS c_mktsegment FROM customer),
clean AS (
  SELECT * REPLACE (CASE WHEN TRIM(c_mktsegment) NOT IN ('?', '')
    THEN regexp_replace(c_mktsegment, '\\.\\s*$', '') END AS c_mktsegment) FROM messy)"""


def clean_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.missing_markers(
        messy_customers(spark, sf_dir), ["c_mktsegment"], label_columns=["c_mktsegment"]
    )


# --- profiling --------------------------------------------------------------
CUSTOMER_TYPES = [
    ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
    ("c_acctbal", "double"), ("c_mktsegment", "string"),
]


@query(
    "p1_profile",
    f"WITH {MESSY} "
    + " UNION ALL ".join(
        f"SELECT {i} AS position, {text(c)} AS \"column\", {text(kind)} AS dtype, COUNT(*) AS n, "
        f"COUNT(*) - COUNT({c}) AS nulls FROM clean"
        for i, (c, kind) in enumerate(CUSTOMER_TYPES)
    ),
)
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile(clean_customers(spark, sf_dir).select(*[c for c, _ in CUSTOMER_TYPES]))


@query(
    "p2_describe_numeric",
    " UNION ALL ".join(
        f"""SELECT {text(c)} AS "column", COUNT({c}) AS count, {rnd(f'AVG({c})', 6)} AS mean,
          {rnd(f'STDDEV_SAMP({c})', 6)} AS std, MIN({c}) AS min,
          {rnd(f'QUANTILE_CONT({c}, 0.25)', 6)} AS p25, {rnd(f'MEDIAN({c})', 6)} AS p50,
          {rnd(f'QUANTILE_CONT({c}, 0.75)', 6)} AS p75, MAX({c}) AS max FROM lineitem"""
        for c in FEATURES
    ),
)
def describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = P.describe_numeric(lineitem(spark, sf_dir), FEATURES)
    return rounded(table, 6, "mean", "std", "p25", "p50", "p75")


@query(
    "p3_sample_rows",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5",
)
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return P.sample_rows(orders, 5, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query(
    "p4_histogram",
    """WITH v AS (SELECT l_extendedprice AS v FROM lineitem),
      e AS (SELECT MIN(v) AS lo, MAX(v) AS hi FROM v)
    SELECT CAST(LEAST(19, FLOOR((v - lo) * 20 / (hi - lo))) AS INTEGER) AS bin, COUNT(*) AS n
    FROM v, e GROUP BY 1""",
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.histogram(lineitem(spark, sf_dir), "l_extendedprice", 20)


@query(
    "p5_correlation_matrix",
    " UNION ALL ".join(
        f"SELECT {text(a)} AS x, {text(b)} AS y, "
        + ("1.0::DOUBLE" if a == b else rnd(f"CORR({a}, {b})", 8))
        + " AS r"
        + ("" if a == b else " FROM lineitem")
        for a in FEATURES
        for b in FEATURES
    ),
)
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.correlation_matrix(lineitem(spark, sf_dir), FEATURES), 8, "r")


def _pair_bins_sql() -> str:
    edges = ", ".join(f"MIN({c}) AS {c}_lo, MAX({c}) AS {c}_hi" for c in FEATURES)
    bins = ", ".join(
        f"CAST(LEAST(9, FLOOR(({c} - {c}_lo) * 10 / ({c}_hi - {c}_lo))) AS INTEGER) AS {c}"
        for c in FEATURES
    )
    parts = " UNION ALL ".join(
        f"SELECT {text(a)} AS x, {text(b)} AS y, {a} AS x_bin, {b} AS y_bin, COUNT(*) AS n "
        f"FROM binned GROUP BY ALL"
        for a, b in combinations(FEATURES, 2)
    )
    return f"""WITH e AS (SELECT {edges} FROM lineitem), binned AS (SELECT {bins} FROM lineitem, e)
      {parts}"""


@query("p6_pair_bins", _pair_bins_sql())
def pair_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pair_bins(lineitem(spark, sf_dir), FEATURES, 10)


@query(
    "p7_infer_task_type",
    """SELECT 'l_returnflag' AS target, COUNT(DISTINCT l_returnflag) AS distinct_values,
        'classification' AS task_type FROM lineitem
    UNION ALL SELECT c, n, CASE WHEN n <= 20 THEN 'classification' ELSE 'regression' END FROM (
      SELECT 'l_discount' AS c, COUNT(DISTINCT l_discount) AS n FROM lineitem UNION ALL
      SELECT 'l_extendedprice', COUNT(DISTINCT l_extendedprice) FROM lineitem)""",
)
def infer_task_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lineitem(spark, sf_dir)
    tables = [
        P.infer_task_type(lines, c).withColumn("target", F.lit(c))
        for c in ("l_returnflag", "l_discount", "l_extendedprice")
    ]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three classes and a rule that predicts them, plus a numeric estimate."""
    line = F.col("l_linenumber")
    return lineitem(spark, sf_dir).select(
        F.when(returned(), 1.0).when(F.col("l_returnflag") == "A", 2.0).otherwise(0.0).alias("label"),
        ((F.col("l_orderkey") + line) % 3).cast("double").alias("prediction"),
        F.col("l_extendedprice").alias("actual"),
        (F.col("l_quantity") * 2000 - line).alias("estimate"),
    )


PREDICTIONS = """predictions AS (
  SELECT CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 2.0 ELSE 0.0 END AS label,
    CAST((l_orderkey + l_linenumber) % 3 AS DOUBLE) AS prediction, l_extendedprice AS actual,
    l_quantity * 2000 - l_linenumber AS estimate FROM lineitem)"""


@query(
    "p9_classification_metrics",
    f"""WITH {PREDICTIONS}, c AS (
      SELECT k, (SELECT COUNT(*) FROM predictions WHERE label = k)::DOUBLE AS a,
        (SELECT COUNT(*) FROM predictions WHERE prediction = k)::DOUBLE AS p,
        (SELECT COUNT(*) FROM predictions WHERE label = k AND prediction = k)::DOUBLE AS t
      FROM (SELECT UNNEST([0.0, 1.0, 2.0]) AS k))
    SELECT {rnd('SUM(t) / SUM(a)', 8)} AS accuracy, {rnd('AVG(2 * t / (a + p))', 8)} AS f1_macro,
      {rnd('SUM(2 * t / (a + p) * a) / SUM(a)', 8)} AS f1_weighted,
      {rnd('MAX(t / p) FILTER (WHERE k = 1)', 8)} AS precision,
      {rnd('MAX(t / a) FILTER (WHERE k = 1)', 8)} AS recall,
      {rnd('MAX(2 * t / (a + p)) FILTER (WHERE k = 1)', 8)} AS f1 FROM c""",
)
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = M.classification_metrics(predictions(spark, sf_dir), positive=1.0)
    return rounded(table, 8, *table.columns)


@query(
    "p9_auc",
    f"""WITH {PREDICTIONS}, r AS (
      SELECT label = 1 AS pos, RANK() OVER (ORDER BY estimate) + (COUNT(*) OVER (PARTITION BY estimate) - 1) / 2.0
        AS rk FROM predictions)
    SELECT {rnd('(SUM(rk) FILTER (WHERE pos) - n1 * (n1 + 1) / 2) / (n1 * n0)', 8)} AS auc
    FROM r, (SELECT COUNT(*) FILTER (WHERE label = 1)::DOUBLE AS n1,
               COUNT(*) FILTER (WHERE label <> 1)::DOUBLE AS n0 FROM predictions)
    GROUP BY n1, n0""",
)
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.auc(predictions(spark, sf_dir), "estimate", F.col("label") == 1), 8, "auc")


@query(
    "p10_regression_metrics",
    f"""WITH {PREDICTIONS} SELECT {rnd('SQRT(AVG((actual - estimate) ** 2))', 4)} AS rmse,
      {rnd('1 - SUM((actual - estimate) ** 2) / (VAR_POP(actual) * COUNT(*))', 8)} AS r2
    FROM predictions""",
)
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = M.regression_metrics(predictions(spark, sf_dir), "actual", "estimate")
    return rounded(rounded(table, 4, "rmse"), 8, "r2")


# --- rates and groups -------------------------------------------------------
@query(
    "w1_rate_by",
    f"""SELECT l_linestatus, l_linenumber, COUNT(*) AS n,
      {rnd("AVG(CAST(l_returnflag = 'R' AS DOUBLE))", 8)} AS rate,
      CAST(GROUPING(l_linestatus) + GROUPING(l_linenumber) AS INTEGER) AS level
    FROM lineitem GROUP BY ROLLUP (l_linestatus, l_linenumber)""",
)
def rate_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = W.rate_by(lineitem(spark, sf_dir), ["l_linestatus", "l_linenumber"], returned())
    return rounded(table, 8, "rate")


@query(
    "w1_toxic_rate_by_source",
    f"""SELECT lang, source, COUNT(*) AS n, {rnd('AVG(CAST(toxic = 1 AS DOUBLE))', 8)} AS rate,
      CAST(GROUPING(lang) + GROUPING(source) AS INTEGER) AS level
    FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, source)""",
)
def toxic_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    joined = load(spark, sf_dir, "labels").join(documents, "doc_id")
    return rounded(W.rate_by(joined, ["lang", "source"], F.col("toxic") == 1), 8, "rate")


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    orders = load(spark, sf_dir, "orders")
    return orders.join(customer, orders.o_custkey == customer.c_custkey)


@query(
    "w2_top_groups_median",
    f"""SELECT c_nationkey, COUNT(*) AS n, {rnd('MEDIAN(o_totalprice)', 4)} AS median
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey
    ORDER BY n DESC, c_nationkey LIMIT 5""",
)
def top_groups_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = W.top_groups_median(customer_orders(spark, sf_dir), "c_nationkey", "o_totalprice", 5)
    return rounded(table, 4, "median")


@query(
    "w3_mean_by",
    f"""SELECT c_mktsegment, o_orderpriority, COUNT(*) AS n, {rnd('AVG(o_totalprice)', 4)} AS mean
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderpriority""",
)
def mean_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ["c_mktsegment", "o_orderpriority"]
    return rounded(W.mean_by(customer_orders(spark, sf_dir), groups, "o_totalprice"), 4, "mean")


@query(
    "w4_crosstab_counts",
    """SELECT l_linenumber, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS "n_R",
      COUNT(*) FILTER (WHERE l_returnflag = 'A') AS "n_A",
      COUNT(*) FILTER (WHERE l_returnflag = 'N') AS "n_N" FROM lineitem GROUP BY l_linenumber""",
)
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.crosstab_counts(lineitem(spark, sf_dir), "l_linenumber", "l_returnflag", ["R", "A", "N"])


# --- preparation ------------------------------------------------------------
@query("w5_missing_markers", f"WITH {MESSY} SELECT c_custkey, c_mktsegment FROM clean")
def missing_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_customers(spark, sf_dir).select("c_custkey", "c_mktsegment")


@query(
    "w6_impute_grouped_median",
    f"""WITH {MESSY} SELECT c_custkey, {rnd('''COALESCE(c_acctbal,
      MEDIAN(c_acctbal) OVER (PARTITION BY c_nationkey))''', 4)} AS c_acctbal FROM clean""",
)
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = prep.impute(clean_customers(spark, sf_dir), "c_acctbal", "median", ["c_nationkey"])
    return rounded(filled.select("c_custkey", "c_acctbal"), 4, "c_acctbal")


@query(
    "w6_impute_mode",
    f"""WITH {MESSY}, m AS (SELECT c_mktsegment AS mode FROM clean WHERE c_mktsegment IS NOT NULL
      GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)
    SELECT c_custkey, COALESCE(c_mktsegment, mode) AS c_mktsegment FROM clean, m""",
)
def impute_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = prep.impute(clean_customers(spark, sf_dir), "c_mktsegment", "mode")
    return filled.select("c_custkey", "c_mktsegment")


@query(
    "w6_null_change",
    f"""WITH {MESSY} SELECT 'c_acctbal' AS "column", COUNT(*) - COUNT(c_acctbal) AS before,
      CAST(0 AS BIGINT) AS after FROM clean
    UNION ALL SELECT 'c_mktsegment', COUNT(*) - COUNT(c_mktsegment), CAST(0 AS BIGINT) FROM clean""",
)
def null_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = clean_customers(spark, sf_dir)
    after = prep.impute(before, "c_acctbal", "median", ["c_nationkey"])
    after = prep.impute(after, "c_mktsegment", "constant", value="UNKNOWN")
    return prep.null_change(before, after, ["c_acctbal", "c_mktsegment"])


@query(
    "w7_ratio_features",
    f"""SELECT l_orderkey, l_linenumber,
      {rnd('l_extendedprice / NULLIF(CASE WHEN l_linenumber = 7 THEN 0 ELSE l_quantity END, 0)', 4)} AS unit_price,
      {rnd('(GREATEST(l_tax - 0.04, 0) + GREATEST(l_discount - 0.05, 0)) / 2', 6)} AS excess
    FROM lineitem""",
)
def ratio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lineitem(spark, sf_dir).withColumns(
        {
            "divisor": F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("l_quantity")),
            "tax_over": F.col("l_tax") - 0.04,
            "discount_over": F.col("l_discount") - 0.05,
        }
    )
    made = prep.ratio_features(
        lines,
        {"unit_price": ("l_extendedprice", "divisor")},
        {"excess": ["tax_over", "discount_over"]},
    )
    made = made.select("l_orderkey", "l_linenumber", "unit_price", "excess")
    return rounded(rounded(made, 4, "unit_price"), 6, "excess")


@query(
    "w8_top_correlated",
    f"""SELECT feature, {rnd('r', 8)} AS r FROM ("""
    + " UNION ALL ".join(
        f"SELECT {text(c)} AS feature, CORR({c}, CAST(l_returnflag = 'R' AS DOUBLE)) AS r FROM lineitem"
        for c in FEATURES
    )
    + ") ORDER BY ABS(r) DESC, feature LIMIT 3",
)
def top_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.top_correlated(lineitem(spark, sf_dir), returned(), FEATURES, 3), 8, "r")


@query(
    "w9_iqr_clip",
    f"""WITH q AS (SELECT QUANTILE_CONT(o_totalprice, 0.25) AS q1, QUANTILE_CONT(o_totalprice, 0.75) AS q3
      FROM orders WHERE o_orderkey % 5 <> 0),
    b AS (SELECT q1 - 0.25 * (q3 - q1) AS lo, q3 + 0.25 * (q3 - q1) AS hi FROM q)
    SELECT o_orderkey, {rnd('LEAST(hi, GREATEST(lo, o_totalprice))', 4)} AS o_totalprice_clipped,
      o_totalprice < lo OR o_totalprice > hi AS is_outlier FROM orders, b""",
)
def iqr_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    train = F.col("o_orderkey") % 5 != 0
    # a narrow factor, because these prices have no outliers at 1.5
    clipped = prep.iqr_clip(orders, "o_totalprice", train, factor=0.25).drop("o_totalprice")
    return rounded(clipped, 4, "o_totalprice_clipped")


# --- fixed values: the five primes and the seed of xxhash64 ------------------
_PRIMES = (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63,
    0x27D4EB2F165667C5,
)
_SEED = 42
# ----------------------------------------------------------------------------


def _spread(table: str, key: str) -> str:
    """The table with ``h``, the xxhash64 of a bigint key, in wide SQL integers."""
    whole = "18446744073709551616::UHUGEINT"

    def times(x: str, prime: int) -> str:
        return f"(({x}) * {prime}::UHUGEINT) % {whole}"

    def rotated(x: str, bits: int) -> str:
        return f"(({x} * {1 << bits}::UHUGEINT) % {whole} + {x} // {1 << 64 - bits}::UHUGEINT)"

    def folded(bits: int) -> str:
        return f"xor(h, h // {1 << bits}::UHUGEINT)"

    p1, p2, p3, p4, p5 = _PRIMES
    sql = f"SELECT *, {times(f'{key}::UHUGEINT', p2)} AS h FROM {table}"
    for step in (
        times(rotated("h", 31), p1),
        f"xor(h, {(_SEED + p5 + 8) % (1 << 64)}::UHUGEINT)",
        f"({times(rotated('h', 27), p1)} + {p4}::UHUGEINT) % {whole}",
        folded(33), times("h", p2), folded(29), times("h", p3), folded(32),
        f"CASE WHEN h >= {1 << 63}::UHUGEINT THEN h::HUGEINT - {1 << 64}::HUGEINT ELSE h::HUGEINT END",
    ):
        sql = f"SELECT * REPLACE ({step} AS h) FROM ({sql})"
    return f"({sql})"


@query(
    "w10_stratified_split",
    f"""SELECT o_orderkey, o_orderstatus, ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY h)
      <= FLOOR(0.8 * COUNT(*) OVER (PARTITION BY o_orderstatus)) AS is_train FROM {_spread('orders', 'o_orderkey')}""",
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    few = few_groups(orders, ["o_orderstatus"])
    return prep.stratified_split(orders, "o_orderstatus", "o_orderkey", few=few)


@query(
    "w12_class_weights",
    f"""SELECT l_orderkey, l_linenumber, l_returnflag, {rnd('''
      COUNT(*) OVER () / (k * COUNT(*) OVER (PARTITION BY l_returnflag))::DOUBLE''', 8)} AS weight
    FROM lineitem, (SELECT COUNT(DISTINCT l_returnflag) AS k FROM lineitem)""",
)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_returnflag")
    return rounded(prep.with_class_weights(lines, "l_returnflag"), 8, "weight")


# --- targeting, leakage, response, segments ---------------------------------
@query(
    "w15_target_top_share",
    f"""WITH r AS (
      SELECT o_orderstatus = 'F' AS p, COUNT(*) OVER () AS n,
        ROW_NUMBER() OVER (ORDER BY FLOOR(o_totalprice / 20000) DESC, h) AS rn
      FROM {_spread('orders', 'o_orderkey')})
    SELECT n, positives, targeted, positives_targeted,
      positives_targeted * 0.5::DOUBLE AS expected_prevented,
      {rnd('positives / n::DOUBLE', 8)} AS rate_before,
      {rnd('(positives - positives_targeted * 0.5) / n::DOUBLE', 8)} AS rate_after,
      {rnd('positives_targeted * 0.5 / n::DOUBLE', 8)} AS rate_reduction
    FROM (SELECT MAX(n) AS n, COUNT(*) FILTER (WHERE p) AS positives,
            CAST(CEIL(0.2 * MAX(n)) AS BIGINT) AS targeted,
            COUNT(*) FILTER (WHERE p AND rn <= CEIL(0.2 * n)) AS positives_targeted FROM r)""",
)
def target_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    # coarse scores, so that many rows tie at the cut-off
    orders = load(spark, sf_dir, "orders").withColumn("score", F.floor(F.col("o_totalprice") / 20000))
    table = W.target_top_share(orders, "score", F.col("o_orderstatus") == "F", "o_orderkey")
    return rounded(table, 8, "rate_before", "rate_after", "rate_reduction")


LEAK_FEATURES = ["is_returned", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "line_id"]
LEAK_CTE = """leaky AS (
  SELECT l_quantity, l_extendedprice, l_discount, l_tax,
    CAST(l_returnflag = 'R' AS DOUBLE) AS is_returned, l_orderkey * 1000000 + rn AS line_id,
    CAST(l_returnflag = 'R' AS DOUBLE) AS y
  FROM (SELECT *, l_linenumber * 100000 + l_partkey AS rn FROM lineitem))"""


@query(
    "w16_leakage_screen",
    f"WITH {LEAK_CTE} SELECT feature, {rnd('a', 8)} AS association, \"distinct\", a >= 0.9 AS is_leak, "
    "\"distinct\" = n AS is_id_like FROM ("
    + " UNION ALL ".join(
        f"SELECT {text(c)} AS feature, ABS(CORR({c}, y)) AS a, COUNT(DISTINCT {c}) AS \"distinct\", "
        "COUNT(*) AS n FROM leaky"
        for c in LEAK_FEATURES
    )
    + ")",
)
def leakage_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lineitem(spark, sf_dir).withColumns(
        {
            "is_returned": returned().cast("double"),
            "line_id": F.col("l_orderkey") * 1000000
            + F.col("l_linenumber").cast("long") * 100000
            + F.col("l_partkey"),
        }
    )
    return rounded(W.leakage_screen(lines, returned(), LEAK_FEATURES), 8, "association")


@query(
    "w18_response_curve",
    f"""WITH u AS (
      SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS contacts,
        BOOL_OR(event_type = 'purchase') AS bought FROM events GROUP BY 1, 2),
    c AS (SELECT contacts, COUNT(*) AS n, AVG(CAST(bought AS DOUBLE)) AS rate FROM u GROUP BY 1),
    m AS (SELECT *, rate - LAG(rate) OVER (ORDER BY contacts) AS marginal FROM c)
    SELECT contacts, n, {rnd('rate', 8)} AS rate, {rnd('marginal', 8)} AS marginal,
      (SELECT MIN(contacts) FROM m WHERE marginal <= 0) AS first_without_gain FROM m""",
)
def response_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = (
        load(spark, sf_dir, "events")
        .groupBy("user_id", F.col("ts").cast("date").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("contacts"),
            F.bool_or(F.col("event_type") == "purchase").alias("bought"),
        )
    )
    return rounded(W.response_curve(units, "contacts", F.col("bought")), 8, "rate", "marginal")


@query(
    "w19_segment_uplift",
    f"""WITH s AS (
      SELECT l_linestatus, l_linenumber, COUNT(*) AS n,
        CAST(SUM(CAST(l_returnflag = 'R' AS INTEGER)) AS BIGINT) AS positives
      FROM lineitem GROUP BY 1, 2)
    SELECT *, {rnd('positives / n::DOUBLE', 8)} AS rate, {rnd('positives / n::DOUBLE / o', 8)} AS uplift,
      RANK() OVER (ORDER BY ROUND(positives / n::DOUBLE / o, 9) DESC) AS uplift_rank
    FROM (SELECT s.* FROM s) t, (SELECT SUM(positives) / SUM(n)::DOUBLE AS o FROM s) w
    WHERE n >= 50""".replace("SELECT *, ", "SELECT l_linestatus, l_linenumber, n, positives, "),
)
def segment_uplift(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = ["l_linestatus", "l_linenumber"]
    return rounded(
        W.segment_uplift(lineitem(spark, sf_dir), segments, returned(), 50), 8, "rate", "uplift"
    )


@query(
    "w20_local_contributions",
    f"""WITH m AS (SELECT AVG(l_quantity) AS q, AVG(l_discount) AS d FROM lineitem)
    SELECT l_orderkey, l_linenumber, {rnd('0.5 * (l_quantity - q)', 6)} AS contrib_l_quantity,
      {rnd('-20.0 * (l_discount - d)', 6)} AS contrib_l_discount,
      {rnd('0.5 * (l_quantity - q) - 20.0 * (l_discount - d)', 6)} AS contrib_total
    FROM lineitem, m""",
)
def local_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = M.local_contributions(lineitem(spark, sf_dir), {"l_quantity": 0.5, "l_discount": -20.0})
    columns = ["contrib_l_quantity", "contrib_l_discount", "contrib_total"]
    return rounded(made.select("l_orderkey", "l_linenumber", *columns), 6, *columns)


@query(
    "w20_global_contributions",
    f"""WITH m AS (SELECT AVG(l_quantity) AS q, AVG(l_discount) AS d FROM lineitem)
    SELECT 'l_quantity' AS feature, {rnd('AVG(ABS(0.5 * (l_quantity - q)))', 6)} AS mean_abs_contribution
    FROM lineitem, m UNION ALL
    SELECT 'l_discount', {rnd('AVG(ABS(20.0 * (l_discount - d)))', 6)} FROM lineitem, m""",
)
def global_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = M.local_contributions(lineitem(spark, sf_dir), {"l_quantity": 0.5, "l_discount": -20.0})
    table = M.global_contributions(made, ["l_quantity", "l_discount"])
    return rounded(table, 6, "mean_abs_contribution")


@query(
    "w21_residual_anomaly",
    f"""WITH r AS (SELECT p_partkey, p_retailprice - AVG(p_retailprice) OVER (PARTITION BY p_brand) AS residual
      FROM part), s AS (SELECT STDDEV_SAMP(residual) AS s FROM r)
    SELECT p_partkey, {rnd('residual', 6)} AS residual, {rnd('residual / s', 6)} AS z,
      residual / s > 1.5 AS is_anomaly FROM r, s""",
)
def residual_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part")
    # a low limit, because these prices hold no anomaly above 3
    flagged = W.residual_anomaly(parts, "p_retailprice", "p_brand", limit=1.5)
    return rounded(flagged.select("p_partkey", "residual", "z", "is_anomaly"), 6, "residual", "z")


# --- fairness, bias, policy -------------------------------------------------
def _fairness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.fairness_report(
        lineitem(spark, sf_dir), "l_linenumber", returned(), F.col("l_discount") >= 0.05
    )


_FAIR_CTE = """fair AS (
  SELECT l_linenumber, COUNT(*) AS n, AVG(CAST(p AS DOUBLE)) AS selection_rate,
    COUNT(*) FILTER (WHERE p AND y) / NULLIF(COUNT(*) FILTER (WHERE y), 0)::DOUBLE AS tpr,
    COUNT(*) FILTER (WHERE p AND NOT y) / NULLIF(COUNT(*) FILTER (WHERE NOT y), 0)::DOUBLE AS fpr,
    COUNT(*) FILTER (WHERE p AND y) / NULLIF(COUNT(*) FILTER (WHERE p), 0)::DOUBLE AS precision
  FROM (SELECT l_linenumber, l_discount >= 0.05 AS p, l_returnflag = 'R' AS y FROM lineitem)
  GROUP BY l_linenumber)"""


@query(
    "w23_fairness_report",
    f"WITH {_FAIR_CTE} SELECT l_linenumber, n, "
    + ", ".join(f"{rnd(c, 8)} AS {c}" for c in ("selection_rate", "tpr", "fpr", "precision"))
    + " FROM fair",
)
def fairness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_fairness(spark, sf_dir), 8, "selection_rate", "tpr", "fpr", "precision")


@query(
    "w23_fairness_gaps",
    f"""WITH {_FAIR_CTE} SELECT {rnd('MAX(selection_rate) - MIN(selection_rate)', 8)} AS parity_difference,
      {rnd('MIN(selection_rate) / MAX(selection_rate)', 8)} AS disparate_impact,
      {rnd('MAX(tpr) - MIN(tpr)', 8)} AS equal_opportunity_gap,
      {rnd('MAX(fpr) - MIN(fpr)', 8)} AS fpr_gap FROM fair""",
)
def fairness_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = W.fairness_gaps(_fairness(spark, sf_dir))
    return rounded(table, 8, *table.columns)


@query(
    "w24_bias_sources",
    f"""WITH {MESSY}, g AS (
      SELECT c_nationkey, COUNT(*) AS n, COUNT(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS p,
        COUNT(*) - COUNT(c_acctbal) AS m FROM clean GROUP BY 1),
    w AS (SELECT SUM(n)::DOUBLE AS wn, SUM(p)::DOUBLE AS wp, SUM(m)::DOUBLE AS wm, COUNT(*)::DOUBLE AS k FROM g)
    SELECT c_nationkey, n, {rnd('n / wn', 8)} AS representation,
      {rnd('n / wn - 1 / k', 8)} AS representation_gap, {rnd('p / n::DOUBLE', 8)} AS label_rate,
      {rnd('p / n::DOUBLE - wp / wn', 8)} AS label_gap, {rnd('m / n::DOUBLE', 8)} AS null_rate,
      {rnd('m / n::DOUBLE - wm / wn', 8)} AS null_gap FROM g, w""",
)
def bias_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.coalesce(F.col("c_mktsegment") == "BUILDING", F.lit(False))
    table = W.bias_sources(clean_customers(spark, sf_dir), "c_nationkey", label, "c_acctbal")
    return rounded(table, 8, *[c for c in table.columns if c not in ("c_nationkey", "n")])


@query(
    "w25_threshold_policy",
    f"""WITH e AS (SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders),
    b AS (SELECT CAST(LEAST(49, FLOOR((o_totalprice - lo) * 50 / (hi - lo))) AS INTEGER) AS bin,
        COUNT(*) AS n, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS d FROM orders, e GROUP BY 1),
    s AS (SELECT bin, CAST(SUM(n) OVER o AS BIGINT) AS approved, SUM(n) OVER o / (SUM(n) OVER ())::DOUBLE AS a,
        SUM(d) OVER o / (SUM(n) OVER o)::DOUBLE AS f FROM b WINDOW o AS (ORDER BY bin))
    SELECT bin, approved, {rnd('a', 8)} AS approval_rate, {rnd('f', 8)} AS default_rate,
      COALESCE(bin = (SELECT MAX(bin) FROM s WHERE f <= 0.3333), FALSE) AS is_best FROM s""",
)
def threshold_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    default = F.col("o_orderstatus") == "F"
    table = W.threshold_policy(orders, "o_totalprice", default, bins=50, cap=0.3333)
    return rounded(table, 8, "approval_rate", "default_rate")


CATEGORICAL = ["l_linestatus", "l_linenumber"]


def _cramers(column: str) -> str:
    return f"""SELECT {text(column)} AS feature, 'cramers_v' AS kind, SQRT(SUM(
        (n1 - n * p) ** 2 / (n * p) + (n0 - n * (1 - p)) ** 2 / (n * (1 - p))) / MAX(t)) AS a
      FROM (SELECT {column}, COUNT(*)::DOUBLE AS n, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS n1,
              COUNT(*) FILTER (WHERE l_returnflag <> 'R') AS n0 FROM lineitem GROUP BY 1),
           (SELECT COUNT(*)::DOUBLE AS t, AVG(CAST(l_returnflag = 'R' AS DOUBLE)) AS p FROM lineitem)"""


@query(
    "w26_association_rank",
    f"SELECT feature, kind, {rnd('a', 8)} AS association FROM ("
    + " UNION ALL ".join(
        f"SELECT {text(c)} AS feature, 'point_biserial' AS kind, "
        f"ABS(CORR({c}, CAST(l_returnflag = 'R' AS DOUBLE))) AS a FROM lineitem"
        for c in FEATURES
    )
    + " UNION ALL "
    + " UNION ALL ".join(_cramers(c) for c in CATEGORICAL)
    + ")",
)
def association_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = W.association_rank(lineitem(spark, sf_dir), returned(), FEATURES, CATEGORICAL)
    return rounded(table, 8, "association")


QUALITY_COLUMNS = ["c_nationkey", "c_acctbal", "c_mktsegment"]


def _quality_sql() -> str:
    def part(c: str) -> str:
        if c == "c_mktsegment":
            outliers = "CAST(NULL AS DOUBLE)"
        else:
            outliers = f"""(SELECT {rnd(f'''AVG(CAST({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)
              AS DOUBLE))''', 6)} FROM clean, (SELECT QUANTILE_CONT({c}, 0.25) AS q1,
              QUANTILE_CONT({c}, 0.75) AS q3 FROM clean) WHERE {c} IS NOT NULL)"""
        return f"""SELECT {text(c)} AS "column", COUNT(*) AS n, COUNT(*) - COUNT({c}) AS nulls,
          {rnd(f'(COUNT(*) - COUNT({c})) / COUNT(*)::DOUBLE', 6)} AS null_rate,
          COUNT(DISTINCT {c}) AS "distinct", COUNT(DISTINCT {c}) <= 1 AS is_constant,
          {outliers} AS outlier_rate,
          (SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT {', '.join(QUALITY_COLUMNS)}
            FROM clean)) FROM clean) AS duplicate_rows FROM clean"""

    return f"WITH {MESSY} " + " UNION ALL ".join(part(c) for c in QUALITY_COLUMNS)


@query("w27_quality_report", _quality_sql())
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.quality_report(clean_customers(spark, sf_dir).select(*QUALITY_COLUMNS))
