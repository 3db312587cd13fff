"""Paired tests per group over rows with ``baseline`` and ``feedback`` values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscore.functions.distributions import normal_two_sided, t_critical, t_pvalue
from runscore.operators.ordered import attach, running_totals

NAN = float("nan")
EXACT_PAIRS = 50  # up to so many differences the exact distribution is the default


def paired(pairs: DataFrame, by: list[str], digits: int | None = None) -> DataFrame:
    """Complete pairs with their difference ``d``.

    ``digits`` rounds the differences, which removes float noise that would
    break ties; without it they are taken as stored.
    """
    difference = F.col("feedback") - F.col("baseline")
    if digits is not None:
        difference = F.round(difference, digits)
    return (
        pairs.where(F.col("baseline").isNotNull() & F.col("feedback").isNotNull())
        .select(*by, "baseline", "feedback", difference.alias("d"))
    )


def difference_moments(pairs: DataFrame, by: list[str]) -> DataFrame:
    """n, mean difference, sample and population spread, mean of each side."""
    d = F.col("feedback") - F.col("baseline")
    complete = pairs.where(F.col("baseline").isNotNull() & F.col("feedback").isNotNull())
    return complete.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(d).alias("mean_diff"),
        F.stddev_samp(d).alias("sd_sample"),
        F.stddev_pop(d).alias("sd_pop"),
        F.avg("baseline").alias("mean_baseline"),
        F.avg("feedback").alias("mean_feedback"),
        F.max(F.abs(d)).alias("largest"),
    )


def t_statistic() -> Column:
    """t of the mean difference.

    Infinite when all differences are equal and not zero; NaN when they are all
    zero or there is only one.
    """
    scale = F.col("sd_sample") / F.sqrt(F.col("n"))
    endless = F.when(F.col("mean_diff") > 0, F.lit(float("inf"))).when(
        F.col("mean_diff") < 0, F.lit(float("-inf"))
    )
    return (
        F.when(F.col("sd_sample").isNull() | (F.col("n") < 2), F.lit(NAN))
        .when(F.col("sd_sample") == 0, F.coalesce(endless, F.lit(NAN)))
        .otherwise(F.try_divide(F.col("mean_diff"), scale))
    )


def paired_ttest(pairs: DataFrame, by: list[str]) -> DataFrame:
    return (
        difference_moments(pairs, by)
        .withColumn("t", t_statistic())
        .withColumn("t_p", t_pvalue(F.col("t"), (F.col("n") - 1).cast("double")))
        .select(*by, "n", "t", "t_p")
    )


def mean_diff_ci(pairs: DataFrame, by: list[str], confidence: float = 0.95) -> DataFrame:
    """t interval of the mean difference, scaled by the population spread."""
    return _with_interval(difference_moments(pairs, by), confidence).select(
        *by, "n", "mean_diff", "ci_low", "ci_high"
    )


def _with_interval(moments: DataFrame, confidence: float) -> DataFrame:
    half = (
        t_critical(F.lit(confidence), (F.col("n") - 1).cast("double"))
        * F.col("sd_pop")
        / F.sqrt(F.col("n"))
    )
    half = F.when(F.col("sd_pop") == 0, F.lit(NAN)).otherwise(half)
    return moments.withColumns(
        {"ci_low": F.col("mean_diff") - half, "ci_high": F.col("mean_diff") + half}
    )


def effect_size() -> Column:
    scale = F.when(F.col("sd_pop") == 0, F.lit(1.0)).otherwise(F.col("sd_pop"))
    return (F.col("mean_feedback") - F.col("mean_baseline")) / scale


def cohen_d(pairs: DataFrame, by: list[str]) -> DataFrame:
    return difference_moments(pairs, by).select(*by, effect_size().alias("cohen_d"))


def signed_rank_sums(
    pairs: DataFrame, by: list[str], digits: int | None = None
) -> DataFrame:
    """W+, W-, number of non-zero differences, largest tie and tie term per group.

    Differences are counted per distinct magnitude first, so a group ships one
    row per distinct value and the ranks come from running counts.
    """
    differences = paired(pairs, by, digits).where(F.col("d") != 0)
    counted = differences.groupBy(*by, F.abs("d").alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("up")
    )
    ranked = running_totals(counted, "size", ["n"], by)
    n, up = F.col("n").cast("double"), F.col("up").cast("double")
    mean_rank = F.col("n_before") + (n + 1.0) / 2.0
    return ranked.groupBy(*by).agg(
        F.max("n").alias("most_tied"),
        F.sum(up * mean_rank).alias("w_plus"),
        F.sum((n - up) * mean_rank).alias("w_minus"),
        F.sum("n").alias("nonzero"),
        F.sum(n * n * n - n).alias("tie_term"),
    )


def exact_signed_rank_p(w: Column, m: Column) -> Column:
    """Two-sided p of the smaller rank sum ``w`` of ``m`` untied differences.

    Under the null hypothesis every rank joins the sum with probability one
    half. Rank after rank the array of probabilities of the sums 0 .. w is
    mixed with itself shifted by the rank; sums above w need not be kept.
    """
    top = F.floor(w).cast("int")
    start = F.transform(F.sequence(F.lit(0), top), lambda s: F.when(s == 0, F.lit(1.0)).otherwise(F.lit(0.0)))

    def with_rank(sums: Column, rank: Column) -> Column:
        return F.transform(sums, lambda p, s: (p + F.coalesce(F.get(sums, s - rank), F.lit(0.0))) / 2.0)

    sums = F.aggregate(F.sequence(F.lit(1), m.cast("int")), start, with_rank)
    tail = F.aggregate(sums, F.lit(0.0), lambda total, p: total + p)
    return F.least(F.lit(1.0), 2.0 * tail)


def wilcoxon(
    pairs: DataFrame, by: list[str], digits: int | None = None, method: str = "auto"
) -> DataFrame:
    """Signed-rank statistic W, normal score and two-sided p per group.

    ``method``: "approx" takes p from the normal score; "exact" from the
    distribution of the rank sum in groups without ties and zero differences
    (others keep the normal one, as the distribution does not hold for them);
    "auto" does the same in groups of up to EXACT_PAIRS pairs. Exact p takes
    time with the cube of the group's size. Groups whose differences are all
    zero keep W = 0 with NaN for z and p.
    """
    if method not in ("auto", "exact", "approx"):
        raise ValueError(f"unknown method: {method}")
    groups = (
        pairs.where(F.col("baseline").isNotNull() & F.col("feedback").isNotNull())
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    sums = signed_rank_sums(pairs, by, digits)
    m = F.col("nonzero").cast("double")
    w = F.least("w_plus", "w_minus")
    variance = m * (m + 1) * (2 * m + 1) / 24.0 - F.col("tie_term") / 48.0
    score = F.try_divide(w - m * (m + 1) / 4.0, F.sqrt(variance))
    scored = (
        attach(groups, sums, by, "left")
        .withColumns(
            {
                "w": F.coalesce(w, F.lit(0.0)),
                "z": F.coalesce(score, F.lit(NAN)),
            }
        )
        .withColumn("w_p", normal_two_sided(F.col("z")))
    )
    if method != "approx":
        plain = (F.col("nonzero") == F.col("n")) & (F.col("most_tied") == 1)
        if method == "auto":
            plain = plain & (F.col("n") <= EXACT_PAIRS)
        exact = exact_signed_rank_p(F.col("w"), F.col("nonzero"))
        scored = scored.withColumn("w_p", F.when(plain, exact).otherwise(F.col("w_p")))
    return scored.select(*by, "n", "w", "z", "w_p")


def paired_stats(
    pairs: DataFrame,
    by: list[str] = ("metric",),
    *,
    confidence: float = 0.95,
    digits: int | None = None,
    method: str = "auto",
) -> DataFrame:
    """t test, signed-rank test, interval and effect size in one table."""
    by = list(by)
    moments = _with_interval(difference_moments(pairs, by), confidence)
    tested = (
        moments.withColumn("t", t_statistic())
        .withColumn("t_p", t_pvalue(F.col("t"), (F.col("n") - 1).cast("double")))
        .withColumn("cohen_d", effect_size())
    )
    ranks = wilcoxon(pairs, by, digits, method).drop("n")
    return attach(tested, ranks, by).select(
        *by, "n", "t", "t_p", "w", "z", "w_p", "ci_low", "ci_high", "mean_diff",
        F.col("sd_pop").alias("sd_diff"), "cohen_d",
    )
