"""Analyses over labelled tables: rates, segments, fairness, thresholds, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runscore.operators.ordered import (
    attach,
    medians,
    order_statistics,
    running_totals,
    spread_key,
    with_ranges,
)
from runscore.operators.profile import distinct_counts


def _rate(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def rate_by(df: DataFrame, groups: list[str], target: Column) -> DataFrame:
    """Positive share and n per group, with subtotal and overall rows.

    ``level`` counts the grouping columns that are totalled in a row.
    """
    level = F.lit(0)
    for name in groups:
        level = level + F.grouping(name).cast("int")
    return df.rollup(*groups).agg(
        F.count(F.lit(1)).alias("n"), _rate(target).alias("rate"), level.alias("level")
    )


def mean_by(df: DataFrame, groups: list[str], column: str) -> DataFrame:
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean")
    )


def top_groups_median(df: DataFrame, group: str, column: str, k: int = 5) -> DataFrame:
    """The k largest groups with the median of a column."""
    largest = (
        df.groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), group)
        .limit(k)
    )
    rows = df.join(largest.select(group), group, "left_semi")
    return attach(largest, medians(rows, column, [group], few=True), [group], "left", few=True)


def crosstab_counts(df: DataFrame, row: str, column: str, values: list[object]) -> DataFrame:
    """Counts per row category, one column per listed class."""
    return df.groupBy(row).agg(
        *[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values]
    )


def correlations_with(df: DataFrame, target: Column, features: list[str]) -> DataFrame:
    """feature, r; one aggregate for all features."""
    y = target.cast("double")
    row = df.agg(*[F.corr(F.col(c).cast("double"), y).alias(c) for c in features])
    return row.unpivot([], features, "feature", "r")


def top_correlated(df: DataFrame, target: Column, features: list[str], k: int = 5) -> DataFrame:
    """The k features with the largest absolute correlation with the target."""
    found = correlations_with(df, target, features)
    return found.orderBy(F.abs("r").desc_nulls_last(), "feature").limit(k)


def target_top_share(
    df: DataFrame,
    score: str,
    positive: Column,
    key: str,
    share: float = 0.2,
    success: float = 0.5,
) -> DataFrame:
    """Effect of treating the top share by score when a treatment works at a rate.

    The cut-off score is an order statistic. Rows tied at the cut-off are taken
    in the order of their spread key, by a second order statistic over the tied
    rows, so no sort of the table is needed.
    """
    rows = df.select(
        F.col(score).cast("double").alias("s"),
        positive.cast("int").alias("p"),
        spread_key(F.col(key)).alias("h"),
    ).where(F.col("s").isNotNull())
    size = F.ceil(F.col("total") * F.lit(float(share)))
    cut = order_statistics(rows, "s", {"cut": F.col("total") - size}).select("cut")

    def with_one(rows: DataFrame, row: DataFrame) -> DataFrame:
        """Columns of a table of one row, as attributes that every expression can share."""
        one = F.lit(0).alias("__one")
        return attach(rows.select("*", one), row.select("*", one), ["__one"], few=True).drop("__one")

    marked = with_one(rows, cut)
    above = F.col("s") > F.col("cut")
    sums = marked.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("p").alias("positives"),
        F.count_if(above).alias("n_above"),
        F.coalesce(F.sum(F.when(above, F.col("p"))), F.lit(0)).alias("p_above"),
        F.ceil(F.count(F.lit(1)) * F.lit(float(share))).alias("targeted"),
    )
    room = sums.select((F.col("targeted") - F.col("n_above")).alias("room"))
    tied = with_one(marked.where(F.col("s") == F.col("cut")), room)
    last = order_statistics(tied, "h", {"last": F.col("room") - 1}, ["room"], few=True).select("last")
    taken = with_one(tied, last).where(F.col("h") <= F.col("last")).agg(F.coalesce(F.sum("p"), F.lit(0)))

    reached = F.col("p_above") + taken.scalar()
    prevented = reached * F.lit(float(success))
    return sums.select(
        "n",
        "positives",
        "targeted",
        reached.alias("positives_targeted"),
        prevented.alias("expected_prevented"),
        (F.col("positives") / F.col("n")).alias("rate_before"),
        ((F.col("positives") - prevented) / F.col("n")).alias("rate_after"),
        (prevented / F.col("n")).alias("rate_reduction"),
    )


def leakage_screen(
    df: DataFrame,
    target: Column,
    features: list[str],
    threshold: float = 0.9,
    approximate: bool = False,
) -> DataFrame:
    """Per feature: association with the target, distinct count, leak and id flags."""
    found = correlations_with(df, target, features)
    distinct = distinct_counts(df.select(*features), features, approximate)
    n = df.agg(F.count(F.lit(1))).scalar()
    return (
        found.join(distinct.withColumnRenamed("column", "feature"), "feature")
        .select(
            "feature",
            F.abs("r").alias("association"),
            "distinct",
            F.coalesce(F.abs("r") >= threshold, F.lit(False)).alias("is_leak"),
            (F.col("distinct") == n).alias("is_id_like"),
        )
    )


def response_curve(df: DataFrame, contacts: str, outcome: Column) -> DataFrame:
    """Rate and marginal change per contact count, and where gains first stop.

    The curve is cut into ranges of contact counts; the first point of a range
    takes the rate before it from the last point of the range before.
    """
    curve = df.groupBy(contacts).agg(F.count(F.lit(1)).alias("n"), _rate(outcome).alias("rate"))
    cut = with_ranges(curve, contacts, "__range")
    borders = cut.where(F.col(contacts).isNotNull()).groupBy("__range").agg(
        F.max_by("rate", contacts).alias("last")
    )
    # at most one row per range
    carried = borders.select("__range", F.lag("last").over(Window.orderBy("__range")).alias("carried"))
    inside = Window.partitionBy("__range").orderBy(contacts)
    before = F.coalesce(F.lag("rate").over(inside), F.col("carried"))
    gains = (
        attach(cut, carried, ["__range"], "left", few=True)
        .withColumn("marginal", F.col("rate") - before)
        .select(contacts, "n", "rate", "marginal")
    )
    stop = gains.agg(F.min(F.when(F.col("marginal") <= 0, F.col(contacts)))).scalar()
    return gains.withColumn("first_without_gain", stop)


def segment_uplift(
    df: DataFrame, segments: list[str], target: Column, min_support: int = 1
) -> DataFrame:
    """Segment rate over overall rate, ranked, for segments of enough rows."""
    counted = df.groupBy(*segments).agg(
        F.count(F.lit(1)).alias("n"), F.sum(target.cast("long")).alias("positives")
    )
    whole = counted.agg(F.sum("positives") / F.sum("n")).scalar()
    rated = (
        counted.where(F.col("n") >= min_support)
        .withColumn("rate", F.col("positives") / F.col("n"))
        .withColumn("uplift", F.try_divide(F.col("rate"), whole))
        .withColumn("falling", F.round(-F.col("uplift"), 9))
    )
    ties = rated.groupBy("falling").agg(F.count(F.lit(1)).alias("k"))
    ranks = running_totals(ties, "falling", ["k"]).select("falling", "k_before")
    return (
        attach(rated, ranks, ["falling"], "left")
        .withColumn("uplift_rank", F.col("k_before") + 1)
        .select(*segments, "n", "positives", "rate", "uplift", "uplift_rank")
    )


def residual_anomaly(df: DataFrame, value: str, group: str, limit: float = 3.0) -> DataFrame:
    """Actual minus group mean, its z-score and a flag above the limit.

    Group means are joined back instead of windowed, so a hot group is not
    gathered in one task.
    """
    means = df.groupBy(group).agg(F.avg(value).alias("expected"))
    rows = attach(df, means, [group]).withColumn("residual", F.col(value) - F.col("expected"))
    return score_residuals(rows, limit)


def score_residuals(rows: DataFrame, limit: float = 3.0) -> DataFrame:
    """Add z-score and flag to rows that have a ``residual``."""
    spread = rows.agg(F.stddev_samp("residual")).scalar()
    z = F.coalesce(F.try_divide(F.col("residual"), spread), F.lit(0.0))
    return rows.withColumn("z", z).withColumn("is_anomaly", F.col("z") > limit)


def fairness_report(
    df: DataFrame, group: str, label: Column, prediction: Column
) -> DataFrame:
    """Selection rate, TPR, FPR and precision per group."""

    def share(part: Column, whole: Column) -> Column:
        return F.try_divide(F.count_if(part & whole), F.count_if(whole))

    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        _rate(prediction).alias("selection_rate"),
        share(prediction, label).alias("tpr"),
        share(prediction, ~label).alias("fpr"),
        share(label, prediction).alias("precision"),
    )


def fairness_gaps(report: DataFrame) -> DataFrame:
    """Parity difference, disparate impact ratio and equal-opportunity gap."""
    selection, tpr = F.col("selection_rate"), F.col("tpr")
    return report.agg(
        (F.max(selection) - F.min(selection)).alias("parity_difference"),
        F.try_divide(F.min(selection), F.max(selection)).alias("disparate_impact"),
        (F.max(tpr) - F.min(tpr)).alias("equal_opportunity_gap"),
        (F.max("fpr") - F.min("fpr")).alias("fpr_gap"),
    )


def bias_sources(df: DataFrame, group: str, label: Column, checked: str) -> DataFrame:
    """Representation, label rate and null rate per group with gaps to overall."""
    counted = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(label).alias("positives"),
        F.count_if(F.col(checked).isNull()).alias("nulls"),
    )
    whole = counted.agg(
        F.struct(
            F.sum("n").alias("n"), F.sum("positives").alias("p"), F.sum("nulls").alias("m"),
            F.count(F.lit(1)).alias("groups"),
        )
    ).scalar()
    share, rate, nulls = F.col("n") / whole["n"], F.col("positives") / F.col("n"), (
        F.col("nulls") / F.col("n")
    )
    return counted.select(
        group,
        "n",
        share.alias("representation"),
        (share - 1.0 / whole["groups"]).alias("representation_gap"),
        rate.alias("label_rate"),
        (rate - whole["p"] / whole["n"]).alias("label_gap"),
        nulls.alias("null_rate"),
        (nulls - whole["m"] / whole["n"]).alias("null_gap"),
    )


def threshold_policy(
    df: DataFrame, score: str, default: Column, bins: int = 100, cap: float = 0.1
) -> DataFrame:
    """Approval and default rate for each cut-off, best one under a default cap.

    Rows up to a cut-off are approved. Rows are counted per score bin, so the
    running sums go over at most ``bins`` rows.
    """
    rows = df.select(F.col(score).cast("double").alias("s"), default.alias("d")).where(
        F.col("s").isNotNull()
    )
    low, high = rows.agg(F.min("s")).scalar(), rows.agg(F.max("s")).scalar()
    position = F.floor(F.coalesce(F.try_divide((F.col("s") - low) * bins, high - low), F.lit(0.0)))
    binned = (
        rows.withColumn("bin", F.least(F.lit(bins - 1), position).cast("int"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("d").alias("defaults"))
    )
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("n").over(Window.partitionBy())
    swept = binned.select(
        "bin",
        F.sum("n").over(upto).alias("approved"),
        (F.sum("n").over(upto) / whole).alias("approval_rate"),
        (F.sum("defaults").over(upto) / F.sum("n").over(upto)).alias("default_rate"),
    )
    allowed = F.max(F.when(F.col("default_rate") <= cap, F.col("bin"))).over(Window.partitionBy())
    return swept.withColumn("is_best", F.coalesce(F.col("bin") == allowed, F.lit(False)))


def cramers_v(df: DataFrame, target: Column, columns: list[str]) -> DataFrame:
    """Cramer's V of categorical columns with a binary target, from counts."""
    cells = (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns], target.cast("long").alias("y"))
        .unpivot(["y"], columns, "feature", "category")
        .groupBy("feature", "category")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"))
    )
    whole = df.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.sum(target.cast("long")).alias("n1"))
    ).scalar()
    share = whole["n1"] / whole["n"]
    # for two classes both cells of a category deviate by the same amount
    deviation = F.col("n1") - F.col("n") * share
    chi = F.sum(F.try_divide(deviation * deviation, F.col("n") * share * (1 - share)))
    levels = F.count(F.lit(1))
    return cells.groupBy("feature").agg(
        F.when(levels > 1, F.sqrt(F.try_divide(chi, F.first(whole["n"]))))
        .otherwise(F.lit(0.0))
        .alias("association")
    )


def association_rank(
    df: DataFrame, target: Column, numeric: list[str], categorical: list[str]
) -> DataFrame:
    """Absolute association of every feature with a binary target, strongest first."""
    numbers = correlations_with(df, target, numeric).select(
        "feature", F.lit("point_biserial").alias("kind"), F.abs("r").alias("association")
    )
    classes = cramers_v(df, target, categorical).select(
        "feature", F.lit("cramers_v").alias("kind"), "association"
    )
    return numbers.union(classes).orderBy(F.col("association").desc_nulls_last(), "feature")
