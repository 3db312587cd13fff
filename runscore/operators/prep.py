"""Cleaning, imputation, derived features, clipping and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscore.functions.rounding import total as sum_of
from runscore.operators.ordered import (
    attach,
    exact_percentiles,
    medians,
    order_statistics,
    spread_key,
)

MISSING_MARKERS = ["?"]


def missing_markers(
    df: DataFrame,
    columns: list[str],
    markers: list[str] = MISSING_MARKERS,
    label_columns: list[str] = (),
) -> DataFrame:
    """Markers and blank text to null; trailing period off the label columns."""

    def clean(name: str) -> Column:
        text = F.col(name)
        blank = ~text.rlike(r"\S") | F.trim(text).isin(list(markers))
        return F.when(~blank, text)

    changed = {name: clean(name) for name in columns}
    for name in label_columns:
        changed[name] = F.regexp_replace(changed.get(name, F.col(name)), r"\.\s*$", "")
    return df.withColumns(changed)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing in every numeric column."""
    floats = [name for name, kind in df.dtypes if kind in ("double", "float")]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def modes(df: DataFrame, column: str, by: list[str] = (), name: str = "mode") -> DataFrame:
    """Most frequent non-null value per group, the smallest on ties."""
    by = list(by)
    counts = (
        df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    )
    first = F.struct((-F.col("n")).alias("n"), F.col(column))
    return counts.groupBy(*by).agg(F.min_by(column, first).alias(name))


def impute(
    df: DataFrame,
    column: str,
    strategy: str = "median",
    by: list[str] = (),
    value: object = None,
) -> DataFrame:
    """Fill nulls and NaN by group median, group mean, group mode or a constant."""
    by = list(by)
    if dict(df.dtypes)[column] in ("double", "float"):
        df = df.withColumn(column, F.when(~F.isnan(column), F.col(column)))
    if strategy == "constant":
        return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))
    if strategy == "median":
        fill = medians(df, column, by, "__fill")
    elif strategy == "mode":
        fill = modes(df, column, by, "__fill")
    elif strategy == "mean":
        fill = df.groupBy(*by).agg(F.avg(column).alias("__fill"))
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    if not by:
        return df.withColumn(column, F.coalesce(F.col(column), fill.select("__fill").scalar()))
    filled = attach(df, fill, by, "left")
    return filled.withColumn(column, F.coalesce(F.col(column), F.col("__fill"))).drop("__fill")


def null_change(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Null counts of the same columns before and after a step."""
    from runscore.operators.profile import null_counts

    left = null_counts(before.select(*columns)).select("column", F.col("nulls").alias("before"))
    right = null_counts(after.select(*columns)).select("column", F.col("nulls").alias("after"))
    return left.join(right, "column")


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null for a zero or missing divisor."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def floored_mean(columns: list[Column]) -> Column:
    """Mean of several columns with negative values taken as 0."""
    return sum_of([F.greatest(c, F.lit(0.0)) for c in columns]) / len(columns)


def ratio_features(
    df: DataFrame,
    ratios: dict[str, tuple[str, str]] | None = None,
    floored_means: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Add guarded ratios and non-negative means as new columns."""
    added = {n: safe_ratio(F.col(a), F.col(b)) for n, (a, b) in (ratios or {}).items()}
    for name, columns in (floored_means or {}).items():
        added[name] = floored_mean([F.col(c) for c in columns])
    return df.withColumns(added)


def iqr_bounds(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """One row: q1, q3 and the two clipping bounds."""
    marks = exact_percentiles(df, column, {"q1": 0.25, "q3": 0.75})
    reach = factor * (F.col("q3") - F.col("q1"))
    return marks.select(
        "q1", "q3", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high")
    )


def iqr_clip(
    df: DataFrame, column: str, fit_on: Column | None = None, factor: float = 1.5
) -> DataFrame:
    """Add ``<column>_clipped`` and ``is_outlier``; bounds come from ``fit_on`` rows only."""
    fitted = df if fit_on is None else df.where(fit_on)
    bounds = iqr_bounds(fitted, column, factor).select(F.struct("low", "high")).scalar()
    low, high = bounds["low"], bounds["high"]
    value = F.col(column)
    clipped = F.when(value.isNotNull(), F.least(high, F.greatest(low, value)))
    return df.withColumns(
        {f"{column}_clipped": clipped, "is_outlier": (value < low) | (value > high)}
    )


def stratified_split(
    df: DataFrame, label: str | None, key: str, train_share: float = 0.8, *, few: bool = False
) -> DataFrame:
    """Add ``is_train``: a fixed share of each class, chosen by a spread key.

    Finds the cut-off key per class from counts and compares each row with it,
    so the rows themselves are never sorted. Rows with the same key stay
    together. ``few`` says that there are few classes (``ordered.few_groups``):
    cut-offs are then broadcast, and rows are not shuffled by class either.
    """
    by = [label] if label else []
    keyed = df.withColumn("__spread", spread_key(F.col(key)))
    last = F.floor(F.col("total") * F.lit(float(train_share))) - 1
    cuts = order_statistics(keyed, "__spread", {"__cut": last}, by, few=few)
    if by:
        marked = attach(keyed, cuts.drop("total"), by, "left", few=few)
        is_train = F.coalesce(F.col("__spread") <= F.col("__cut"), F.lit(False))
    else:
        marked = keyed.withColumn("__cut", cuts.select("__cut").scalar())
        is_train = F.coalesce(F.col("__spread") <= F.col("__cut"), F.lit(False))
    return marked.withColumn("is_train", is_train).drop("__spread", "__cut")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k * n_class) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    weight = whole["n"] / (whole["k"] * F.col("n"))
    return counts.select(label, "n", weight.alias("weight"))


def with_class_weights(
    df: DataFrame, label: str, name: str = "weight", *, few: bool = False
) -> DataFrame:
    """Add the weight of each row's class; those of ``few`` classes are broadcast."""
    weights = class_weights(df, label).select(label, F.col("weight").alias(name))
    return attach(df, weights, [label], "left", few=few)
