"""Dataset profiling: shape, nulls, distributions, correlations, quality."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscore.functions.rounding import stable_round
from runscore.operators.ordered import attach, exact_percentiles

CLASS_LIMIT = 20


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _tall(row: DataFrame, columns: list[str], parts: list[str]) -> DataFrame:
    """One wide aggregate row with columns ``<part>__<column>`` to one row per column."""
    entries = [
        F.struct(
            F.lit(c).alias("column"), *[F.col(f"{p}__{c}").alias(p) for p in parts]
        )
        for c in columns
    ]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def null_counts(df: DataFrame) -> DataFrame:
    """column, n, nulls; one pass over the data."""
    columns = df.columns
    row = df.agg(
        *[F.count(F.lit(1)).alias(f"n__{c}") for c in columns],
        *[F.count_if(F.col(c).isNull()).alias(f"nulls__{c}") for c in columns],
    )
    return _tall(row, columns, ["n", "nulls"])


def profile(df: DataFrame) -> DataFrame:
    """Position, name, type, row count and null count of every column."""
    types = F.create_map(
        *[F.lit(v) for name, dtype in df.dtypes for v in (name, dtype)]
    )
    places = F.create_map(*[F.lit(v) for i, name in enumerate(df.columns) for v in (name, i)])
    return null_counts(df).select(
        places[F.col("column")].alias("position"),
        "column",
        types[F.col("column")].alias("dtype"),
        "n",
        "nulls",
    )


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value of every cell; NaN is a missing value."""
    tall = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "column", "value"
    )
    return tall.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def describe_numeric(
    df: DataFrame, columns: list[str] | None = None, approximate: bool = False
) -> DataFrame:
    """count, mean, sample sd, min, quartiles and max per numeric column; NaN is missing."""
    columns = columns or numeric_columns(df)
    tall = _values(df, columns)
    quartiles = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    basics = [
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ]
    if approximate:
        marks = [
            F.percentile_approx("value", fraction).alias(name)
            for name, fraction in quartiles.items()
        ]
        return tall.groupBy("column").agg(*basics, *marks)
    moments = tall.groupBy("column").agg(*basics)
    marks = exact_percentiles(tall, "value", quartiles, ["column"], few=True).drop("total")
    return attach(moments, marks, ["column"], "left", few=True)


def sample_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First ``n`` rows of a stated order."""
    return df.orderBy(*order).limit(n)


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Zero-based bin; the maximum falls in the last bin."""
    return F.least(
        F.lit(bins - 1),
        F.floor(F.coalesce(F.try_divide((value - low) * bins, high - low), F.lit(0.0))),
    ).cast("int")


def histogram(df: DataFrame, column: str | None = None, bins: int = 20) -> DataFrame:
    """Counts per equal-width bin of a numeric column, nulls dropped."""
    column = column or numeric_columns(df)[0]
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    low, high = values.agg(F.min("v")).scalar(), values.agg(F.max("v")).scalar()
    return (
        values.select(equal_width_bin(F.col("v"), low, high, bins).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of all column pairs from one aggregate pass."""
    columns = columns or numeric_columns(df)
    if len(columns) < 2:
        raise ValueError("a correlation needs at least two numeric columns")
    pairs = list(combinations(columns, 2))
    row = df.agg(
        *[
            F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    entries = []
    for i, (a, b) in enumerate(pairs):
        for left, right in ((a, b), (b, a)):
            entries.append(
                F.struct(
                    F.lit(left).alias("x"), F.lit(right).alias("y"), F.col(f"r{i}").alias("r")
                )
            )
    entries += [
        F.struct(F.lit(c).alias("x"), F.lit(c).alias("y"), F.lit(1.0).alias("r"))
        for c in columns
    ]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def pair_sample(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """First four numeric columns, complete rows only."""
    columns = columns or numeric_columns(df)[:4]
    return df.select(*columns).na.drop("any")


def pair_bins(df: DataFrame, columns: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Two-dimensional bin counts for each pair of the sampled columns.

    The drawing of a pair plot needs no rows, only these counts.
    """
    rows = pair_sample(df, columns)
    columns = rows.columns
    numbers = {c: F.col(c).cast("double") for c in columns}
    edges = rows.agg(
        *[F.min(v).alias(f"low_{c}") for c, v in numbers.items()],
        *[F.max(v).alias(f"high_{c}") for c, v in numbers.items()],
        F.lit(0).alias("__one"),
    )
    bounded = attach(rows.withColumn("__one", F.lit(0)), edges, ["__one"], few=True)
    binned = bounded.select(
        *[equal_width_bin(v, F.col(f"low_{c}"), F.col(f"high_{c}"), bins).alias(c) for c, v in numbers.items()]
    )
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("x"), F.lit(b).alias("y"),
                    F.col(a).alias("x_bin"), F.col(b).alias("y_bin"),
                )
                for a, b in combinations(columns, 2)
            ]
        )
    )
    return (
        binned.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("c"))
        .select(cells.alias("e"), "c")
        .groupBy("e.x", "e.y", "e.x_bin", "e.y_bin")
        .agg(F.sum("c").alias("n"))
    )


def infer_task_type(df: DataFrame, target: str, limit: int = CLASS_LIMIT) -> DataFrame:
    """classification for text targets or few distinct values, else regression."""
    is_text = isinstance(df.schema[target].dataType, (T.StringType, T.BooleanType))
    distinct = F.count_distinct(target)
    kind = F.when(F.lit(is_text) | (distinct <= limit), "classification").otherwise("regression")
    return df.agg(distinct.alias("distinct_values"), kind.alias("task_type"))


def row_fingerprint(columns: list[str]) -> list[Column]:
    """Two independent 64-bit hashes of a row that tell nulls from values."""
    values = [F.col(c) for c in columns]
    nulls = [F.col(c).isNull() for c in columns]
    return [
        F.xxhash64(*values, *nulls).alias("h1"),
        F.xxhash64(F.lit("second"), *reversed(values), *nulls).alias("h2"),
    ]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: total rows and rows that repeat an earlier one.

    Groups on a 128-bit fingerprint, so 16 bytes per row are shuffled instead
    of the row; many copies of one row collapse before the shuffle.
    """
    copies = (
        df.select(*row_fingerprint(df.columns))
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    )


def distinct_counts(
    df: DataFrame, columns: list[str] | None = None, approximate: bool = False
) -> DataFrame:
    """column, distinct; exact by default.

    The exact form hashes (column, value) pairs to 128 bits and counts each
    once, so long values are not shuffled.
    """
    columns = columns or df.columns
    if approximate:
        row = df.agg(*[F.approx_count_distinct(c).alias(f"distinct__{c}") for c in columns])
        return _tall(row, columns, ["distinct"])
    cells = F.explode(
        F.array(
            *[
                F.when(
                    F.col(c).isNotNull(),
                    F.struct(
                        F.lit(c).alias("column"),
                        F.xxhash64(F.col(c)).alias("h1"),
                        F.xxhash64(F.lit("second"), F.col(c)).alias("h2"),
                    ),
                )
                for c in columns
            ]
        )
    )
    seen = df.select(cells.alias("e")).where(F.col("e").isNotNull()).select("e.*").distinct()
    names = F.explode(F.array(*[F.lit(c) for c in columns])).alias("column")
    one_row = df.agg(F.count(F.lit(1)).alias("n")).select(names)
    counts = seen.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    return one_row.join(counts, "column", "left").na.fill(0, ["distinct"])


def outlier_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Share of non-null values outside 1.5 quartile ranges, per numeric column."""
    columns = columns or numeric_columns(df)
    tall = _values(df, columns).where(F.col("value").isNotNull())
    marks = exact_percentiles(tall, "value", {"q1": 0.25, "q3": 0.75}, ["column"], few=True)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    outside = ~F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        attach(tall, marks.drop("total"), ["column"], few=True)
        .groupBy("column")
        .agg(F.avg(outside.cast("double")).alias("outlier_rate"))
    )


def quality_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null rate, distinct count, constancy, outlier rate and duplicate rows per column."""
    columns = columns or df.columns
    chosen = df.select(*columns)
    numeric = numeric_columns(chosen)
    report = null_counts(chosen).join(distinct_counts(chosen), "column")
    if numeric:
        report = report.join(outlier_rates(chosen, numeric), "column", "left")
    else:
        report = report.withColumn("outlier_rate", F.lit(None).cast("double"))
    return report.select(
        "column",
        "n",
        "nulls",
        stable_round(F.coalesce(F.try_divide("nulls", "n"), F.lit(0.0)), 6).alias("null_rate"),
        "distinct",
        (F.col("distinct") <= 1).alias("is_constant"),
        stable_round(F.col("outlier_rate"), 6).alias("outlier_rate"),
        duplicate_rows(df).select("duplicates").scalar().alias("duplicate_rows"),
    )


__all__ = [
    "correlation_matrix", "describe_numeric", "distinct_counts", "duplicate_rows", "histogram",
    "infer_task_type", "null_counts", "numeric_columns", "outlier_rates", "pair_bins",
    "pair_sample", "profile", "quality_report", "row_fingerprint", "sample_rows",
]
