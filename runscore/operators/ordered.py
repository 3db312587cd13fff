"""Order statistics and running totals without a single-task sort.

A plain window or exact ``percentile`` puts all rows of a group into one task.
Here rows are counted per distinct value first, so a hot value is one row. A
quantile sketch of the distinct values of each group (mergeable, built map-side)
gives splitters that cut the group into ranges of nearly equal size, whatever
the values look like. Range counts say which range holds a wanted position;
only its values are looked at again and sorted, range by range.
Splitters only balance the work: counts are exact, so results are too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_VALUES = 4096  # a group with fewer distinct values is not cut
MOST_RANGES = 256  # ranges of one cut; the largest holds about 0.7 % of the values
SKETCH_SIZE = 2048  # ranks are off by about 0.24 % of the values at most
FEW = 4096  # a table with no more rows may be broadcast


def attach(
    rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", *, few: bool = False
) -> DataFrame:
    """Join a table with one row per key to rows, matching null keys too.

    Spark chooses the join, broadcasts a table that turns out small and splits
    hot keys of ``rows`` at run time (adaptive execution). ``few`` says that the
    number of keys has a bound that does not grow with the data, such as the
    columns of a table or the k largest groups; the table is then broadcast.
    """
    if not keys:
        raise ValueError("attach needs at least one key")
    renamed = table.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        *[F.col(c) for c in table.columns if c not in keys],
    )
    if few:
        renamed = F.broadcast(renamed)
    match = reduce(
        lambda a, b: a & b, [rows[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    )
    return rows.join(renamed, match, how).drop(*[f"__{k}" for k in keys])


def few_groups(rows: DataFrame, by: list[str]) -> bool:
    """Whether a table with a row per group may be broadcast (action: counts groups up to FEW)."""
    return rows.select(*by).distinct().limit(FEW + 1).count() <= FEW


def _splitters(value: str) -> Column:
    """Aggregate: ascending values that cut the aggregated ones into equal parts, a power of two of them."""
    ranks = ",".join(str(i / MOST_RANGES) for i in range(1, MOST_RANGES))
    sketch = F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH_SIZE))
    marks = F.kll_sketch_get_quantile_double(sketch, F.split(F.lit(ranks), ",").cast("array<double>"))
    halvings = F.ceil(F.log2(F.count(F.lit(1)) / RANGE_VALUES)).cast("int")
    parts = F.least(F.lit(MOST_RANGES), F.pow(F.lit(2.0), F.greatest(halvings, F.lit(0))).cast("int"))
    apart = (F.lit(MOST_RANGES) / parts).cast("int")
    chosen = F.transform(F.sequence(apart, F.lit(MOST_RANGES) - apart, apart), lambda i: F.get(marks, i - 1))
    return F.when(parts > 1, chosen).otherwise(F.array().cast("array<double>"))


def _range_of(value: Column, splitters: Column) -> Column:
    """Number of splitters below the value, by binary search."""
    steps = [1 << i for i in reversed(range(MOST_RANGES.bit_length()))]

    def forward(at: Column, step: Column) -> Column:
        below = F.coalesce(F.get(splitters, at + step - 1) < value, F.lit(False))
        return F.when(below, at + step).otherwise(at)

    return F.aggregate(F.lit(steps), F.lit(0), forward)


def _inside(position: Column, start: Column, n: Column) -> Column:
    return (position >= start) & (position < start + n)


def one_group(df: DataFrame, by: list[str], few: bool) -> tuple[DataFrame, list[str], bool]:
    """The whole table as one group where no group columns are given."""
    return (df, list(by), few) if by else (df.withColumn("__all", F.lit(0)), ["__all"], True)


def with_ranges(counted: DataFrame, value: str, name: str) -> DataFrame:
    """Number the range of a table's distinct values that each value falls in; null values in none."""
    table, by, few = one_group(counted, [], True)
    cuts = table.groupBy(*by).agg(_splitters(value).alias("__cuts"))
    number = F.when(F.col(value).isNotNull(), _range_of(F.col(value).cast("double"), F.col("__cuts")))
    return attach(table, cuts, by, few=few).withColumn(name, number).drop("__cuts", "__all")


def order_statistics(
    df: DataFrame,
    value: str,
    positions: dict[str, Column],
    by: list[str] = (),
    *,
    few: bool = False,
) -> DataFrame:
    """Values at given positions of the ascending order, per group.

    ``positions`` maps an output name to a zero-based position, written as an
    expression over ``total`` (non-null count of the group) and the group
    columns. Nulls and NaN are left out. Output: the group columns, ``total``
    and one column per name, of the type of the value (null if the position is
    outside the group). ``few``: the number of groups does not grow with the
    data.
    """
    df, by, few = one_group(df, by, few)
    rows = df.select(*by, F.col(value).alias("v")).where(F.col("v").isNotNull())
    if dict(rows.dtypes)["v"] in ("double", "float"):
        rows = rows.where(~F.isnan("v"))
    counted = rows.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))
    as_double = F.col("v").cast("double")

    cuts = counted.groupBy(*by).agg(_splitters("v").alias("cuts"), F.sum("n").alias("total"))
    cut = attach(counted, cuts, by, few=few)
    # a sketch is random, so splitters must not be computed twice; an aggregate that
    # carried their arrays would sort every row with them, two bounds are plain numbers
    ranged = cut.withColumn("range", _range_of(as_double, F.col("cuts"))).select(
        *by, "n", "total", "range",
        F.get("cuts", F.col("range") - 1).alias("low"), F.get("cuts", "range").alias("high"),
    )
    counts = ranged.groupBy(*by, "range").agg(
        F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("total", "low", "high")]
    )
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    hit = [_inside(p, F.col("start"), F.col("n")) for p in positions.values()]
    span = F.struct("low", "high", "start")
    # one span per position at most
    wanted = (
        spans.where(reduce(lambda a, b: a | b, hit))
        .groupBy(*by)
        .agg(F.max("total").alias("total"), F.collect_list(span).alias("spans"))
    )

    def holds(s: Column) -> Column:
        above = F.coalesce(s["low"] < as_double, F.lit(True))
        return above & F.coalesce(as_double <= s["high"], F.lit(True))

    near = (
        attach(counted, wanted, by, few=few)
        .withColumn("start", F.get(F.filter("spans", holds), F.lit(0))["start"])
        .where(F.col("start").isNotNull())
        .drop("spans")
    )
    within = Window.partitionBy(*by, "start").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = near.withColumn("at", F.col("start") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    found = placed.groupBy(*by).agg(
        F.max("total").alias("total"),
        *[
            F.max(F.when(_inside(p, F.col("at"), F.col("n")), F.col("v"))).alias(name)
            for name, p in positions.items()
        ],
    )
    return found.drop("__all")


def exact_percentiles(
    df: DataFrame,
    value: str,
    fractions: dict[str, float],
    by: list[str] = (),
    *,
    few: bool = False,
) -> DataFrame:
    """Linearly interpolated exact percentiles, per group.

    Output: the group columns, ``total`` and one column per name.
    """
    df = df.withColumn(value, F.col(value).cast("double"))
    positions: dict[str, Column] = {}
    for name, fraction in fractions.items():
        at = (F.col("total") - 1) * F.lit(float(fraction))
        positions[f"{name}__lo"] = F.floor(at)
        positions[f"{name}__hi"] = F.ceil(at)
    found = order_statistics(df, value, positions, by, few=few)

    def interpolate(name: str, fraction: float) -> Column:
        at = (F.col("total") - 1) * F.lit(float(fraction))
        low, high = F.col(f"{name}__lo"), F.col(f"{name}__hi")
        between = low + (high - low) * (at - F.floor(at))
        return F.when(low == high, low).otherwise(between).alias(name)

    return found.select(*by, "total", *[interpolate(n, f) for n, f in fractions.items()])


def medians(
    df: DataFrame, value: str, by: list[str] = (), name: str = "median", *, few: bool = False
) -> DataFrame:
    return exact_percentiles(df, value, {name: 0.5}, by, few=few).drop("total")


def running_totals(
    counted: DataFrame, value: str, sums: list[str], by: list[str] = ()
) -> DataFrame:
    """For each distinct value the totals over all smaller values of its group.

    ``counted`` has one row per (group, value) with the columns in ``sums``.
    Adds ``<name>_before`` for each of them. Each group is cut into ranges, so
    the window over values never holds more than one range; the offsets of the
    ranges come from a window over at most MOST_RANGES rows of a group.
    """
    counted, by, few = one_group(counted, by, False)
    cuts = counted.groupBy(*by).agg(_splitters(value).alias("__cuts"))
    rows = (
        attach(counted, cuts, by, few=few)
        .withColumn("__range", _range_of(F.col(value).cast("double"), F.col("__cuts")))
        .drop("__cuts")
    )
    ahead = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*by, "__range")
        .agg(*[F.sum(s).alias(s) for s in sums])
        .select(
            *by,
            "__range",
            *[F.coalesce(F.sum(s).over(ahead), F.lit(0)).alias(f"{s}_offset") for s in sums],
        )
    )
    within = (
        Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = attach(rows, offsets, [*by, "__range"])
    return joined.withColumns(
        {
            f"{s}_before": F.col(f"{s}_offset") + F.coalesce(F.sum(s).over(within), F.lit(0))
            for s in sums
        }
    ).drop("__range", "__all", *[f"{s}_offset" for s in sums])


def spread_key(column: Column) -> Column:
    """Deterministic, evenly spread 64-bit order value of a key of any type.

    Equal keys always get the same value, so copies of a row stay on the same
    side of a cut.
    """
    return F.xxhash64(column)
