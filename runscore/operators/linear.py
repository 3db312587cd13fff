"""Linear least squares from sufficient statistics.

A linear model needs no pass over the rows per fit: the sums of products of all
design columns and the target say everything. One aggregate gives that Gram
matrix for the training and the test rows at once, with map-side partial sums;
every model over a subset of the features is the solution of a sub-matrix, and
its error on the test rows is a quadratic form of the other matrix. The driver
holds matrices of the size of the design only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscore.functions.rounding import total
from runscore.operators.ordered import order_statistics, spread_key

MOST_COLUMNS = 100  # design columns of the Gram form; wider designs are left to the pipelines
LABEL = "label"


def _number(name: str) -> Column:
    """A numeric input; NaN is a missing value."""
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


@dataclass(frozen=True)
class Design:
    """Inputs of a linear model: centres of numbers, levels of categories (the first one is the base)."""

    centres: dict[str, float]
    levels: dict[str, list[str]]
    label_centre: float

    def columns(self) -> list[tuple[str, Column]]:
        """(feature, centred column) pairs.

        Missing numbers get the mean of the training rows, missing and unseen
        categories count as the most frequent one, the base level.
        """
        made = [(c, F.coalesce(_number(c), F.lit(m)) - F.lit(m)) for c, m in self.centres.items()]
        for name, levels in self.levels.items():
            text = F.col(name).cast("string")
            made += [(name, F.coalesce(text == level, F.lit(False)).cast("double")) for level in levels[1:]]
        return made


@dataclass(frozen=True)
class Sums:
    """Number of rows and sums of products over [1, design columns, target]."""

    n: int
    products: np.ndarray

    def squared_error(self, weights: np.ndarray) -> float:
        """Sum of squares of target minus weights . [1, columns]."""
        line = np.append(-weights, 1.0)
        return max(0.0, float(line @ self.products @ line))

    def spread(self) -> float:
        """Sum of squares of the target around its mean."""
        return float(self.products[-1, -1] - self.products[0, -1] ** 2 / self.n) if self.n else 0.0


@dataclass(frozen=True)
class LinearFit:
    """A split table, its design and the sums of both parts."""

    rows: DataFrame
    design: Design
    train: Sums
    test: Sums

    def weights(self, features: list[str] | None = None) -> np.ndarray:
        """Intercept and weight of every design column; 0 for features that are left out.

        Columns are brought to unit spread first; of weights that fit equally
        well (columns that repeat others) the shortest vector is taken.
        """
        if not self.train.n:
            raise ValueError("no training rows")
        names = [name for name, _ in self.design.columns()]
        kept = [i for i, name in enumerate(names) if features is None or name in features]
        means = self.train.products[0, :] / self.train.n
        covariance = self.train.products / self.train.n - np.outer(means, means)
        at = [1 + i for i in kept]
        scale = np.sqrt(np.maximum(np.diag(covariance)[at], 0.0))
        flat = scale <= 1e-12 * np.maximum(1.0, np.abs(means[at]))
        scale = np.where(flat, 1.0, scale)
        inside = covariance[np.ix_(at, at)] / np.outer(scale, scale)
        inside[flat, :] = inside[:, flat] = 0.0
        across = np.where(flat, 0.0, covariance[at, -1] / scale)
        solved = np.linalg.lstsq(inside, across, rcond=1e-10)[0] / scale if at else np.zeros(0)
        out = np.zeros(1 + len(names))
        out[at] = solved
        out[0] = means[-1] - out[1:] @ means[1:-1]
        return out

    def metrics(self, features: list[str] | None = None) -> dict[str, float | None]:
        """RMSE and R2 on the test rows, None where they do not exist."""
        error, spread = self.test.squared_error(self.weights(features)), self.test.spread()
        return {
            "rmse": float(np.sqrt(error / self.test.n)) if self.test.n else None,
            "r2": 1.0 - error / spread if spread > 0 else None,
        }

    def prediction(self) -> Column:
        """The prediction of the full model over ``rows``, JVM-side."""
        weights = [float(w) for w in self.weights()]
        terms = [F.lit(w) * column for w, (_, column) in zip(weights[1:], self.design.columns())]
        return total([F.lit(weights[0] + self.design.label_centre), *terms])

    def coefficients(self) -> dict[str, float]:
        """Weight per unit of each numeric feature."""
        weights = self.weights()
        return {name: float(weights[1 + i]) for i, name in enumerate(self.design.centres)}


def split_rows(df: DataFrame, spec) -> DataFrame:
    """label, inputs, row_key and is_train of labelled rows (action: fetches one cut-off).

    The same rows train as in ``stratified_split`` without a label. As the
    cut-off is a number, the split is a plain comparison in every later pass.
    """
    rows = df.where(F.col(spec.target).isNotNull()).select(
        F.col(spec.target).cast("double").alias(LABEL),
        *[F.col(c).cast("double").alias(c) for c in spec.numeric],
        *[F.col(c).cast("string").alias(c) for c in spec.categorical],
        F.col(spec.key).alias("row_key"),
        spread_key(F.col(spec.key)).alias("spread"),
    )
    last = F.floor(F.col("total") * F.lit(float(spec.train_share))) - 1
    cut = order_statistics(rows.select("spread"), "spread", {"cut": last}).first()
    chosen = F.lit(False) if cut is None or cut["cut"] is None else F.col("spread") <= F.lit(cut["cut"])
    return rows.withColumn("is_train", chosen).drop("spread")


def make_design(rows: DataFrame, spec) -> Design | None:
    """Means and levels of the training rows (action); None if the design gets too wide."""
    train = rows.where("is_train")
    means = train.agg(F.avg(LABEL).alias("__label"), *[F.avg(_number(c)).alias(c) for c in spec.numeric]).first()
    levels: dict[str, list[str]] = {c: [] for c in spec.categorical}
    if spec.categorical:
        counts = (
            train.select(*spec.categorical)
            .unpivot([], list(spec.categorical), "feature", "level")
            .where(F.col("level").isNotNull())
            .groupBy("feature", "level")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        found = counts.limit(MOST_COLUMNS + 1).collect()
        if len(found) + len(spec.numeric) > MOST_COLUMNS:
            return None
        for row in sorted(found, key=lambda r: (-r["n"], r["level"])):
            levels[row["feature"]].append(row["level"])
    return Design({c: means[c] or 0.0 for c in spec.numeric}, levels, means["__label"] or 0.0)


def gram(rows: DataFrame, design: Design) -> dict[bool, Sums]:
    """Sums of products of [1, design columns, target] per part, in one aggregate (action)."""
    made = [F.lit(1.0), *[c for _, c in design.columns()], F.col(LABEL) - F.lit(design.label_centre)]
    size = len(made)
    wide = rows.select("is_train", *[c.alias(f"c{i}") for i, c in enumerate(made)])
    places = [(i, j) for i in range(size) for j in range(i, size)]
    sums = [F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s{i}_{j}") for i, j in places]
    found = {False: Sums(0, np.zeros((size, size))), True: Sums(0, np.zeros((size, size)))}
    for row in wide.groupBy("is_train").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        products = np.zeros((size, size))
        for i, j in places:
            products[i, j] = products[j, i] = row[f"s{i}_{j}"]
        found[row["is_train"]] = Sums(row["n"], products)
    return found


def fit_linear(df: DataFrame, spec) -> LinearFit | None:
    """Split, design and sums of a linear regression (action); None if the design gets too wide."""
    rows = split_rows(df, spec)
    design = make_design(rows, spec)
    if design is None:
        return None
    parts = gram(rows, design)
    return LinearFit(rows, design, parts[True], parts[False])


def is_plain_linear(spec) -> bool:
    """Least squares without any penalty or option, which the sums are enough for."""
    return spec.task == "regression" and spec.model == "linear" and not spec.params and not spec.balanced
