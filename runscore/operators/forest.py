"""Forests that are fitted on cells instead of rows.

A tree sees an input only as one of up to ``maxBins`` ranges, so rows that fall
into the same ranges (a cell) are one row to it, with a weight and a mean. Every
row is still drawn for every tree by its own Poisson number, as in Spark's
forests; a cell holds the drawn rows and the sum of their labels, per tree. One
pass over the rows makes the cells, and the levels of the trees walk cells.

Rows of one cell and one class are alike in everything, so for classes they are
counted. The Poisson numbers of mean 1 of n rows add up to one of mean n, which
is drawn at once; boosting draws nothing and weighs a cell by its count.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle, inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# executors need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_PER_CELL = 8  # with fewer rows a cell, the numbers a cell keeps per tree outweigh its rows
ROWS_AT_ONCE = 30_000  # rows that a task draws at a time
ROWS_PER_COUNT = 2  # rows of one cell and class at least, on average, for counts to be walked instead
CELLS_AT_ONCE = 20_000  # cells that a task adds up before it hands them on
CELLS_PER_TASK = 50_000
AT_ONCE = 8  # trees fitted at a time
RELATIVE_ERROR = 0.001  # of the rank of a bound between ranges
# Poisson numbers of mean 1 from 32 random bits: how many of these bounds they reach
POISSON_BOUNDS = [int(2**32 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(12)]
CELL_DDL = "code long, weights array<double>, sums array<double>"


def range_bounds(rows: DataFrame, columns: list[str], most: int) -> list[list[float]]:
    """Bounds of at most ``most`` ranges per column (action).

    Columns of few values have a range for each, bounded half way between
    neighbours; others are cut at quantiles.
    """
    if not columns:
        return []
    counts = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    inner: dict[str, list[float]] = {}
    for c in columns:
        if counts[c] <= 2 * most:
            values = sorted(r[0] for r in rows.select(c).distinct().collect())
            if len(values) <= most:
                inner[c] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    wide = [c for c in columns if c not in inner]
    if wide:
        shares = [k / most for k in range(1, most)]
        inner.update(zip(wide, rows.approxQuantile(wide, shares, RELATIVE_ERROR)))
    found = [sorted({x for x in inner[c] if math.isfinite(x)}) or [0.0] for c in columns]
    return [[-math.inf, *bounds, math.inf] for bounds in found]


def cell_code(sizes: dict[str, int]) -> Column:
    """One number for the ranges of a row."""
    code = F.lit(0).cast("long")
    for name, size in sizes.items():
        code = code * size + F.col(name).cast("long")
    return code


def cell_ranges(sizes: dict[str, int]) -> dict[str, Column]:
    """The ranges again, from the number."""
    found, left = {}, F.col("code")
    for name, size in reversed(sizes.items()):
        found[name] = (left % size).cast("double")
        left = F.call_function("div", left, F.lit(size))
    return found


class _Sums:
    """Drawn rows and their summed labels per cell and tree."""

    def __init__(self, trees: int):
        self.trees = trees
        self.place: dict[int, int] = {}
        self.weights, self.sums = np.zeros((1024, trees)), np.zeros((1024, trees))

    def add(self, codes: np.ndarray, weights: np.ndarray, sums: np.ndarray) -> None:
        """Rows in the order of their codes; equal codes are added up."""
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        at = [self.place.setdefault(code, len(self.place)) for code in codes[starts].tolist()]
        while len(self.place) > len(self.weights):
            self.weights = np.concatenate([self.weights, np.zeros_like(self.weights)])
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.weights[at] += np.add.reduceat(weights, starts, axis=0)
        self.sums[at] += np.add.reduceat(sums, starts, axis=0)

    def batches(self) -> Iterator[pa.RecordBatch]:
        codes = list(self.place)
        for i in range(0, len(codes), 1000):
            part = slice(i, min(i + 1000, len(codes)))
            ends = pa.array(np.arange(0, (part.stop - i + 1) * self.trees, self.trees, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[part].ravel())) for x in (self.weights, self.sums)]
            yield pa.RecordBatch.from_arrays([pa.array(codes[part], pa.int64()), *lists], names=["code", "weights", "sums"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to ROWS_AT_ONCE rows or a little more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS_AT_ONCE:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _added_up(trees: int, numbers: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, read = _Sums(trees), numbers()
        for batch in _blocks(batches):
            codes = batch.column(0).to_numpy()
            order = np.argsort(codes, kind="stable")
            held.add(codes[order], *read(batch, order))
            if len(held.place) > CELLS_AT_ONCE:
                yield from held.batches()
                held = _Sums(trees)
        yield from held.batches()

    return run


def _drawn(trees: int, seed: int) -> Callable:
    """Draws every row for every tree, with its own Poisson number of mean 1."""

    def numbers() -> Callable:
        random = np.random.default_rng([seed, TaskContext.get().partitionId()])

        def read(batch: pa.RecordBatch, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            bits = random.integers(0, 2**32, (len(order), trees), np.uint32)
            drawn = np.zeros(bits.shape, np.uint8)
            for bound in POISSON_BOUNDS:
                drawn += bits >= bound
            weights = drawn.astype(float)
            return weights, weights * batch.column(1).to_numpy()[order, None]

        return read

    return _added_up(trees, numbers)


def _merged(trees: int) -> Callable:
    def read(batch: pa.RecordBatch, order: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(batch.column(i).flatten().to_numpy().reshape(-1, trees)[order] for i in (1, 2))

    return _added_up(trees, lambda: read)


def drawn_cells(rows: DataFrame, trees: int, seed: int, cells: int) -> DataFrame:
    """code, and per tree the drawn rows of the cell and their summed labels, from (code, label)."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.coalesce(cores).mapInArrow(_drawn(trees, seed), CELL_DDL)
    # a cell can come out of a task twice: two rows of equal inputs weigh as much as one
    return parts.repartition(1 + cells // CELLS_PER_TASK, "code").mapInArrow(_merged(trees), CELL_DDL)


def drawn_counts(counted: DataFrame, trees: int, seed: int) -> DataFrame:
    """A Poisson number of mean ``n`` per tree (``weight0`` and so on) beside the columns of ``counted``.

    The draws depend on the seed, and on the order of the rows in their
    partitions. A tree has a column of its own, so that it reads no other's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            n = batch.column("n").to_numpy()
            drawn = random.poisson(n[:, None], (len(n), trees))
            columns = [pa.array(np.ascontiguousarray(drawn[:, i]), pa.int64()) for i in range(trees)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    names = [f"weight{i}" for i in range(trees)]
    fields = [f"{name} {kind}" for name, kind in counted.dtypes] + [f"{name} long" for name in names]
    return counted.mapInArrow(run, ", ".join(fields))


def fit_trees(
    cells: DataFrame, tree: RandomForestRegressor | RandomForestClassifier, whole: RandomForestRegressor | RandomForestClassifier
) -> RandomForestRegressionModel | RandomForestClassificationModel:
    """The forest ``whole`` of trees like ``tree``, each fitted on its own draws (action).

    Cells have arrays of weights and of summed labels, or one label and a column of weights per tree.
    """
    spark, seed, label = cells.sparkSession, whole.getSeed(), tree.getLabelCol()

    def fit(i: int) -> RandomForestRegressionModel | RandomForestClassificationModel:
        if "sums" in cells.columns:
            weight = F.col("weights")[i]
            target = (F.col("sums")[i] / weight).alias(label)
        else:
            weight, target = F.col(f"weight{i}").cast("double"), F.col(label)
        drawn = cells.where(weight > 0).select(tree.getFeaturesCol(), weight.alias(tree.getWeightCol()), target)
        return tree.copy({tree.seed: seed + i}).fit(drawn)

    with ThreadPool(AT_ONCE) as pool:
        fitted = pool.map(inheritable_thread_target(spark)(fit), range(whole.getNumTrees()))
    context, first = spark.sparkContext, fitted[0]
    package = context._jvm.org.apache.spark.ml
    classes = isinstance(first, RandomForestClassificationModel)
    kind = package.classification.DecisionTreeClassificationModel if classes else package.regression.DecisionTreeRegressionModel
    trees = context._gateway.new_array(kind, len(fitted))
    for i, model in enumerate(fitted):
        trees[i] = model._java_obj.trees()[0]
    if classes:
        java = package.classification.RandomForestClassificationModel(whole.uid, trees, first.numFeatures, first.numClasses)
        return whole._copyValues(RandomForestClassificationModel(java))
    java = package.regression.RandomForestRegressionModel(whole.uid, trees, first.numFeatures)
    return whole._copyValues(RandomForestRegressionModel(java))
