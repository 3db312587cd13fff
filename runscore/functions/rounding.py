"""Rounding and blank tests that do not depend on how the data is partitioned."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

GUARD_DIGITS = 5


def stable_round(value: Column, digits: int) -> Column:
    """Round half up after dropping summation noise.

    A distributed mean can end in ...499999 or ...5 depending on the order in
    which partitions merge. Rounding to a few guard digits first makes the
    result the same for every partitioning.
    """
    return F.round(F.round(value, digits + GUARD_DIGITS), digits)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))


def bonus(condition: Column, points: float) -> Column:
    """``points`` when the condition holds, else 0."""
    return F.when(condition, F.lit(float(points))).otherwise(F.lit(0.0))


def total(terms: list[Column]) -> Column:
    return reduce(add, terms)


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


def is_filled(text: Column) -> Column:
    """Has at least one non-whitespace character (``trim`` only knows spaces)."""
    return F.coalesce(text.rlike(r"\S"), F.lit(False))
