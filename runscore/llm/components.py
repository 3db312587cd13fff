"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Hang neighbours on the least node of each neighbourhood.

    The least neighbour is found by a combined aggregate and joined back, so a
    node with very many neighbours is split over tasks like any skewed join.
    """
    if larger_only:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges
    least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = around.join(least, "a")
    if larger_only:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.where("a != b").distinct()


def connected_components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node of edges(a, b); action.

    component is the smallest node reachable. Repeated edges, loops and both
    directions are allowed; no edges give no rows. Each round is written to the
    shared folder, and rounds grow with the logarithm of the longest path.
    """
    current = scratch.keep(
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        f"{name}-0",
    )
    mark = _mark(current)
    step = 0
    while mark[0]:
        step += 1
        moved = _stars(_stars(current, True), False)
        following = scratch.keep(moved, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        current, before, mark = following, mark, _mark(following)
        if mark == before:
            break
    labels = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.union(labels.select("component", "component").distinct())


def _mark(edges: DataFrame) -> tuple[int, int, int]:
    row = edges.agg(
        F.count("*"),
        F.expr("bit_xor(xxhash64(a, b))"),
        F.expr("bit_xor(xxhash64(b, a, 1))"),
    ).first()
    return row[0], row[1], row[2]
