"""Mixing sources to target weights by the cube method.

Every document of a source has the same expected number of copies, target over
size. Whole copies are taken outright; the fraction is an inclusion probability
that the flight phase moves to 0 or 1 along directions keeping both the number
of documents and their words. It flies in blocks of bounded size and then over
what the blocks left open, two documents each, until one block per source is
left to land.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Scratch

BLOCK_ROWS = 4000
MOST_COPIES = 3
TINY = 1e-9
MOST_EXCHANGES = 200  # after landing, in a block; usually one or two
WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, n_docs, target of a table (source, size).

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the
    sum of all sizes. No target exceeds `most` times its source's size; the
    excess goes to the others by weight. One row per source meets in one task.
    """
    every = Window.partitionBy(F.lit(0))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weighed = totals.withColumn(
        "weight", (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1
    )
    before = every.orderBy("fullness", "position").rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        weighed.withColumn("cap", F.col("source_size") * float(most))
        .withColumn("fullness", F.col("cap") / F.col("weight"))
        .withColumn("position", F.row_number().over(every.orderBy("fullness", F.col("source").asc_nulls_last())))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.sum("source_size").over(every) - F.col("capped")) / F.col("open_weight"))
    )
    # the first source, from the emptiest on, that the common level does not fill
    first = F.min(F.when(F.col("level") <= F.col("fullness"), F.struct("position", "level"))).over(every)
    return levels.withColumn("common", first["level"]).select(
        "source",
        "source_size",
        "n_docs",
        F.least("cap", F.coalesce(F.col("common") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def fly(size: np.ndarray, chance: np.ndarray, seed: int) -> np.ndarray:
    """Move chances to 0 or 1, keeping their sum and their sum of sizes; at most two stay open.

    Documents are taken in the given order, so the last ones stay open.
    """
    p = chance.tolist()
    sizes = size.tolist()
    draws = iter(np.random.default_rng(seed).random(3 * len(p) + 8).tolist())
    active: list[int] = []
    waiting = iter(range(len(p)))
    while True:
        while len(active) < 3:
            following = next(waiting, None)
            if following is None:
                break
            if TINY < p[following] < 1 - TINY:
                active.append(following)
            else:
                p[following] = float(round(p[following]))
        if len(active) < 3:
            if len(active) == 2 and sizes[active[0]] == sizes[active[1]]:
                direction = [1.0, -1.0]
            else:
                break
        else:
            a, b, c = (sizes[i] for i in active)
            direction = [float(c - b), float(a - c), float(b - a)]
            if not any(direction):
                direction = [1.0, -1.0, 0.0]
        up = down = np.inf
        for i, d in zip(active, direction):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
        step = up if next(draws, 0.5) * (up + down) < down else -down
        for i, d in zip(active, direction):
            p[i] += step * d
            if p[i] <= TINY:
                p[i] = 0.0
            elif p[i] >= 1 - TINY:
                p[i] = 1.0
        active = [i for i in active if 0.0 < p[i] < 1.0]
    return np.array(p)


def land(size: np.ndarray, chance: np.ndarray, flown: np.ndarray) -> np.ndarray:
    """Decide the few documents still open so that the words come nearest to their sum.

    Then the remaining difference is made smaller by exchanges, one by one, between a
    taken and an untaken document of the block.
    """
    out = flown.copy()
    movable = np.flatnonzero((chance > TINY) & (chance < 1 - TINY))
    left = np.flatnonzero((flown > 0) & (flown < 1))
    want = float((size * chance).sum())
    if len(left):
        decided = want - float((np.delete(size, left) * np.delete(flown, left)).sum())
        choices = [[(c >> k) & 1 for k in range(len(left))] for c in range(1 << len(left))]
        out[left] = min(choices, key=lambda x: (abs(float((size[left] * x).sum()) - decided), x))
    for _ in range(MOST_EXCHANGES):
        missing = want - float((size * out).sum())
        # -1 stands for no document, so one may also come or go alone
        taken = np.append(movable[out[movable] == 1], -1)
        free = np.append(movable[out[movable] == 0], -1)
        leaving = np.where(taken < 0, 0, size[taken])
        coming = np.where(free < 0, 0, size[free])
        order = np.argsort(coming, kind="stable")
        free, coming = free[order], coming[order]
        at = np.searchsorted(coming, leaving + missing)
        best = (abs(missing) - 0.5, None)
        for near in (np.clip(at - 1, 0, len(free) - 1), np.clip(at, 0, len(free) - 1)):
            rest = np.abs(missing - (coming[near] - leaving))
            k = int(np.argmin(rest))
            if rest[k] < best[0]:
                best = (float(rest[k]), (taken[k], free[near[k]]))
        if best[1] is None:
            break
        for document, value in zip(best[1], (0.0, 1.0)):
            if document >= 0:
                out[document] = value
    return out


def _flight(level: int, last: bool):
    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "order"], ascending=[False, True], kind="stable")
        seed = zlib.crc32(f"{level}|{key[0]}|{key[1]}".encode())
        size = block["size"].to_numpy(np.int64)
        chance = block["chance"].to_numpy(np.float64)
        flown = fly(size, chance, seed)
        return block.assign(chance=land(size, chance, flown) if last else flown)

    return run


def mixture(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """rows(row, order, source, size) with source_size, target and copies; action."""
    targets = scratch.keep(source_targets(rows), "targets")
    blocks = F.ceil(F.col("n_docs") / F.lit(BLOCK_ROWS)).cast("long")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    placed = (
        rows.alias("r")
        .join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
        .select("r.*", "t.source_size", "t.target", blocks.alias("blocks"), expected.alias("expected"))
        .withColumn("whole", F.floor(F.col("expected") + TINY).cast("int"))
        .withColumn("chance", F.greatest(F.col("expected") - F.col("whole"), F.lit(0.0)))
        .withColumn("block", F.pmod(F.col("order"), F.col("blocks")))
    )
    shape = placed.schema
    most = targets.agg(F.max(F.ceil(F.col("n_docs") / F.lit(BLOCK_ROWS)))).first()[0] or 0
    level, pending, decided = 0, placed, []
    while True:
        last = most <= 1
        flown = scratch.keep(pending.groupBy("source", "block").applyInPandas(_flight(level, last), shape), f"level-{level}")
        decided.append(flown.where("chance <= 0 or chance >= 1"))
        if last:
            break
        level, most = level + 1, -(-most * 2 // BLOCK_ROWS)
        blocks = F.ceil(F.col("blocks") * 2 / F.lit(BLOCK_ROWS)).cast("long")
        pending = (
            flown.where("chance > 0 and chance < 1")
            .withColumn("blocks", blocks)
            .withColumn("block", F.pmod(F.col("block"), F.col("blocks")))
        )
    result = decided[0]
    for more in decided[1:]:
        result = result.union(more)
    return result.withColumn("copies", F.col("whole") + F.col("chance").cast("int"))


def _rows(documents: DataFrame, id_col: str, text_col: str, source_col: str) -> list:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    number = F.monotonically_increasing_id()
    # rows without id that have equal texts are interchangeable: their number only spreads them
    order = F.xxhash64(F.col(id_col).cast("string"), text, F.when(F.col(id_col).isNull(), number))
    return [
        number.alias("row"),
        order.alias("order"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"),
    ]


def mix_plan(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every row; action.

    size is the number of words, 0 for null or blank texts; such rows and
    sources of size 0 take nothing. No row is taken more than MOST_COPIES
    times. Rows repeating an id are rows of their own. The seeds follow from
    source and block, blocks from a hash of id and text, so reruns agree.
    """
    scratch = Scratch(documents.sparkSession, "mixture")
    rows = documents.select(F.col(id_col).alias("doc_id"), *_rows(documents, id_col, text_col, source_col))
    done = mixture(scratch, scratch.keep(rows, "rows"))
    return done.select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The mix itself: every row as often as it is taken, all columns kept; action."""
    scratch = Scratch(documents.sparkSession, "mixed")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("document"),
                            *_rows(documents, id_col, text_col, source_col))
    numbered = scratch.keep(rows, "rows")
    done = mixture(scratch, numbered.select("row", "order", "source", "size"))
    taken = done.where("copies > 0 and size > 0").select("row", "copies")
    return (
        numbered.select("row", "document")
        .join(taken, "row")
        .select("document", F.explode(F.sequence(F.lit(1), "copies")))
        .select("document.*")
    )
