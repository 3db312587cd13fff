"""Prefix trie of conversations, rolled up in bands of depth.

A node is a distinct sequence of first turns. Its id is the XOR of 128-bit
digests of (depth, turn), so a running XOR along a conversation gives the ids of
all its prefixes and a node's id without its last turn is its parent's.

Totals over subtrees come in bands of fixed height. A node's values are exploded
to its ancestors inside its band only, along the conversation that represents
it. The tops of the bands form a trie of their own, a band's height lower, which
is rolled up the same way; then every completed top adds its total to the nodes
above it in the next band. So a node explodes to at most `band` rows and the
number of rounds is the logarithm of the depth, to the base `band`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

BAND = 32  # levels of a band
CHUNK_BITS = 12  # conversations that end at a node are listed in chunks of 4,096 ids
NODE = ["depth", "x1", "x2"]
TOTALS = ["n_leaves", "saved_tokens"]
WORD = r"[^\x20\x09-\x0D]+"


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n, t1, t2, n_words: every turn as its place, a 128-bit digest and its words.

    Turns are ordered by turn (null first); equal turns by role, then by digest.
    Null roles and texts count as empty, repeated rows as turns of their own.
    Rows without conv_id belong to no conversation. Other columns are not read.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.xxhash64(F.lit("turn"), role, text).alias("t1"),
        F.xxhash64(F.lit("text"), text, role).alias("t2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "t1", "t2")
    return turns.select("conv_id", F.row_number().over(order).alias("n"), "t1", "t2", "n_words")


def reopened(turns: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Turn digests of conversations that begin like the first of their block of `every` ids.

    Conversation c takes its first h turns from c - c % every (all if that has
    fewer, none if it does not exist) and keeps its own turns after the first
    h = crc32(c in decimal) % (most + 1).
    """
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    known = turns.select("conv_id").distinct().select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("first"), taken.alias("h")
    )
    openings = turns.where(F.col("n") <= most).withColumnRenamed("conv_id", "first")
    given = known.join(openings, "first").where(F.col("n") <= F.col("h"))
    return turns.where(F.col("n") > taken).unionByName(given.select(*turns.columns))


def chains(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per conversation and prefix, the empty one included.

    conv_id, depth, x1, x2 (the prefix), p1, p2 (the prefix before), n_words of
    the last turn, is_end.
    """
    start = ids.select("conv_id", F.lit(0).alias("n"), *[F.lit(None).cast("long").alias(c) for c in ("t1", "t2", "n_words")])
    order = Window.partitionBy("conv_id").orderBy("n")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.unionByName(start).select(
        "*", (F.row_number().over(order) - 1).alias("depth"), F.lead("n").over(order).isNull().alias("is_end")
    )

    def own(name: str) -> Column:
        return F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(name), "depth", "t1", "t2"))

    hashed = placed.withColumns({"o1": own("first"), "o2": own("second")})
    ids_so_far = hashed.withColumns({"x1": F.bit_xor("o1").over(so_far), "x2": F.bit_xor("o2").over(so_far)})
    return ids_so_far.select(
        "conv_id", "depth", "x1", "x2",
        F.col("x1").bitwiseXOR(F.col("o1")).alias("p1"),
        F.col("x2").bitwiseXOR(F.col("o2")).alias("p2"),
        F.coalesce("n_words", F.lit(0)).alias("n_words"),
        "is_end",
    )


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in TOTALS]


def rolled_up(scratch: Scratch, nodes: DataFrame, chain: DataFrame, height: int, band: int, level: int = 0) -> DataFrame:
    """depth, x1, x2 and the totals over every node's subtree; action if `height` reaches `band`.

    nodes: conv_id (the representative), k (level in this trie), depth, x1, x2
    and the values to add; chain: conv_id, k, depth, x1, x2 of all prefixes of
    the conversations. A conversation has at most `band` rows in a band.
    """
    above = chain.select(
        F.col("conv_id").alias("c"), F.expr(f"k div {band}").alias("b"), F.col("k").alias("top"), *NODE
    )

    def explode(rows: DataFrame) -> DataFrame:
        """rows(conv_id, b, k, totals) to all nodes of band b at level k or above it."""
        met = (F.col("conv_id") == F.col("c")) & (rows["b"] == above["b"]) & (F.col("top") <= F.col("k"))
        return rows.join(above, met).groupBy(*NODE).agg(*_sums())

    inside = explode(nodes.select("conv_id", F.expr(f"k div {band}").alias("b"), "k", *TOTALS))
    if height < band:
        return inside
    inside = scratch.keep(inside, f"inside-{level}")
    tops = nodes.where(F.col("k") % band == 0).select("conv_id", F.expr(f"k div {band}").alias("k"), *NODE)
    up = chain.where(F.col("k") % band == 0).withColumn("k", F.expr(f"k div {band}"))
    whole = rolled_up(scratch, tops.join(inside, NODE), up, height // band, band, level + 1)
    below = tops.where(F.col("k") > 0).join(whole, NODE).select(
        "conv_id", (F.col("k") - 1).alias("b"), (F.col("k") * band).alias("k"), *TOTALS
    )
    return inside.unionByName(explode(below)).groupBy(*NODE).agg(*_sums())


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's comma-joined pieces, which come one after the other."""
    key, state = None, None


    for batch in batches:
        done = []
        for *node, piece in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if node != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = node, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if done:
            yield _rows(done)
    if key is not None:
        yield _rows([(*key, state.hexdigest())])


def _rows(done: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string()]
    names = [*NODE, "ends_sha256"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)


def ends(chain: DataFrame) -> DataFrame:
    """depth, x1, x2, ends_sha256 of the nodes where conversations end.

    The ids go through the digest in ascending order as a stream of pieces, so a
    node where a third of all conversations end needs one piece of memory.
    """
    pieces = (
        chain.where("is_end")
        .groupBy(*NODE, F.shiftright("conv_id", CHUNK_BITS).alias("chunk"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("piece"))
    )
    in_order = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
    return in_order.select(*NODE, "piece").mapInArrow(_digest, "depth int, x1 long, x2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame | None = None, band: int = BAND) -> DataFrame:
    """The nodes of the trie of turn digests (see turn_digests); action.

    ids: conversations that count even without turns. Per node: conv_id (its
    smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. Without any conversation
    there is no node, not even a root.
    """
    scratch = Scratch(turns.sparkSession, "prefix-trie")
    known = turns.select("conv_id")
    if ids is not None:
        known = known.unionByName(ids.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")))
    chain = scratch.keep(chains(turns, known.distinct()), "chains")
    nodes = scratch.keep(
        chain.groupBy(*NODE).agg(
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.count_if("is_end").alias("n_ends"),
            *[F.max(c).alias(c) for c in ("p1", "p2", "n_words")],
        ),
        "nodes",
    )
    height = nodes.agg(F.max("depth")).first()[0] or 0
    values = nodes.select(
        "conv_id", F.col("depth").alias("k"), *NODE,
        (F.col("n_ends") == F.col("n_convs")).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved_tokens"),
    )
    path = chain.select("conv_id", F.col("depth").alias("k"), *NODE)
    totals = rolled_up(scratch, values, path, height, band)
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")]
    children = nodes.where("depth > 0").groupBy(*parent).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    return (
        nodes.join(totals, NODE)
        .join(children, NODE, "left")
        .join(ends(chain), NODE, "left")
        .join(parents, ["depth", "p1", "p2"], "left")
        .select(
            "conv_id",
            F.col("depth").cast("long").alias("depth"),
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )
