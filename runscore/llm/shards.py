"""Sharding by balanced label propagation, with DataFrame operations only.

Documents of one group (equal texts) are linked. Linked documents start on
hashed shards and move, round after round, to the shard where most of their
group is, as far as that shard's quota of linked documents has room: groups
gather on one shard, and one larger than a quota fills several. Unlinked
documents cost nothing to move and fill the shards up to exact quotas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Scratch

ROUNDS = 8
BUCKET_ROWS = 20_000


def _ranked(frame: DataFrame, keys: list[str], order: list[str], buckets: int) -> DataFrame:
    """Rank from 0 of each row within its keys, without one task per key.

    Rows are dealt over hash buckets of `order`; a bucket's first rank is the
    count of the buckets before it, a small table of keys times buckets.
    """
    dealt = frame.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(*order))
    return (
        dealt.withColumn("inside", inside)
        .join(offsets, [*keys, "bucket"])
        .withColumn("rank", F.col("offset") + F.col("inside") - 1)
        .drop("bucket", "offset", "inside")
    )


def _quota(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def _pick(values: list[int], by: Column) -> Column:
    """values[by], for the few shards."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (by + 1).cast("int"))


def _counts(placed: DataFrame, shards: int) -> list[int]:
    got = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    return [got.get(s, 0) for s in range(shards)]


def gather_groups(scratch: Scratch, linked: DataFrame, quota: list[int]) -> DataFrame:
    """linked(row, group) with a shard each, groups gathered under the quotas; action."""
    shards = len(quota)
    placed = scratch.keep(linked.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")), "round-0")
    for step in range(1, ROUNDS + 1):
        here = _counts(placed, shards)
        room = [max(0, q - n) for q, n in zip(quota, here)]
        if not any(room):
            break
        by_shard = placed.groupBy("group", "shard").agg(F.count("*").alias("n"))
        weight = F.struct("n", F.xxhash64("group", "shard").alias("tie"), "shard")
        target = F.max(F.when(_pick(room, F.col("shard")) > 0, weight))
        best = by_shard.groupBy("group").agg(target.alias("best")).where("best is not null")
        wishes = (
            by_shard.withColumn("own", weight)
            .join(best, "group")
            .where("best > own")
            .select("group", "shard", "n", F.col("best.shard").alias("to"))
        )
        wishes = scratch.keep(wishes, f"wishes-{step}")
        demand = {r["to"]: r["n"] for r in wishes.groupBy("to").agg(F.sum("n").alias("n")).collect()}
        if not demand:
            break
        # a shard without room for all wishes takes an even share of them, group by group
        share = [min(1.0, room[s] / demand[s]) if s in demand else 0.0 for s in range(shards)]
        millionths = _pick([int(x * 1_000_000) for x in share], F.col("to"))
        large = F.col("n") * 4 > _pick(room, F.col("to"))
        lot = F.pmod(F.xxhash64("group", "from", F.when(large, F.col("row")), F.lit(step)), F.lit(1_000_000))
        moved = (
            placed.withColumnRenamed("shard", "from")
            .join(wishes.withColumnRenamed("shard", "from"), ["group", "from"], "left")
            .withColumn("shard", F.when(F.col("to").isNotNull() & (lot < millionths), F.col("to")).otherwise(F.col("from")))
            .select("row", "group", "shard")
        )
        placed = scratch.keep(moved, f"round-{step}")
        scratch.drop(f"round-{step - 1}", f"wishes-{step}")
    return placed


def balanced_shards(scratch: Scratch, rows: DataFrame, shards: int) -> DataFrame:
    """rows(row, group) with shard and slot: counts at most one apart, slots gapless from 0; action.

    group is null for rows linked with nothing.
    """
    total = rows.count()
    quota = _quota(total, shards)
    buckets = max(1, total // BUCKET_ROWS)
    linked = gather_groups(scratch, rows.where(F.col("group").isNotNull()), quota)
    ranked = scratch.keep(_ranked(linked, ["shard"], ["group", "row"], max(1, buckets // shards)), "linked")
    kept = ranked.where(F.col("rank") < _pick(quota, F.col("shard")))
    filled = _counts(kept, shards)
    free = (
        rows.where(F.col("group").isNull())
        .select("row")
        .union(ranked.where(F.col("rank") >= _pick(quota, F.col("shard"))).select("row"))
        .withColumn("all", F.lit(0))
    )
    free = _ranked(free, ["all"], ["row"], buckets)
    ends, begins, reach = [], [], 0
    for s in range(shards):
        begins.append(reach)
        reach += quota[s] - filled[s]
        ends.append(reach)
    shard = F.lit(shards - 1)
    for s in range(shards - 2, -1, -1):
        shard = F.when(F.col("rank") < ends[s], F.lit(s)).otherwise(shard)
    spread = free.withColumn("shard", shard).select(
        "row", "shard", (F.col("rank") - _pick(begins, F.col("shard")) + _pick(filled, F.col("shard"))).alias("slot")
    )
    return kept.select("row", "shard", F.col("rank").alias("slot")).union(spread)


def shard_documents(
    documents: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Shard of every row under the law `rows`; action.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot and
    grown_shard (null under this law). Null texts count as empty, rows are kept
    as often as they come, and rows without id are placed like others.
    """
    scratch = Scratch(documents.sparkSession, "shards")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = scratch.keep(
        documents.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h1"),
            F.xxhash64(F.lit(1), text).alias("h2"),
        ),
        "rows",
    )
    groups = (
        rows.groupBy("h1", "h2")
        .agg(F.min("row").alias("group"), F.count("*").alias("n"))
        .where("n > 1")
        .select("h1", "h2", "group")
    )
    grouped = scratch.keep(rows.join(groups, ["h1", "h2"], "left").select("row", "group"), "grouped")
    placed = balanced_shards(scratch, grouped, shards)
    return rows.join(placed, "row").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
