"""N-gram Jaccard join by parity sketches.

Every document is its set of distinct word shingles, as 64-bit hashes. A parity
sketch keeps the parity of the tokens per bit, so the Hamming distance of two
sketches never exceeds the symmetric difference of the sets. The sketch that is
joined has a bit for every hash value, in blocks of neighbouring bits; a block is
carried as the XOR of the mixed numbers of its set bits. Sets that link differ in
at most d tokens, d following from the sizes, so with d + 1 + s blocks they have
s + 1 equal blocks at least. Blocks of all zeros are no evidence and are left out
by sets with at most s of them (others keep them), so no link is lost. Documents
are compared per band of set sizes.

Equal sets are one class and take part once. In each group of classes sharing a
block, all are verified against the least one; the components of those links
are formed, and only groups that still span several components compare the rest
across components, so a large group of near copies is never paired out.

Before whole sets are brought together, candidates pass a second parity sketch
whose length grows with the set: one of fixed length says nothing about long
documents, which share some block by chance more often than not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import Scratch
from .words import mix, slices, word_hashes

SKETCH_WORDS = 32  # longs of the sketch over the whole set
BAND_RATIO = 1.35
PASSES = 6  # parts of the keys that meet one after the other, so that few shuffle files exist at a time
_STEP = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending.

    A text with fewer words than width has its whole word sequence as one
    shingle; a text without words has none.
    """
    hashes, bounds, _, _ = word_hashes(column)
    steps = [_STEP[i % 3] * np.uint64(2 * (i // 3) + 1) for i in range(width)]
    joined = None
    if len(hashes) >= width:
        size = len(hashes) - width + 1
        joined = np.zeros(size, dtype=np.uint64)
        for i in range(width):
            joined += hashes[i : i + size] * steps[i]
        joined = mix(joined)
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if end - begin >= width:
            yield np.unique(joined[begin : end - width + 1])
        elif end > begin:
            short = np.uint64(end - begin)
            for i in range(end - begin):
                short = short + hashes[begin + i : begin + i + 1] * steps[i]
            yield mix(mix(short))
        else:
            yield np.zeros(0, dtype=np.uint64)


class Bands:
    """Bands of set sizes, with the blocks that a band needs."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den  # link: den * intersection >= num * union
        self.lows = [1]
        self.blocks: list[tuple[int, int]] = []

    def _grow(self, size: int) -> None:
        while self.lows[-1] <= size:
            low = self.lows[-1]
            high = max(low, int(low * BAND_RATIO))
            differ = 2 * high * (self.den - self.num) // (self.den + self.num)
            blocks = differ + 1
            spare = 0
            if differ:
                for _ in range(4):  # zero blocks to be expected in the smallest set of the band
                    load = max(1, low * self.num // self.den) / (blocks + spare)
                    zero = (blocks + spare) * np.exp(-load)
                    spare = 1 + int(np.ceil(zero + 4 * np.sqrt(zero)))
                    spare = min(spare, blocks)
            self.blocks.append((blocks + spare, spare) if differ else (0, 0))
            self.lows.append(high + 1)

    def of(self, size: int) -> list[tuple[int, int, int]]:
        """(band, blocks, spare) of the set's own band and of those of larger partners."""
        largest = size * self.den // self.num
        self._grow(largest)
        first = int(np.searchsorted(self.lows, size, "right")) - 1
        last = int(np.searchsorted(self.lows, largest, "right")) - 1
        return [(b, *self.blocks[b]) for b in range(first, last + 1) if self.blocks[b][0]]


def block_keys(tokens: np.ndarray, bands: Bands) -> np.ndarray:
    """The keys under which a set meets every set that may link with it; tokens ascend."""
    keys = []
    running = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(mix(tokens))])
    for band, blocks, spare in bands.of(len(tokens)):
        at = ((tokens >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        number = np.arange(blocks + 1, dtype=np.uint64)
        until = running[np.searchsorted(at, number)]  # parity of all blocks before
        value = until[1:] ^ until[:-1]
        number = number[:-1] + np.uint64(band << 40)
        if int((value == 0).sum()) <= spare:
            number, value = number[value != 0], value[value != 0]
        keys.append(mix(value + mix(number + np.uint64(1))))
    return np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)


def whole_sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity sketch of the whole set, SKETCH_WORDS longs."""
    bits = SKETCH_WORDS * 64
    cell = ((mix(tokens) >> np.uint64(40)) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=bits) & 1).astype(np.uint8)).view(">u8").astype(np.uint64)


def long_sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity sketch of at least two bits a token, a power of two of longs; its halves XOR to the next shorter one."""
    longs = 1 << max(0, int(np.ceil(np.log2(max(1, len(tokens)) / 32))))
    cell = (mix(tokens ^ _STEP[2]) & np.uint64(longs * 64 - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=longs * 64) & 1).astype(np.uint8)).view(">u8").astype(np.uint64)


def _signed(values) -> np.ndarray:
    return np.asarray(values, dtype=np.uint64).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = _signed(np.concatenate(parts) if parts else np.zeros(0, np.uint64))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = list(shingle_sets(part.column(1), width))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc": part.column(0),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "s1": pa.array(_signed([s.sum(dtype=np.uint64) for s in sets])),
                        "s2": pa.array(_signed([mix(s ^ _STEP[1]).sum(dtype=np.uint64) for s in sets])),
                    }
                )

    return run


def _lead(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            for part in slices(batch, 1):
                sets = list(shingle_sets(part.column(1), width))
                sketches = np.stack([whole_sketch(s) for s in sets])
                out = {"node": part.column(0), "n": pa.array([len(s) for s in sets], pa.int64())}
                for i in range(SKETCH_WORDS):
                    out[f"k{i}"] = pa.array(_signed(sketches[:, i].copy()))
                out["sketch"] = _lists([long_sketch(s) for s in sets])
                out["keys"] = _lists([block_keys(s, bands) for s in sets])
                yield pa.RecordBatch.from_pydict(out)

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = list(shingle_sets(part.column(1), width))
                yield pa.RecordBatch.from_pydict({"node": part.column(0), "tokens": _lists(sets)})

    return run


_SKETCH = [f"k{i}" for i in range(SKETCH_WORDS)]
_LED = "node long, n long, " + ", ".join(f"{k} long" for k in _SKETCH) + ", sketch array<long>, keys array<long>"


def _may_link(num: int, den: int) -> Column:
    """Necessary for a link: near sizes, and a sketch distance within the allowed difference."""
    apart = sum((F.bit_count(F.col(f"x.{k}").bitwiseXOR(F.col(f"y.{k}"))) for k in _SKETCH), F.lit(0))
    return (
        (F.col("x.n") * den >= F.col("y.n") * num)
        & (F.col("y.n") * den >= F.col("x.n") * num)
        & (apart * (den + num) <= (F.col("x.n") + F.col("y.n")) * (den - num))
    )


def _folded(sketch: Column, longs: Column) -> Column:
    """The sketch at the given length, which is its own or half of it (sizes of a pair are that near)."""
    halves = F.zip_with(F.slice(sketch, F.lit(1), longs), F.slice(sketch, longs + 1, longs), lambda p, q: p.bitwiseXOR(q))
    return F.when(F.size(sketch) > longs, halves).otherwise(sketch)


def _close(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose long sketches differ in no more bits than links allow."""
    longs = F.least(F.size("sa"), F.size("sb"))
    apart = F.aggregate(
        F.zip_with(_folded(F.col("sa"), longs), _folded(F.col("sb"), longs), lambda p, q: F.bit_count(p.bitwiseXOR(q))),
        F.lit(0),
        lambda total, bits: total + bits,
    )
    return (
        pairs.join(sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
        .join(sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        .where((F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num))
        .where(apart * (den + num) <= (F.col("na") + F.col("nb")) * (den - num))
    )


def _verified(
    scratch: Scratch, texts: DataFrame, leaders: DataFrame, pairs: DataFrame, width: int, num: int, den: int, name: str
) -> DataFrame:
    """The pairs (a, b) whose sets link, counted exactly on both whole sets."""
    pairs = scratch.keep(pairs.select("a", "b").distinct(), f"{name}-pairs")
    pairs = scratch.keep(_close(pairs, leaders, num, den).select("a", "b").distinct(), f"{name}-close")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    sets = (
        texts.join(nodes, "doc", "left_semi")
        .select("doc", "text")
        .mapInArrow(_sets(width), "node long, tokens array<long>")
    )
    both = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
        .withColumn("shared", F.size(F.array_intersect("ta", "tb")).cast("long"))
        .withColumn("all", F.size("ta") + F.size("tb") - F.col("shared"))
    )
    return scratch.keep(both.where(F.col("shared") * den >= F.col("all") * num).select("a", "b"), f"{name}-links")


def near_copies(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    num: int = 90,
    den: int = 100,
) -> DataFrame:
    """Component of every document under links den * shared >= num * all; action.

    Returns doc_id, n_shingles, n_links_class (documents with the same set) and
    component_id: the smallest id reachable by links. Words are runs of
    characters other than space, \\t, \\n, \\v, \\f, \\r, with A-Z lower-cased.
    Documents without words (null, empty, blank) have no shingles, are linked
    with nothing and are their own component. Rows without id can't be named:
    component_id is null and they take part in no link. Repeated ids count as
    one document that has each of their texts. Other columns are not read.
    """
    scratch = Scratch(documents.sparkSession, "near-copies")
    texts = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    described = scratch.keep(texts.mapInArrow(_describe(width), "doc long, n long, s1 long, s2 long"), "described")

    named = described.where("doc is not null and n > 0")
    classes = named.groupBy("s1", "s2").agg(F.min("doc").alias("node"), F.count("*").alias("copies"))
    classes = scratch.keep(classes, "classes")
    # keys are wanted for one document of each class only
    leading = texts.join(classes.select(F.col("node").alias("doc")).distinct(), "doc", "left_semi").select("doc", "text")
    leaders = scratch.keep(leading.mapInArrow(_lead(width, num, den), _LED), "leaders")
    parts = []
    for turn in range(PASSES):
        rows = leaders.select("node", F.explode("keys").alias("key")).where(F.pmod("key", F.lit(PASSES)) == turn)
        groups = rows.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
        met = rows.join(groups.select("key", "least"), "key").select("key", "node", "least")
        parts.append(scratch.keep(met, f"met-{turn}"))
    met = parts[0]
    for part in parts[1:]:
        met = met.union(part)
    sketches = leaders.select("node", "n", *_SKETCH)

    stars = met.where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    stars = (
        stars.join(sketches.alias("x"), F.col("a") == F.col("x.node"))
        .join(sketches.alias("y"), F.col("b") == F.col("y.node"))
        .where(_may_link(num, den))
    )
    links = _verified(scratch, texts, leaders, stars, width, num, den, "stars")
    found = connected_components(scratch, links, "first")

    across = None
    for turn, part in enumerate(parts):
        placed = (
            part.where("node != least")
            .join(found, "node", "left")
            .select("key", "node", F.coalesce("component", "node").alias("component"))
        )
        open_keys = (
            placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1")
        )
        rest = placed.join(open_keys.select("key"), "key", "left_semi").join(sketches, "node")
        pairs = (
            rest.alias("x")
            .join(
                rest.alias("y"),
                (F.col("x.key") == F.col("y.key"))
                & (F.col("x.node") < F.col("y.node"))
                & (F.col("x.component") != F.col("y.component"))
                & _may_link(num, den),
            )
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        )
        kept = scratch.keep(pairs.distinct(), f"across-{turn}")
        across = kept if across is None else across.union(kept)
    more = _verified(scratch, texts, leaders, across, width, num, den, "across")
    edges = found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
    final = connected_components(scratch, edges, "final")
    scratch.drop("leaders", *[f"met-{turn}" for turn in range(PASSES)])

    of_class = classes.join(final, "node", "left").select(
        "s1", "s2", "copies", F.coalesce("component", "node").alias("component")
    )
    linked = named.select("doc", "n", "s1", "s2").join(of_class, ["s1", "s2"])
    alone = described.where("doc is null or n = 0").select(
        "doc", "n", F.lit(0).cast("long").alias("copies"), F.col("doc").alias("component")
    )
    return linked.select("doc", "n", "copies", "component").union(alone).select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("copies").alias("class_size"),
        F.col("component").alias("component_id"),
    )


def one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Documents without near copies: of each component the one with the smallest id; action.

    Keeps all columns. Rows without id are all kept; of rows repeating an id one is.
    """
    kept = near_copies(documents, id_col, text_col, **how)
    ids = kept.where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    named = documents.where(F.col(id_col).isNotNull())
    return (
        named.join(ids, id_col, "left_semi")
        .select(documents.columns)
        .dropDuplicates([id_col])
        .union(documents.where(F.col(id_col).isNull()))
    )
