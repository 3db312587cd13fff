"""Vector codes: product quantisation with exact nearest entries by slices and masks.

Vectors are cut into consecutive parts, each with a codebook of up to 64
entries. Per dimension of a part the entries' coordinates are sorted, and every
place in that order carries a mask of the entries before it. For a query part
the distance to a first guess is a radius that the nearest entry cannot exceed.
Per dimension, two binary searches slice out the coordinates within the radius;
the masks at both ends give the slice as 64 bits, and the AND over all dimensions
is a box that holds every entry within the radius. Distances are computed for
those candidates only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch

ENTRIES = 64  # one bit of a mask each
ROWS = 8192  # vectors whose candidates are held at once


class Slices:
    """The codebook of one part, ready for exact nearest-entry search."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # int64, one row per entry
        count, width = entries.shape
        self.orders = [np.argsort(entries[:, j], kind="stable") for j in range(width)]
        self.sorted = [entries[o, j] for j, o in enumerate(self.orders)]
        bits = np.uint64(1) << np.arange(count, dtype=np.uint64)
        self.before = [np.concatenate([[np.uint64(0)], np.bitwise_or.accumulate(bits[o])]) for o in self.orders]
        self.computed = 0

    def _away(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((x - self.entries[entry]) ** 2).sum(axis=1)

    def radius(self, x: np.ndarray) -> np.ndarray:
        """Not less than the distance to the nearest entry: best of the nearest by single coordinates."""
        best = None
        for j, order in enumerate(self.orders):
            after = np.minimum(np.searchsorted(self.sorted[j], x[:, j]), len(order) - 1)
            away = self._away(x, order[after])
            away = np.minimum(away, self._away(x, order[np.maximum(after - 1, 0)]))
            best = away if best is None else np.minimum(best, away)
        return np.sqrt(best.astype(float)).astype(np.int64) + 1

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask of the entries whose every coordinate lies within the radius."""
        found = None
        for j, (values, before) in enumerate(zip(self.sorted, self.before)):
            low = np.searchsorted(values, x[:, j] - radius, "left")
            high = np.searchsorted(values, x[:, j] + radius, "right")
            inside = before[high] ^ before[low]
            found = inside if found is None else found & inside
        return found

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties: the lowest) and its squared distance."""
        if not x.shape[1] or not len(x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        masks = self.candidates(x, self.radius(x)).astype("<u8")
        bits = np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, entry = np.nonzero(bits)  # every row has one at least
        self.computed += len(row)
        away = self._away(x[row], entry)
        first = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(away, first)
        at = np.flatnonzero(away == least[row])
        at = at[np.searchsorted(row[at], np.arange(len(x)))]
        return entry[at], least


def part_bounds(size: int, parts: int) -> list[int]:
    return [size * p // parts for p in range(parts + 1)]


def largest_component(size: int) -> int:
    """Components up to this magnitude keep squared distances of whole vectors within 62 bits."""
    return 1 << ((62 - max(1, size - 1).bit_length()) // 2 - 1)


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def _assigned(vectors: np.ndarray, slices: list[Slices], bounds: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for p, book in enumerate(slices):
        part = np.ascontiguousarray(vectors[:, bounds[p] : bounds[p + 1]])
        yield p, part, *book.nearest(part)


def _tally(codebook: np.ndarray, bounds: list[int]):
    """Per part and entry the number and componentwise sum of the parts nearest to it, one row each per task."""
    parts, (count, size) = len(bounds) - 1, codebook.shape
    width = max(b - a for a, b in zip(bounds, bounds[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(codebook[:, a:b]) for a, b in zip(bounds, bounds[1:])]
        number = np.zeros((parts, count), np.int64)
        total = np.zeros((parts, count, width), np.int64)
        for batch in batches:
            for begin in range(0, len(batch), ROWS):
                vectors = _vectors(batch.column(0).slice(begin, ROWS), size)
                for p, part, entry, _ in _assigned(vectors, slices, bounds):
                    number[p] += np.bincount(entry, minlength=count)
                    np.add.at(total[p, :, : part.shape[1]], entry, part)
        p, e = np.nonzero(number)
        sums = total[p, e]
        ends = np.arange(len(p) + 1, dtype=np.int32) * width
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(number[p, e]),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.ravel())),
            ],
            names=["part", "entry", "n", "sums"],
        )

    return run


def _encode(codebook: np.ndarray, bounds: list[int]):
    size = codebook.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(codebook[:, a:b]) for a, b in zip(bounds, bounds[1:])]
        for batch in batches:
            codes, errors = [], []
            for begin in range(0, len(batch), ROWS):
                vectors = _vectors(batch.column(2).slice(begin, ROWS), size)
                code = np.zeros((len(vectors), len(slices)), np.uint8)
                error = np.zeros(len(vectors), np.int64)
                for p, _, entry, away in _assigned(vectors, slices, bounds):
                    code[:, p] = entry
                    error += away
                codes += [row.tobytes().hex() for row in code]
                errors.append(error)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(np.concatenate([np.zeros(0, np.int64), *errors]))],
                names=["vec_id", "label", "code", "error"],
            )

    return run


def clean_vectors(vectors: DataFrame, scale: float, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """vec_id, label, v (integer components) of usable rows, and the usual length; action."""
    raw = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).alias("label"),
        F.col(vector_col).cast("array<double>").alias("x"),
    )
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = raw.where(F.col("x").isNotNull() & (F.size("x") > 0) & finite)
    lengths = (
        usable.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    )
    size = lengths[0]["size"] if lengths else 0
    most = float(largest_component(size))
    whole = F.transform(
        "x", lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x, F.lit(1e15)), F.lit(-1e15)) * scale), F.lit(int(most))), F.lit(-int(most)))
    )
    return usable.where(F.size("x") == size).select("vec_id", "label", whole.alias("v")), size


def train_codebook(vectors: DataFrame, size: int, parts: int, rounds: int) -> np.ndarray:
    """Entries x components after `rounds` of assigning all vectors(vec_id, v) and moving the entries; action."""
    bounds = part_bounds(size, parts)
    seeds = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    codebook = np.array([row["v"] for row in seeds], np.int64)
    width = max(b - a for a, b in zip(bounds, bounds[1:]))
    for _ in range(rounds):
        tallies = vectors.select("v").mapInArrow(_tally(codebook, bounds), "part int, entry int, n long, sums array<long>")
        moved = tallies.groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)]
        )
        codebook = codebook.copy()
        for row in moved.collect():  # parts x entries rows at most
            begin, end = bounds[row["part"]], bounds[row["part"] + 1]
            codebook[row["entry"], begin:end] = [row[f"s{j}"] // row["n"] for j in range(end - begin)]
    return codebook


def codebook_digest(codebook: np.ndarray, parts: int) -> str:
    bounds = part_bounds(codebook.shape[1], parts)
    listed = [str(x) for a, b in zip(bounds, bounds[1:]) for entry in codebook[:, a:b].tolist() for x in entry]
    return hashlib.sha256(",".join(listed).encode()).hexdigest()


def compress_vectors(
    vectors: DataFrame,
    parts: int = 16,
    rounds: int = 2,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row; action.

    Components x become floor(scale * x). Rows whose vector is null, empty or
    holds null or non-finite components are dropped, and so are vectors of
    another length than most. Codebooks start as the parts of the 64 smallest
    ids (fewer rows: all of them; null ids come last); repeated rows count as
    often as they come. code: two hex digits per part; error: squared distance
    over all parts; label_error: errors summed over equal labels, nulls
    together, null where the sum leaves 64 bits. A length that `parts` does not
    divide gives parts that differ by one. Components past largest_component()
    are held at that bound. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vector-codes")
    clean, size = clean_vectors(vectors, scale, id_col, vector_col, label_col)
    label_type = clean.schema["label"].dataType.simpleString()
    if not size:
        kinds = f"vec_id long, label {label_type}, code string, error long"
        return spark.createDataFrame([], kinds).selectExpr(
            "vec_id", "code", "error", "error AS label_error", "code AS codebooks_sha256"
        )
    clean = scratch.keep(clean, "clean")
    codebook = train_codebook(clean, size, parts, rounds)
    encoded = clean.select("vec_id", "label", "v").mapInArrow(
        _encode(codebook, part_bounds(size, parts)), f"vec_id long, label {label_type}, code string, error long"
    )
    encoded = scratch.keep(encoded, "encoded")
    sums = encoded.groupBy(F.col("label").alias("same")).agg(F.try_sum("error").alias("label_error"))
    return encoded.join(sums, F.col("label").eqNullSafe(F.col("same")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(codebook_digest(codebook, parts)).alias("codebooks_sha256")
    )
