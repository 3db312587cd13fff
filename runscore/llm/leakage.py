"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are cut into overlapping windows of WINDOW characters. A window
of L characters that occurs with at most e edits shares at least
L - q + 1 - q * e of its q-grams with the text, all on diagonals at most e apart.
Shared q-grams are counted in overlapping diagonal bands that hold every such
stretch; bands under the bound are dropped, the rest verified by an alignment
confined to the band. The bound is necessary for a match, so no window is lost.
Windows begin every STRIDE characters, so a verbatim quote of WINDOW + STRIDE - 1
normalised characters from anywhere in an item is always found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

Q = 10
WINDOW = 96
STRIDE = 8
EDIT_SHARE = 16  # one edit allowed for so many characters of a window
BLOCK_CHARS = 500_000  # benchmark characters matched in one pass over the documents
_TABLE_BITS = 20
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def normalised(text: str | None) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join((text or "").lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """64-bit hash of the Q characters from each position on (Q = 10: 8 and 2)."""
    if len(points) < Q:
        return np.zeros(0, dtype=np.uint64)
    one = points.astype(np.uint64) + np.uint64(1)
    two = one[:-1] * _A + one[1:]
    four = two[:-2] * _B + two[2:]
    eight = four[:-4] * _C + four[4:]
    ten = eight[:-2] * _A + two[8:]
    return (ten ^ (ten >> np.uint64(29))) * _B  # equal hashes of other grams only cost a verification


class Index:
    """Windows of a block of benchmark items and their q-grams, sorted by hash."""

    def __init__(self, items: list[tuple[int, str]]):
        self.windows: list[np.ndarray] = []
        self.item: list[int] = []
        self.per_item: dict[int, int] = {}
        edits, need, grams, where, window = [], [], [], [], []
        for item, text in items:
            points = code_points(normalised(text))
            if len(points) < Q:
                continue
            last = max(0, len(points) - WINDOW)
            begins = sorted({*range(0, last + 1, STRIDE), last})
            self.per_item[item] = self.per_item.get(item, 0) + len(begins)
            for begin in begins:
                piece = points[begin : begin + WINDOW]
                e = min(len(piece) // EDIT_SHARE, (len(piece) - Q) // Q)
                hashes = gram_hashes(piece)
                grams.append(hashes)
                where.append(np.arange(len(hashes)))
                window.append(np.full(len(hashes), len(self.windows)))
                self.windows.append(piece)
                self.item.append(item)
                edits.append(e)
                need.append(len(piece) - Q + 1 - Q * e)
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.grams = flat[order]
        self.where = (np.concatenate(where) if where else np.zeros(0, np.int64))[order]
        self.window = (np.concatenate(window) if window else np.zeros(0, np.int64))[order]
        self.edits, self.need = np.array(edits, np.int64), np.array(need, np.int64)
        self.least = int(self.need.min()) if need else 0
        self.seen = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.seen[(self.grams >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def regions(self, points: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(window, first diagonal, last diagonal, shared q-grams) of the bands that meet the bound."""
        hashes = gram_hashes(points)
        at = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        if not len(at):
            return []
        low = np.searchsorted(self.grams, hashes[at], "left")
        times = np.searchsorted(self.grams, hashes[at], "right") - low
        at, low, times = at[times > 0], low[times > 0], times[times > 0]
        if not len(at):
            return []
        # every occurrence of each gram in the index
        total = int(times.sum())
        if total < self.least:
            return []
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(total)
        window, place = self.window[entry], np.repeat(at, times)
        enough = (np.bincount(window, minlength=len(self.need)) >= self.need)[window]
        if not enough.any():
            return []
        entry, window, place = entry[enough], window[enough], place[enough]
        diagonal = place - self.where[entry]
        cell = (diagonal + WINDOW) // (2 * self.edits[window] + 1)
        key, count = np.unique((window << 40) + cell, return_counts=True)
        with_next = count.copy()
        with_next[:-1] += np.where(key[1:] == key[:-1] + 1, count[1:], 0)
        found = []
        for k in np.flatnonzero(with_next >= self.need[key >> 40]):
            w = int(key[k] >> 40)
            size = int(2 * self.edits[w] + 1)
            first = int(key[k] & ((1 << 40) - 1)) * size - WINDOW
            edits = int(self.edits[w])  # the match may begin so far from its first shared q-gram
            found.append((w, first - edits, first + 2 * size - 1 + edits, int(with_next[k])))
        return found

    def matches(self, points: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(window, begin, end, edits) of verified occurrences, the best of each window and band."""
        out = []
        for w, first, last, _ in self.regions(points):
            hit = banded_alignment(self.windows[w], points, first, last, int(self.edits[w]))
            if hit is not None:
                out.append((w, *hit))
        return out


def banded_alignment(
    pattern: np.ndarray, text: np.ndarray, first: int, last: int, most: int
) -> tuple[int, int, int] | None:
    """Least edits to turn the whole pattern into a stretch of text beginning on a diagonal of the band.

    Returns (begin, end, edits), or None over `most` edits. Paths may leave the
    band by `most` diagonals. Row by row over the band; gaps inside a row are
    closed by a running minimum.
    """
    for diagonal in range(max(first, 0), min(last, len(text) - len(pattern)) + 1):
        if text[diagonal] == pattern[0] and np.array_equal(text[diagonal : diagonal + len(pattern)], pattern):
            return diagonal, diagonal + len(pattern), 0
    if not most:
        return None
    low, width = first - most, last - first + 1 + 2 * most
    far = 1 << 20
    offset = np.arange(width)
    column = low + offset  # text position before which row 0 stands, per diagonal
    inside = (column >= 0) & (column <= len(text))
    cost = np.where(inside & (offset >= most) & (offset < width - most), 0, far)
    origin = column.copy()
    for i, point in enumerate(pattern):
        reach = column + i  # text position read on this row
        valid = (reach >= 0) & (reach < len(text))
        same = np.zeros(width, dtype=bool)
        same[valid] = text[reach[valid]] == point
        step = np.where(valid, cost + ~same, far)
        begun = origin
        # a pattern character without partner: from the next diagonal of the row before
        skip = np.append(cost[1:] + 1, far)
        from_skip = np.append(origin[1:], 0)
        begun = np.where(skip < step, from_skip, begun)
        step = np.minimum(step, skip)
        # text characters without partner: along the row
        shifted = step - offset
        best = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == best, offset, 0))
        cost, origin = best + offset, begun[source]
        reach = column + i + 1
        cost = np.where((reach >= 0) & (reach <= len(text)), cost, far)
        if cost.min() > most:
            return None
    k = int(np.argmin(cost))
    return int(origin[k]), int(column[k] + len(pattern)), int(cost[k])


def benchmark_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most about BLOCK_CHARS characters; one partition at a time reaches the driver.

    Items without id or text and those under Q normalised characters can't match.
    """
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")
    )
    block, chars = [], 0
    for row in rows.toLocalIterator():
        block.append((row["item"], row["text"]))
        chars += len(row["text"])
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


_LEAKS = "doc_id long, item_id long, windows int, item_windows int, begin long, end long, edits int"


def _find(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = index.value
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                points = code_points(normalised(text.as_py()))
                by_item: dict[int, list] = {}
                for match in lookup.matches(points):
                    by_item.setdefault(lookup.item[match[0]], []).append(match)
                for item, found in sorted(by_item.items()):
                    values = (
                        doc,
                        item,
                        len({m[0] for m in found}),
                        lookup.per_item[item],
                        min(m[1] for m in found),
                        max(m[2] for m in found),
                        min(m[3] for m in found),
                    )
                    for column, value in zip(out, values):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            names = ["doc_id", "item_id", "windows", "item_windows", "begin", "end", "edits"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return run


def find_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document and benchmark item of which a window occurs in the document.

    windows of item_windows occur, between begin and end of the normalised
    text, the best with so many edits. Items shorter than a window count as one
    window. The benchmark is the stated query set: it is matched in blocks of
    bounded size, each in one pass over all documents. Null and empty texts
    match nothing; repeated rows give repeated results. No items give no rows.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    result = None
    for block in benchmark_blocks(benchmark):
        index = spark.sparkContext.broadcast(Index(block))
        found = rows.mapInArrow(_find(index), _LEAKS)
        result = found if result is None else result.union(found)
    return result if result is not None else spark.createDataFrame([], _LEAKS)


def _free_of(index, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = index.value
        for batch in batches:
            for part in slices(batch, column):
                keep = [not lookup.matches(code_points(normalised(t.as_py()))) for t in part.column(column)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return run


def without_leaks(documents: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents in which no benchmark window occurs; all columns and clean rows are kept."""
    column = documents.columns.index(text_col)
    for block in benchmark_blocks(benchmark):
        index = documents.sparkSession.sparkContext.broadcast(Index(block))
        documents = documents.mapInArrow(_free_of(index, column), documents.schema)
    return documents
