"""Word hashes of Arrow text batches, computed on the UTF-8 bytes by numpy.

A word is a run of bytes that are no separators, A-Z lower-cased. Its 64-bit
hash is a sum of random byte values times powers of an odd number, so all words
of a batch come from one running sum. Texts may be null (as empty), empty or
longer than a slice; words never cross texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\v\f\r"
SLICE_BYTES = 1 << 20

_random = np.random.default_rng(20240501)
_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(base: int, size: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < size:
        steps = np.full(max(size, SLICE_BYTES + (1 << 16)), base, dtype=np.uint64)
        steps[0] = 1
        table = np.multiply.accumulate(steps)
        if size <= SLICE_BYTES + (1 << 16):
            _powers[base] = table
    return table


def separators(extra_ascii_punctuation: bool = False) -> np.ndarray:
    """Table over bytes: True where a byte ends a word."""
    table = np.zeros(256, dtype=bool)
    table[list(SPACES)] = True
    if extra_ascii_punctuation:
        table[[b for b in range(128) if not chr(b).isalnum()]] = True
    return table


PLAIN = separators()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each text begins (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text, one row at least."""
    _, ends = text_bytes(batch.column(column))
    row = 0
    while row < len(batch):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + most, "right")) - 1)
        yield batch.slice(row, stop - row)
        row = stop


def word_spans(raw: np.ndarray, bounds: np.ndarray, ends_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~ends_word[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)  # before which bytes a text begins or ends
    cut[bounds] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    last[:-1] &= ~word[1:] | cut[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(
    column: pa.Array, ends_word: np.ndarray = PLAIN
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, where each text's words begin, and the words' spans."""
    raw, bounds = text_bytes(column)
    first, end = word_spans(raw, bounds, ends_word)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64), first, end
    up, down = _power_table(_FACTOR, len(raw) + 1), _power_table(_INVERSE, len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[_LOWER[raw]] * up[: len(raw)], out=total[1:])
    hashes = mix((total[end] - total[first]) * down[first])
    return hashes, np.searchsorted(first, bounds), first, end
