"""Token ids in Parquet: list columns, small encodings, row groups and page indexes.

Documents are range-partitioned by id, so file after file holds ascending ids.
Token lists are dictionary-encoded, ids and offsets delta-encoded (page version
2), and every page has its bounds in the column index: a reader of a few
documents or of the metadata alone touches few pages.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import shuffles_released
from .words import slices

CACHED_WORDS = 400_000  # pieces of one generation; a Python worker remembers two, so pieces in use stay
CACHED_UNITS = 80_000
LONGEST_CACHED = 64  # characters
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 128 << 10

_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
# fixed values: how byte-level BPE cuts a text before merging, and how it writes bytes as characters
_UNITS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_WRITTEN = {byte: 256 + i for i, byte in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
_BYTES = [chr(_WRITTEN.get(byte, byte)) for byte in range(256)]
_SPACE = _BYTES[32]
# Latin, Greek and Cyrillic: their letters and digits are the same in every Unicode version in use
_SETTLED = "\u0500"
_encoders: dict[str, "WordEncoder"] = {}


class _UnevenSpace(Exception):
    """A text holds more white space between two words than one space."""


class _Known(dict):
    """Ids by piece; a piece that is missing is asked for."""

    def __init__(self, new: Callable[[str], bytes]):
        self.new = new

    def __missing__(self, piece: str) -> bytes:
        return self.new(piece)


class WordEncoder:
    """Ids of whole texts by the tokenizers library, word by word where that is the same.

    A byte-level BPE never joins across one space between two non-spaces, so a
    text falls into pieces there, each beginning with its space. A piece falls
    further into the units that the library's own first cut makes; the model of
    the library encodes each unit, and repeated units and pieces once. Texts
    with special tokens, pieces in scripts whose letters differ between Unicode
    versions, and tokenizers that work otherwise, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [x["content"] for x in rules.get("added_tokens") or []]
        pre = rules.get("pre_tokenizer") or {}
        self.by_word = (
            rules.get("normalizer") is None
            and rules["model"]["type"] == "BPE"
            and not rules["model"].get("dropout")
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
        )
        self.units: dict[str, bytes] = {}
        self.known = _Known(self._new)
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype=np.uint32).tobytes()

    def _tokens(self, written: str) -> bytes:
        """Ids of a unit, written as the vocabulary writes its bytes."""
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _unit(self, unit: str) -> bytes:
        ids = self.units.get(unit)
        if ids is None:
            ids = self.units[unit] = self._tokens("".join([_BYTES[b] for b in unit.encode()]))
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of a space and letters."""
        ids = self.known.get(word) or self.older.get(word)  # get() does not ask
        if ids is None:
            ids = self._tokens(_SPACE + (word if word.isascii() else "".join([_BYTES[b] for b in word.encode()])))
            self.known[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        """Ids of a space and a piece that neither begins nor ends with white space."""
        if not (piece.isascii() or max(piece) < _SETTLED):
            return self.whole(" " + piece)
        if piece.isalpha():
            return self._word(piece)
        word, last = piece[:-1], piece[-1]
        if last in ",.;:!?" and word.isalpha():
            return self._word(word) + self._unit(last)
        return b"".join(map(self._unit, _UNITS.findall(" " + piece)))

    def _new(self, piece: str) -> bytes:
        """Ids of a piece that is not known yet; it is known from now on, unless it is long."""
        ids = self.older.get(piece)
        if ids is None:
            if not piece or piece[0].isspace() or piece[-1].isspace():
                raise _UnevenSpace
            if len(piece) > LONGEST_CACHED:
                return self.whole(" " + piece)
            ids = self._piece(piece)
        self.known[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self.whole(t) for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.older, self.known = self.known, _Known(self._new)
        if len(self.units) > CACHED_UNITS:
            self.units = {}
        return [self.whole(t) if any(s in t for s in self.special) else self._joined(t) for t in texts]

    def _joined(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return self.whole(first) + b"".join(map(self.known.__getitem__, rest))
            except _UnevenSpace:
                pass
        first, *rest = _BOUNDARY.split(text)
        parts = [self.whole(first)]
        parts += [self.whole(" " + piece) if " " in piece or piece[-1].isspace() else self.known[piece] for piece in rest]
        return b"".join(parts)


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


_FILE_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens int, ids array<int>"


def _encode(path: str, end_id: int):
    end = np.array([end_id], dtype=np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = _encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, 1):
                texts = [t or "" for t in piece.column(1).to_pylist()]
                rows = [ids + end for ids in encoder.encode(texts)]
                ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])])
                flat = np.frombuffer(b"".join(rows), dtype=np.int32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": piece.column(0),
                        "part": pa.array(np.full(len(rows), part, np.int32)),
                        "start_in_part": pa.array(start + ends[:-1]),
                        "n_tokens": pa.array(np.diff(ends).astype(np.int32)),
                        "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)),
                    }
                )
                start += int(ends[-1])

    return run


def write_token_files(
    documents: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every whole text and write the files in ascending id order; action.

    A null text counts as empty and has the end id alone. Rows without id come
    first; rows repeating an id stand together, ordered by text. tokenizer_path
    must name the same file on every executor. Other columns are not written.
    """
    ordered = (
        documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    writer = (
        ordered.mapInArrow(_encode(tokenizer_path, end_id), _FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#start_in_part", "false")
    )
    with shuffles_released(documents.sparkSession):
        writer.parquet(path)


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents with low <= id <= high (all by default).

    start counts the ids of all documents before, over all files; it comes from
    the token counts per file, of which there are few. Columns that the caller
    drops are not read, and bounds reach the page index.
    """
    rows = spark.read.schema(_FILE_SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    return rows.join(bases, "part").select(
        "doc_id",
        (F.col("base") + F.col("start_in_part")).alias("start"),
        F.col("n_tokens").cast("long").alias("n_tokens"),
        "ids",
    )


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        ends = ids.offsets.to_numpy().tolist()
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).view(np.uint8))
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())],
            names=["doc_id", "part", "row", "ids_crc32"],
        )


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian uint32), from the files."""
    rows = spark.read.schema(_FILE_SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    sums = rows.select("doc_id", "part", F.struct("start_in_part", "n_tokens").alias("row"), "ids").mapInArrow(
        _checksums, "doc_id long, part int, row struct<start_in_part: long, n_tokens: int>, ids_crc32 long"
    )
    return sums.join(bases, "part").select(
        "doc_id",
        (F.col("base") + F.col("row.start_in_part")).alias("start"),
        F.col("row.n_tokens").cast("long").alias("n_tokens"),
        "ids_crc32",
    )
