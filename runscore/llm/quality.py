"""Quality classifier: random Fourier features of document statistics.

The features approximate a Gaussian kernel, so ridge regression on them is
kernel ridge regression whose normal equations are sums over rows: every
partition sums its own and only the sums meet. Texts held back from the fit
calibrate the scores by isotonic regression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .isotonic import calibrate, isotonic_blocks
from .store import Scratch
from .toxic_passages import labelled_sample
from .words import PLAIN, slices, text_bytes, word_hashes

MOST_LABELLED = 200_000  # labelled texts that the model is fitted on at most
FEATURES = 384
RIDGE = 1.0
SUM_PARTS = 16  # partitions that sum the normal equations

_CLASSES = ["upper", "digit", "blank", "line_end", "stop", "exclaim", "symbol", "beyond_ascii"]
_CLASS = np.full(256, 255, dtype=np.uint8)
_CLASS[65:91] = 0
_CLASS[48:58] = 1
_CLASS[[32, 9]] = 2
_CLASS[[10, 13]] = 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[ord("!")] = 5
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_CLASS[128:] = 7
STATISTICS = [
    "log_words", "word_length", "word_length_spread", *_CLASSES, "distinct", "distinct_for_length",
    "commonest", "repeated_next", "ends_in_symbol", "only_symbol", "log_line_length", "capital_words",
]


def statistics(column: pa.Array) -> np.ndarray:
    """The STATISTICS of each text; all zero for a text without bytes."""
    raw, at = text_bytes(column)
    hashes, bounds, first, end = word_hashes(column, PLAIN)
    size = np.maximum(np.diff(at), 1).astype(float)
    words = np.diff(bounds)
    some = np.maximum(words, 1).astype(float)

    def per_text(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return total[edges[1:]] - total[edges[:-1]]

    kind = _CLASS[raw]
    out = np.zeros((len(column), len(STATISTICS)))
    length = (end - first).astype(float)
    mean = per_text(length, bounds) / some
    out[:, 0] = np.log1p(words)
    out[:, 1] = np.log1p(mean)
    out[:, 2] = np.log1p(np.sqrt(np.maximum(per_text(length * length, bounds) / some - mean * mean, 0)))
    counts = [per_text(kind == c, at) for c in range(len(_CLASSES))]
    for c, n in enumerate(counts):
        out[:, 3 + c] = np.sqrt(n / size)
    k = 3 + len(_CLASSES)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b > a:
            _, times = np.unique(hashes[a:b], return_counts=True)
            out[i, k] = len(times) / (b - a)
            out[i, k + 1] = len(times) / (b - a) ** 0.8
            out[i, k + 2] = times.max() / (b - a)
    same = np.zeros(len(hashes))
    if len(hashes) > 1:
        same[1:] = hashes[1:] == hashes[:-1]
        same[bounds[:-1][words > 0]] = 0
    out[:, k + 3] = per_text(same, bounds) / some
    if len(hashes):
        ends = (kind[end - 1] == 5) | (kind[end - 1] == 6)
        out[:, k + 4] = per_text(ends, bounds) / some
        out[:, k + 5] = per_text(ends & (end - first == 1), bounds) / some
        capital = (kind[first] == 0) & ((kind[np.minimum(first + 1, len(raw) - 1)] == 0) & (end - first > 1))
        out[:, k + 7] = per_text(capital, bounds) / some
    out[:, k + 6] = np.log1p(size / (counts[3] + 1))
    out[np.diff(at) == 0] = 0
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            values = statistics(part.column(1))
            ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "statistics"])


def document_statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every row's whole text."""
    return documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(_measure, "doc_id long, statistics array<double>")


@dataclass
class Quality:
    """A fitted model of fixed size."""

    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    centres: np.ndarray | None = None
    chances: np.ndarray | None = None

    def features(self, values: np.ndarray) -> np.ndarray:
        scaled = np.clip((values - self.mean) / self.spread, -5, 5)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(scaled @ self.directions + self.phases)
        return np.hstack([waves, np.ones((len(values), 1))])

    def raw(self, values: np.ndarray) -> np.ndarray:
        return self.features(values) @ self.weights

    def score(self, values: np.ndarray) -> np.ndarray:
        return calibrate(self.raw(values), self.centres, self.chances)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), len(STATISTICS))


def fit_quality(measured: DataFrame, labels: DataFrame, label: str = "quality") -> Quality:
    """Fit on folds 0 and 1, calibrate on fold 3 (fold: crc32 of the id as text, mod 4); action.

    measured comes from document_statistics. About MOST_LABELLED labelled rows
    are used at most. Without labels every text scores 0.5.
    """
    width = len(STATISTICS)
    random = np.random.default_rng(11)
    model = Quality(
        np.zeros(width), np.ones(width), random.normal(0, 1.5 / np.sqrt(width), (width, FEATURES)),
        random.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5),
    )
    scratch = Scratch(measured.sparkSession, "quality")
    known = scratch.keep(
        measured.join(labelled_sample(labels, label, MOST_LABELLED), "doc_id").select("statistics", "label", "fold"), "known"
    )
    train = known.where("fold != 3")
    moments = train.agg(
        F.count("*").alias("n"),
        *[F.avg(F.col("statistics")[i]).alias(f"m{i}") for i in range(width)],
        *[F.stddev_pop(F.col("statistics")[i]).alias(f"s{i}") for i in range(width)],
    ).first()
    if not moments["n"]:
        return model
    model.mean = np.array([moments[f"m{i}"] for i in range(width)])
    model.spread = np.maximum(np.array([moments[f"s{i}"] for i in range(width)]), 1e-6)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            if len(batch):
                z = model.features(_matrix(batch.column(0)))
                gram += z.T @ z
                right += z.T @ batch.column(1).to_numpy().astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([right.tobytes()])], names=["gram", "rhs"])

    gram, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
    parts = train.select("statistics", "label").coalesce(SUM_PARTS).mapInArrow(sums, "gram binary, rhs binary")
    for row in parts.collect():
        gram += np.frombuffer(row["gram"]).reshape(gram.shape)
        right += np.frombuffer(row["rhs"])
    penalty = np.full(FEATURES + 1, RIDGE)
    penalty[-1] = 1e-6
    model.weights = np.linalg.solve(gram + np.diag(penalty), right)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.round(model.raw(_matrix(batch.column(0))) * 200)), batch.column(1).cast(pa.int64())],
                    names=["bin", "label"],
                )

    bins = (
        known.where("fold = 3")
        .select("statistics", "label")
        .mapInArrow(raw, "bin double, label long")
        .groupBy("bin")
        .agg(F.count("*").alias("n"), F.sum("label").alias("positive"))
        .toPandas()
        .sort_values("bin")
    )
    if len(bins):
        model.centres, model.chances = isotonic_blocks(
            bins["bin"].to_numpy(float) / 200, bins["n"].to_numpy(float), bins["positive"].to_numpy(float)
        )
    scratch.drop("known")
    return model


def score_quality(measured: DataFrame, model: Quality) -> DataFrame:
    """doc_id and score (0 to 1, higher is better) of every measured row."""
    shared = measured.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                score = shared.value.score(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return measured.select("doc_id", "statistics").mapInArrow(run, "doc_id long, score double")


def classify_quality(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and score of every row; fits on the labels; action.

    Null and empty texts have statistics of zero and are scored like any other.
    """
    scratch = Scratch(documents.sparkSession, "quality-statistics")
    measured = scratch.keep(document_statistics(documents, id_col, text_col), "measured")
    return score_quality(measured, fit_quality(measured, labels))
