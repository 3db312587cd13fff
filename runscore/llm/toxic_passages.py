"""Toxic passages by maximum-scoring segments of token log-odds.

Tokens get the log-odds of toxic against other labelled texts with an
informative Dirichlet prior (the pooled token counts). A token counts if its
likelihood ratio is higher than chance explains, given how many tokens are
tried; all others score a small loss. A linear scan finds all maximal scoring
segments of a text. Segment scores of clean texts follow an extreme-value law
whose location grows with the logarithm of the length; in its units the
significant segments of a text are added up (sum statistics of the law), and
labelled texts turn that evidence into a probability. The evidence of a labelled
text comes from a model that has not seen its fold, so that every learnable
label serves the counts as well as the calibration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .isotonic import calibrate, isotonic_blocks
from .store import Scratch
from .words import separators, slices, word_hashes

MOST_LABELLED = 200_000  # labelled texts that the model is fitted on at most
MOST_TOKENS = 100_000  # significant tokens that a model keeps at most
CHANCE = 6.0  # a token's likelihood ratio may stay so far under 2 ln(tokens): a few tokens get in by chance
PRIOR_TEXTS = 10.0  # weight of the prior, in texts
LOSS = 0.7  # of every token without significant log-odds
HIGHEST_ODDS = 8.0
NO_SEGMENT = -125.0  # evidence of a text without any toxic token
LAW_TEXTS = 20.0  # weight of the unit law against the fitted one, in texts
FOLDS = (0, 1, 3)  # of ids that models may learn from
EULER = 0.5772156649015329
_ENDS_TOKEN = separators(extra_ascii_punctuation=True)


def maximal_segments(scores: list[float], gaps: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of signed scores, in linear time.

    gaps[i] is the sum of the negative scores between score i - 1 and score i,
    so runs of equal losses need no steps of their own.
    """
    total = 0.0
    stack: list[list] = []  # first, last, sum before, sum after
    for i, (score, gap) in enumerate(zip(scores, gaps)):
        total += gap
        if score <= 0:
            total += score
            continue
        segment = [i, i, total, total + score]
        total += score
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= segment[2]:
                k -= 1
            if k < 0 or stack[k][3] >= segment[3]:
                stack.append(segment)
                break
            segment = [stack[k][0], segment[1], stack[k][2], segment[3]]
            del stack[k:]
    return [(a, b, after - before) for a, b, before, after in stack]


@dataclass
class Passages:
    """A fitted model; its size is bounded by MOST_TOKENS."""

    tokens: np.ndarray  # hashes, ascending
    odds: np.ndarray
    scale: float = 1.0  # of the extreme-value law
    location: float = 0.0
    edges: np.ndarray | None = None  # calibration: evidence and probability
    chances: np.ndarray | None = None

    def segments(self, hashes: np.ndarray) -> list[tuple[int, int, float]]:
        """Maximal segments over token positions (first, last, score)."""
        if not len(self.tokens) or not len(hashes):
            return []
        at = np.searchsorted(self.tokens, hashes)
        at[at == len(self.tokens)] = 0
        hit = np.flatnonzero(self.tokens[at] == hashes)
        odds = self.odds[at[hit]]
        if not (odds > LOSS).any():
            return []
        scores = (odds - LOSS).tolist()
        gaps = (-LOSS * (np.diff(hit, prepend=-1) - 1)).tolist()
        return [(int(hit[a]), int(hit[b]), s) for a, b, s in maximal_segments(scores, gaps)]

    def evidence(self, segments: list[float], words: int) -> float:
        """Minus the log-probability of the segments' scores in a clean text of that length.

        The scores in units of the law are added up from the highest on; the sum
        that is least likely by chance counts, each further segment at the price
        of a factor of two.
        """
        if not segments:
            return NO_SEGMENT
        length = log(max(words, 1))
        best, total = -np.inf, 0.0
        for r, score in enumerate(sorted(segments, reverse=True), 1):
            total += (score - self.location) / self.scale - length
            if r == 1:
                best = total
            elif total > 0:
                found = total - (r - 1) * log(total) + lgamma(r + 1) + lgamma(r) - (r - 1) * log(2)
                best = max(best, found)
        return max(float(best), NO_SEGMENT + 1)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return calibrate(evidence, self.edges, self.chances)


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text, toxic, fold: in how many texts of each class and fold a token is, per batch."""
    names = [f"{kind}{fold}" for fold in FOLDS for kind in ("toxic", "other")]
    for batch in batches:
        seen: list[np.ndarray] = []
        kinds: list[np.ndarray] = []
        for part in slices(batch, 0):
            hashes, bounds, _, _ = word_hashes(part.column(0), _ENDS_TOKEN)
            for k, (label, fold) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                own = np.unique(hashes[bounds[k] : bounds[k + 1]])
                seen.append(own)
                kinds.append(np.full(len(own), 2 * FOLDS.index(fold) + (not label), dtype=np.int64))
        if not seen:
            continue
        token, inverse = np.unique(np.concatenate(seen), return_inverse=True)
        kind = np.concatenate(kinds)
        columns = {"token": pa.array(token.view(np.int64))}
        for n, name in enumerate(names):
            columns[name] = pa.array(np.bincount(inverse[kind == n], minlength=len(token)).astype(np.int64))
        yield pa.RecordBatch.from_pydict(columns)


def _segments(batches: Iterator[pa.RecordBatch], column: int, model_of) -> Iterator[pa.RecordBatch]:
    """What else each batch has, the scores of each text's segments, and its number of words.

    model_of(batch) gives the model of every row of a slice.
    """
    for batch in batches:
        for part in slices(batch, column):
            hashes, bounds, _, _ = word_hashes(part.column(column), _ENDS_TOKEN)
            models = model_of(part)
            known = np.isin(hashes, np.unique(np.concatenate([m.tokens[m.odds > LOSS] for m in {id(m): m for m in models}.values()])))
            hits = np.diff(np.concatenate([[0], np.cumsum(known)])[bounds])
            found = [
                [s for _, _, s in models[k].segments(hashes[bounds[k] : bounds[k + 1]])] if hits[k] else []
                for k in range(len(part))
            ]
            rest = [c for i, c in enumerate(part.columns) if i != column]
            names = [n for i, n in enumerate(part.schema.names) if i != column]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(found, pa.list_(pa.float64())), pa.array(np.diff(bounds))], names=[*names, "segments", "words"]
            )


def _best(model: Passages, column: int):
    """Appends evidence, best segment and number of segments of each text to what else the batch has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _segments(batches, column, lambda rows: [model] * len(rows)):
            found, words = part.column("segments").to_pylist(), part.column("words").to_pylist()
            evidence = [model.evidence(s, n) for s, n in zip(found, words)]
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[:-2], pa.array(evidence, pa.float64()),
                    pa.array([max(s, default=0.0) for s in found], pa.float64()), pa.array([len(s) for s in found], pa.int32()),
                ],
                names=[*part.schema.names[:-2], "evidence", "best_segment", "segments"],
            )

    return run


def labelled_sample(labels: DataFrame, label: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of labelled ids outside the held-out fold, about `most` of them at most.

    The held-out fold is crc32(id as text) mod 4 = 2. Ids labelled more than
    once have the larger label; null ids and labels are left out.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("doc_id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4)
        .where("fold != 2")
    )
    share = min(1.0, most / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))


def _log_odds(counts: DataFrame, folds: tuple[int, ...], sizes: dict[tuple[int, int], int]) -> Passages:
    """Tokens whose presence goes with toxic texts of the folds, with their log-odds; action."""
    toxic = float(sum(sizes.get((f, 1), 0) for f in folds))
    other = float(sum(sizes.get((f, 0), 0) for f in folds))
    model = Passages(np.zeros(0, np.uint64), np.zeros(0), edges=np.zeros(1), chances=np.zeros(1))
    if not toxic or not other:
        return model
    held = counts.select(
        "token",
        sum((F.col(f"toxic{f}") for f in folds), F.lit(0)).cast("double").alias("a"),
        sum((F.col(f"other{f}") for f in folds), F.lit(0)).cast("double").alias("b"),
    ).where("a + b > 0")
    tokens = held.count()
    whole, all_texts = F.col("a") + F.col("b"), toxic + other

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    # likelihood ratio of two rates against one
    ratio = 2 * (
        term(F.col("a"), whole * toxic / all_texts)
        + term(F.col("b"), whole * other / all_texts)
        + term(toxic - F.col("a"), (all_texts - whole) * toxic / all_texts)
        + term(other - F.col("b"), (all_texts - whole) * other / all_texts)
    )
    pooled = PRIOR_TEXTS * whole / all_texts
    in_toxic, in_other = F.col("a") + pooled, F.col("b") + pooled
    odds = F.log(in_toxic / (toxic + PRIOR_TEXTS - in_toxic)) - F.log(in_other / (other + PRIOR_TEXTS - in_other))
    chosen = (
        held.where(F.col("a") * other > F.col("b") * toxic)
        .withColumns({"ratio": ratio, "odds": odds})
        .where(F.col("ratio") >= 2 * log(max(tokens, 1)) - CHANCE)
        .orderBy(F.desc("ratio"), "token")
        .limit(MOST_TOKENS)
        .select("token", "odds")
        .toPandas()
    )
    hashes = chosen["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    model.tokens = hashes[order]
    model.odds = np.clip(chosen["odds"].to_numpy(np.float64)[order], -HIGHEST_ODDS, HIGHEST_ODDS)
    return model


def fit_passages(
    documents: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Passages:
    """Fit token log-odds, law and calibration on folds 0, 1 and 3 by cross-fitting; action.

    At most about MOST_LABELLED labelled texts are read, by a broadcast of
    their ids. Without labels of both classes every text scores 0; without
    them in a fold and in the rest alike, the same. Null texts count as empty,
    repeated rows as often as they come.
    """
    spark = documents.sparkSession
    sample = labelled_sample(labels, label, MOST_LABELLED)
    texts = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).join(F.broadcast(sample), "doc_id")
    scratch = Scratch(spark, "toxic-passages")
    sizes = {
        (r["fold"], r["label"]): r["n"]
        for r in texts.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()
    }
    names = [f"{kind}{fold}" for fold in FOLDS for kind in ("toxic", "other")]
    counts = scratch.keep(
        texts.select("text", F.col("label").cast("long"), F.col("fold").cast("long"))
        .mapInArrow(_token_counts, "token long, " + ", ".join(f"{n} long" for n in names))
        .groupBy("token")
        .agg(*[F.sum(n).alias(n) for n in names]),
        "counts",
    )
    model = _log_odds(counts, FOLDS, sizes)
    if not len(model.tokens):
        scratch.drop("counts")
        return model
    without = spark.sparkContext.broadcast(
        {f: _log_odds(counts, tuple(g for g in FOLDS if g != f), sizes) for f in FOLDS}
    )

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _segments(batches, 2, lambda rows: [without.value[f] for f in rows.column(1).to_pylist()])

    held = scratch.keep(
        texts.select(F.col("label").cast("long"), F.col("fold").cast("long"), "text")
        .mapInArrow(crossed, "label long, fold long, segments array<double>, words long"),
        "held",
    )
    # in clean texts the best segment less ln(words) follows the law; its moments are shrunk to the unit law's
    best = F.array_max("segments") - F.log(F.greatest("words", F.lit(1)))
    clean = held.where("label = 0 and size(segments) > 0").agg(
        F.avg(best).alias("mean"), F.stddev_pop(best).alias("sd"), F.count("*").alias("n")
    ).first()
    n, spread = clean["n"], (clean["sd"] or 0.0) * np.sqrt(6) / np.pi
    model.scale = float((n * spread + LAW_TEXTS) / (n + LAW_TEXTS))
    model.location = float(n * ((clean["mean"] or 0.0) - EULER * model.scale) / (n + LAW_TEXTS))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.evidence(s, w) for s, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["label", "evidence"])

    bins = (
        held.select("label", "segments", "words")
        .mapInArrow(weighed, "label long, evidence double")
        .groupBy(F.round(F.greatest(F.least("evidence", F.lit(100.0)), F.lit(NO_SEGMENT)) * 4).alias("bin"))
        .agg(F.count("*").alias("n"), F.sum("label").alias("positive"))
        .toPandas()
        .sort_values("bin")
    )
    without.unpersist()
    scratch.drop("counts", "held")
    model.edges, model.chances = isotonic_blocks(
        bins["bin"].to_numpy(float) / 4, bins["n"].to_numpy(float), bins["positive"].to_numpy(float)
    )
    return model


def score_toxicity(
    documents: DataFrame, model: Passages, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, score (0 to 1), best_segment and segments of every row's whole text.

    Null and empty texts have no segment and score like texts without one.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _best(shared.value, 1)(batches):
            score = shared.value.score(part.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(score), part.column(2), part.column(3)],
                names=["doc_id", "score", "best_segment", "segments"],
            )

    return rows.mapInArrow(run, "doc_id long, score double, best_segment double, segments int")


def toxic_spans(documents: DataFrame, model: Passages, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """doc_id, begin, end, score, passage of every segment that alone would score `least`.

    begin and end are byte offsets in the UTF-8 text.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            out: list[tuple] = []
            for part in slices(batch, 1):
                hashes, bounds, first, end = word_hashes(part.column(1), _ENDS_TOKEN)
                at = 0
                for k, (doc, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    raw = (text or "").encode()
                    a, b = bounds[k], bounds[k + 1]
                    for i, j, s in fitted.segments(hashes[a:b]):
                        if fitted.score(np.array([fitted.evidence([s], int(b - a))]))[0] >= least:
                            begin, stop = int(first[a + i]) - at, int(end[a + j]) - at
                            out.append((doc, begin, stop, s, raw[begin:stop].decode()))
                    at += len(raw)
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "begin", "end", "score", "passage"]
            )

    return rows.mapInArrow(run, "doc_id long, begin long, end long, score double, passage string")


def without_toxic(
    documents: DataFrame, model: Passages, least: float = 0.3, text_col: str = "text"
) -> DataFrame:
    """The rows that score under `least`, all columns kept."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    column = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                texts = pa.RecordBatch.from_arrays([part.column(column)], names=["text"])
                evidence = np.concatenate([b.column(0).to_numpy() for b in _best(shared.value, 0)(iter([texts]))])
                yield part.filter(pa.array(shared.value.score(evidence) < least))

    return documents.mapInArrow(run, documents.schema)
