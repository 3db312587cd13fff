"""Exact top-k inner products by best-first search of M-tree pages.

Vectors are dealt to pages by their nearest routing object; inside a page, leaf
nodes of bounded size store a routing object, a covering radius, its distance to
the page's object and every entry's distance to it. For a query q and anything
within r of an object o, the inner product is at most q.o + |q| * r, and r
follows from the stored distances by the triangle inequality. Nodes are visited
in descending order of that bound and left when it falls under the k-th best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Scratch

PAGE_ROWS = 4096
LEAF_ROWS = 256
MOST_OBJECTS = 4096  # routing objects that deal vectors to pages
QUERY_BLOCK = 4096  # queries that one pass over the pages answers
EXACT_DOUBLE = 2.0**53


def _integers(scale: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for number, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                if number is None or not vector.is_valid or len(vector.values) != size or vector.values.null_count:
                    continue
                values = np.floor(scale * vector.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(values).all():
                    ids.append(number)
                    rows.append(values.astype(np.int64))
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            ends = np.arange(len(rows) + 1, dtype=np.int32) * size
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["vec_id", "v"]
            )

    return run


def _table(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), size)


def _nearest(objects: np.ndarray):
    half = (objects.astype(float) ** 2).sum(axis=1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                values = _table(batch.column(1), objects.shape[1]).astype(float)
                page = np.argmax(values @ objects.T.astype(float) - half, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(page.astype(np.int32))], names=["vec_id", "v", "page"]
                )

    return run


_NODES = (
    "page int, part long, object array<double>, page_object array<double>, radius double, "
    "parent_distance double, ids array<long>, distances array<double>, entries array<long>"
)


def _build_page(objects: np.ndarray):
    """The leaf nodes of one page: nearest of a few routing objects, then runs by distance."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        ids = rows["vec_id"].to_numpy(np.int64)
        values = np.stack(rows["v"].to_numpy())
        above = objects[int(key[0])].astype(float)
        real = values.astype(float)
        count = -(-len(ids) // (LEAF_ROWS // 2))
        chosen = real[np.linspace(0, len(ids) - 1, count).astype(int)]
        owner = np.argmax(real @ chosen.T - (chosen**2).sum(axis=1) / 2, axis=1)
        out = []
        for k in range(count):
            own = np.flatnonzero(owner == k)
            if not len(own):
                continue
            away = np.sqrt(((real[own] - chosen[k]) ** 2).sum(axis=1))
            own = own[np.argsort(away, kind="stable")]
            for begin in range(0, len(own), LEAF_ROWS):
                leaf = own[begin : begin + LEAF_ROWS]
                centre = real[leaf].mean(axis=0)
                distances = np.sqrt(((real[leaf] - centre) ** 2).sum(axis=1))
                out.append(
                    (
                        int(key[0]), int(key[1]), centre, above, float(distances.max()),
                        float(np.sqrt(((centre - above) ** 2).sum())), ids[leaf], distances, values[leaf].ravel(),
                    )
                )
        return pd.DataFrame(out, columns=[c.split()[0] for c in _NODES.split(", ")])

    return run


def build_index(scratch: Scratch, vectors: DataFrame, size: int, keep: int) -> DataFrame:
    """Leaf nodes over vectors(vec_id, v); action.

    Of equal vectors only the `keep` smallest ids can ever be in an answer;
    the others are left out before pages are formed.
    """
    same = Window.partitionBy("h1", "h2").orderBy("vec_id")
    distinct = (
        vectors.groupBy("vec_id", "v")
        .agg(F.least(F.count("*"), F.lit(keep)).cast("int").alias("times"))
        .withColumn("h1", F.xxhash64("v"))
        .withColumn("h2", F.xxhash64(F.lit(1), "v"))
        .withColumn("n", F.row_number().over(same))
        .where(F.col("n") <= keep)
        .select("vec_id", "v", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
        .select("vec_id", "v")
    )
    distinct = scratch.keep(distinct, "distinct")
    count = distinct.count()
    wanted = max(1, min(MOST_OBJECTS, -(-count // (PAGE_ROWS // 2))))
    sample = distinct.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).toPandas()
    if not len(sample):
        return vectors.sparkSession.createDataFrame([], _NODES)
    objects = np.stack(sample["v"].to_numpy())
    paged = scratch.keep(distinct.mapInArrow(_nearest(objects), "vec_id long, v array<long>, page int"), "paged")
    parts = paged.groupBy("page").agg(F.ceil(F.count("*") / F.lit(PAGE_ROWS)).alias("parts"))
    split = paged.join(parts, "page").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    return scratch.keep(
        split.select("page", "part", "vec_id", "v").groupBy("page", "part").applyInPandas(_build_page(objects), _NODES), "nodes"
    )


class Search:
    """Best-first search of a set of leaf nodes for a block of queries at once."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors.astype(float), k
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))
        self.exact = vectors
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, vec_id), ascending
        self.least = np.full(len(ids), -np.inf)  # k-th best score
        self.computed = 0

    def run(self, nodes: dict) -> None:
        pages, page_of = np.unique(nodes["page_object"], axis=0, return_inverse=True)
        to_page = self.vectors @ pages.T
        slack = nodes["parent_distance"] + nodes["radius"]
        bound = to_page[:, page_of.ravel()] + self.norms[:, None] * slack[None, :]  # stored distances only
        order = np.argsort(-bound, axis=1, kind="stable")
        rows = np.arange(len(self.ids))
        for step in range(order.shape[1]):
            node = order[:, step]
            alive = bound[rows, node] * (1 + 1e-9) + 1e-6 >= self.least
            if not alive.any():
                break
            for n in np.unique(node[alive]):
                self._visit(nodes, int(n), np.flatnonzero(alive & (node == n)))

    def _visit(self, nodes: dict, n: int, queries: np.ndarray) -> None:
        near = self.vectors[queries] @ nodes["object"][n]
        reach = near[:, None] + self.norms[queries][:, None] * nodes["distances"][n][None, :]
        open_ = reach * (1 + 1e-9) + 1e-6 >= self.least[queries][:, None]
        if not open_.any():
            return
        queries, open_ = queries[open_.any(axis=1)], open_[open_.any(axis=1)]
        columns = np.flatnonzero(open_.any(axis=0))
        ids, entries = nodes["ids"][n][columns], nodes["entries"][n][columns]
        self.computed += len(queries) * len(columns)
        largest = np.abs(entries).max() * float(np.abs(self.exact[queries]).max()) * entries.shape[1]
        if largest < EXACT_DOUBLE:
            scores = np.rint(self.vectors[queries] @ entries.T.astype(float)).astype(np.int64)
        else:
            scores = self.exact[queries] @ entries.T
        candidate = (scores >= self.least[queries][:, None]) & (ids[None, :] != self.ids[queries][:, None])
        for i in np.flatnonzero(candidate.any(axis=1)):
            q = queries[i]
            mine = self.best[q] + [(-int(scores[i, j]), int(ids[j])) for j in np.flatnonzero(candidate[i])]
            self.best[q] = sorted(mine)[: self.k]
            if len(self.best[q]) == self.k:
                self.least[q] = -self.best[q][-1][0]


def _search(queries, size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = queries.value
        search = Search(ids, vectors, k)
        for batch in batches:
            if not len(batch):
                continue
            names = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            entries = [np.asarray(x.values).reshape(-1, size) for x in names["entries"]]
            search.run(
                {
                    "object": _table(names["object"], size),
                    "page_object": _table(names["page_object"], size),
                    "radius": names["radius"].to_numpy(),
                    "parent_distance": names["parent_distance"].to_numpy(),
                    "ids": [np.asarray(x.values) for x in names["ids"]],
                    "distances": [np.asarray(x.values) for x in names["distances"]],
                    "entries": entries,
                }
            )
        found = [(q, int(ids[q]), -s, v) for q, best in enumerate(search.best) for s, v in best]
        columns = list(zip(*found)) if found else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["query", "query_id", "score", "vec_id"]
        )

    return run


def top_inner_products(
    vectors: DataFrame,
    queries: str = "vec_id % 50 = 0",
    k: int = 5,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query row; action.

    Components x become floor(scale * x). Candidates are all rows with another
    id; ties go to the smaller id. Vectors that are null or hold null or
    non-finite components take no part, nor do rows without id and vectors of
    another length than most. Rows repeating id and vector count as candidates
    as often as they come and as one query. Products must fit 64 bits.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "metric-tree")
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    lengths = (
        raw.where("vec_id is not null and x is not null and size(x) > 0").groupBy(F.size("x").alias("size"))
        .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    )
    result = "query_id long, rank int, vec_id long, score long"
    if not lengths:
        return spark.createDataFrame([], result)
    size = lengths[0]["size"]
    clean = scratch.keep(raw.mapInArrow(_integers(scale, size), "vec_id long, v array<long>"), "clean")
    nodes = build_index(scratch, clean, size, k + 1)
    asked = scratch.keep(clean.where(queries).distinct(), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toPandas()
        if not len(mine):
            continue
        shared = spark.sparkContext.broadcast((mine["vec_id"].to_numpy(np.int64), np.stack(mine["v"].to_numpy())))
        part = nodes.mapInArrow(_search(shared, size, k), "query long, query_id long, score long, vec_id long")
        part = part.withColumn("block", F.lit(block))
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], result)
    order = Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
