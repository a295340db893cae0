"""Exact top-k by inner product with a pivot-distance index.

A vector gets one more component that makes all norms equal, so the largest
inner products are the smallest distances.  Every vector is keyed by its
nearest pivot and its distance to it, and the table is sorted by that key.  A
query looks at the ring of its own distance first, then at the rings around it,
and stops in both directions where the triangle inequality leaves no better
score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trailgraph.llm.common import workspace

SCALE = 1024
#: Pivots, drawn by hash; a bounded sample that only steers the search.
PIVOTS = 128
#: Vectors of a ring that are compared at once.
RING = 256
#: Queries that one pass over the index takes along.
QUERY_ROWS = 8192
#: No score.
NONE = -np.iinfo(np.int64).max
_VECTOR = "vec_id bigint, v array<bigint>"


def integer_vectors(rows: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """``(vec_id, v)``: floor(scale * x) of every component; vectors that are
    null or hold null or non-finite components, or have no id, take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for number, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                if number is None or not vector.is_valid or vector.values.null_count:
                    continue
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    whole = np.floor(scale * x)
                    if len(x) and np.abs(whole).max() >= 2.0**63:
                        raise ValueError("components beyond 64 bits")
                    ids.append(number)
                    found.append(whole.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["vec_id", "v"]
            )

    return rows.select(F.col(vec_id).cast("bigint"), F.col(embedding)).mapInArrow(run, _VECTOR)


def _matrix(column: pa.Array, width: int, kind=np.float64) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    lists = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.array([len(v) for v in column]) if len(column) else np.zeros(0, int)
    if (sizes == width).all():
        return lists.reshape(-1, width).astype(kind)
    out = np.zeros((len(sizes), width), kind)
    place = np.arange(len(lists)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), place] = lists
    return out


class Metric:
    """Distances in the space where all vectors of the index have norm ``norm``."""

    def __init__(self, pivots: np.ndarray, norm2: float):
        self.pivots, self.norm2 = pivots, norm2
        self.lift = np.sqrt(np.maximum(norm2 - (pivots**2).sum(axis=1), 0))
        # squared distances are off by some roundings of sums as large as norm2
        self.off = 2 * np.sqrt(16 * (pivots.shape[1] + 8) * np.finfo(np.float64).eps * norm2)

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        lift = np.sqrt(np.maximum(self.norm2 - (x**2).sum(axis=1), 0))
        inner = x @ self.pivots.T + np.outer(lift, self.lift)
        return np.sqrt(np.maximum(2 * self.norm2 - 2 * inner, 0))

    def of_queries(self, scores: np.ndarray, query2: np.ndarray) -> np.ndarray:
        """Distances from inner products; a query is not lifted."""
        return np.sqrt(np.maximum(query2[:, None] + self.norm2 - 2 * scores, 0))


class Search:
    """The best candidates of a block of queries, as rings go by.

    ``queries`` and candidates are whole numbers: as doubles where every score
    is below 2^53, as 64-bit integers otherwise.  Scores are 64-bit integers.
    """

    def __init__(self, ids: np.ndarray, queries: np.ndarray, metric: Metric, pivots: np.ndarray, pivot_ids: np.ndarray,
                 k: int):
        self.ids, self.queries, self.metric, self.k = ids, queries, metric, k
        self.square = (queries.astype(np.float64) ** 2).sum(axis=1)
        to_pivots = (queries @ pivots.T).astype(np.int64)
        self.distance = metric.of_queries(to_pivots.astype(np.float64), self.square)
        # pivots are candidates too: their k-th best score bounds the result
        known = np.where(pivot_ids[None, :] == ids[:, None], NONE, to_pivots)
        self.least = np.full(len(ids), NONE)
        if known.shape[1] >= k:
            self.least = np.sort(known, axis=1)[:, -k]
        self.best = np.full((len(ids), k), NONE)
        self.best_ids = np.full((len(ids), k), np.iinfo(np.int64).max)

    def radius(self, some: np.ndarray) -> np.ndarray:
        least = np.where(self.least[some] == NONE, -np.inf, self.least[some].astype(np.float64))
        far = self.square[some] + self.metric.norm2 - 2 * least
        return np.sqrt(np.maximum(far, 0)) * (1 + 1e-9) + 1e-6 + 2 * self.metric.off

    def rings(self, pivot: int, distance: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Look through the vectors of one pivot, sorted by distance."""
        starts = np.arange(0, len(ids), RING)
        low, high = distance[starts], distance[np.minimum(starts + RING, len(ids)) - 1]
        mine = self.distance[:, pivot]
        home = np.clip(np.searchsorted(low, mine, side="right") - 1, 0, len(starts) - 1)
        inward = outward = np.arange(len(self.ids))
        for step in range(len(starts)):
            inward = inward[home[inward] >= step]
            outward = outward[home[outward] + step < len(starts)] if step else outward[:0]
            for queries, ring in ((inward, home[inward] - step), (outward, home[outward] + step)):
                gap = np.maximum(low[ring] - mine[queries], mine[queries] - high[ring])
                near = gap <= self.radius(queries)
                self._visit(queries[near], ring[near], starts, ids, x)
            # rings farther out are no nearer, so a query that has stopped stays so
            gap = mine[inward] - high[home[inward] - step]
            inward = inward[gap <= self.radius(inward)]
            if step:
                gap = low[home[outward] + step] - mine[outward]
                outward = outward[gap <= self.radius(outward)]
            else:
                outward = np.arange(len(self.ids))
            if not len(inward) and not len(outward):
                break

    def _visit(self, queries: np.ndarray, ring: np.ndarray, starts, ids, x) -> None:
        order = np.argsort(ring, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(ring[order])) + 1):
            if not len(some):
                continue
            start = starts[ring[some[0]]]
            there = ids[start : start + RING]
            asking = queries[some]
            scores = (self.queries[asking] @ x[start : start + RING].T).astype(np.int64)
            scores[there[None, :] == self.ids[asking][:, None]] = NONE
            better = (scores >= self.least[asking][:, None]).any(axis=1)
            asking, scores = asking[better], scores[better]
            if len(asking):
                every = np.hstack([self.best[asking], scores])
                names = np.hstack([self.best_ids[asking], np.broadcast_to(there, scores.shape)])
                top = np.lexsort((names, -every), axis=1)[:, : self.k]
                self.best[asking] = np.take_along_axis(every, top, 1)
                self.best_ids[asking] = np.take_along_axis(names, top, 1)
                self.least[asking] = np.maximum(self.least[asking], self.best[asking, -1])

    def found(self) -> pa.RecordBatch:
        query, place = np.nonzero((self.best != NONE) & (self.best >= self.least[:, None]))
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[query]), pa.array(self.best_ids[query, place]),
             pa.array(self.best[query, place])],
            names=["query_id", "vec_id", "score"],
        )


def exact_top_k(
    rows: DataFrame, is_query, *, vec_id="vec_id", embedding="embedding", k: int = 10,
    scale: int = SCALE, pivots: int = PIVOTS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best of all other vectors
    for each vector with ``is_query(column)``, ties to the smaller id.

    Rows that share an id are one vector, the smallest.  Shorter vectors count
    as ending in zeros.  With fewer than ``k`` others, all are returned; an empty
    table gives no rows.  Scores are exact; those that could pass 64 bits are an
    error.  Queries go in blocks of about ``query_rows``, each a
    pass over the sorted index; nothing but a block and the pivots is broadcast.
    """
    spark = rows.sparkSession
    space = workspace(spark, "top-k")
    vectors = space.write(
        "vectors",
        integer_vectors(rows, vec_id, embedding, scale).groupBy("vec_id").agg(F.min("v").alias("v")),
        width=F.max(F.size("v")), rows=F.count(F.lit(1)),
        norm2=F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)),
    )
    empty = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not vectors.observed["rows"]:
        return spark.createDataFrame([], empty)
    width = max(1, vectors.observed["width"])
    drawn = vectors.df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    norm2 = vectors.observed["norm2"] or 0.0
    if norm2 * (1 + 1e-9) >= 2.0**63:
        raise ValueError("scores beyond 64 bits")
    kind = np.int64 if norm2 * (1 + 1e-9) >= 2.0**53 else np.float64
    centres = np.zeros((len(drawn), width), kind)
    for number, row in enumerate(drawn):
        centres[number, : len(row["v"])] = row["v"]
    metric = Metric(centres.astype(np.float64), norm2)
    pivot_ids = np.array([row["vec_id"] for row in drawn], np.int64)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                distance = metric.to_pivots(_matrix(batch.column(1), width))
                nearest = distance.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nearest.astype(np.int32)), pa.array(distance.min(axis=1)), *batch.columns],
                    names=["pivot", "distance", "vec_id", "v"],
                )

    order = ["pivot", "distance", "vec_id"]
    keyed = space.write("keyed", vectors.df.mapInArrow(key, f"pivot int, distance double, {_VECTOR}")).df
    index = space.write("index", keyed.repartitionByRange(*order).sortWithinPartitions(*order)).df
    asked = index.filter(is_query("vec_id")).select("vec_id", "v")
    blocks = -(-asked.count() // query_rows)
    found = None
    for block in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id").collect()
        if some:
            part = _pass(index, some, metric, (centres, pivot_ids), width, k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], empty)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _pass(index: DataFrame, some: list, metric: Metric, drawn: tuple, width: int, k: int) -> DataFrame:
    kind = drawn[0].dtype
    queries = np.zeros((len(some), width), kind)
    for number, row in enumerate(some):
        queries[number, : len(row["v"])] = row["v"]
    ids = np.array([row["vec_id"] for row in some], np.int64)
    shared = index.sparkSession.sparkContext.broadcast((ids, queries, metric, *drawn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for batch in batches:
            if not batch.num_rows:
                continue
            search = search or Search(*shared.value, k)
            pivot = batch.column(0).to_numpy()
            x = _matrix(batch.column(3), width, kind)
            distance, ids = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            # a task may read several files of one pivot, in any order
            cuts = np.flatnonzero((np.diff(pivot) != 0) | (np.diff(distance) < 0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(pivot)]):
                search.rings(int(pivot[start]), distance[start:stop], ids[start:stop], x[start:stop])
        if search is not None:
            yield search.found()

    return index.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
