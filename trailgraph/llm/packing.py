"""Best-fit decreasing packing of token sequences.

Pieces of equal length are alike, so the packing is decided on the counts per
length, at most one per token of a sequence: from the longest on, a segment
tree over remaining capacities finds the tightest open sequences, and a whole
run of equal pieces is put there at once, exactly as if they came one by one.
Each piece then takes its place by its number among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trailgraph.llm.common import slices, workspace
from trailgraph.llm.token_cache import encoder

CAPACITY = 2048
#: Pieces numbered by one task at a time, about.
CHUNK_ROWS = 20_000
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class CapacityTree:
    """Which remaining capacities have open sequences: the tightest in log time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)

    def mark(self, capacity: int, open_: bool) -> None:
        node = self.leaves + capacity
        self.any[node] = open_
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] | self.any[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` with an open sequence."""
        node = self.leaves + least
        if self.any[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Places for ``counts[length]`` pieces of each length.

    Returns rows ``(length, first rank, first sequence, pieces per sequence,
    first offset)``: the pieces of a length from a rank on fill sequences one
    after another.  There are never more than ``capacity ** 2`` rows.
    """
    tree = CapacityTree(capacity)
    open_: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    rows = []
    sequences = 0

    def keep(left: int, first: int, count: int) -> None:
        if left and count:
            open_[left].append((first, count))
            tree.mark(left, True)

    for length in sorted(counts, reverse=True):
        rank, waiting = 0, counts[length]
        while waiting:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                first, count = sequences, -(-waiting // (capacity // length))
                sequences += count
            else:
                first, count = open_[room].pop()
                tree.mark(room, bool(open_[room]))
            each = room // length
            full = min(count, waiting // each)
            if not full:  # the last pieces share one sequence
                each, full = waiting, 1
            rows.append((length, rank, first, each, capacity - room))
            rank += each * full
            waiting -= each * full
            keep(room - each * length, first, full)
            keep(room, first + full, count - full)
    return np.array(rows, np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, *, doc_id="doc_id", text="text",
                 capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents: ids with the end id behind, cut if longer
    than ``capacity`` so that only the first piece may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for rows in slices(batch, batch.column(1)):
                out: list[list] = [[], [], [], [], []]
                encoded = tokens.encode(rows.column(1).to_pylist())
                for doc, ids in zip(rows.column(0).to_pylist(), encoded):
                    ids = memoryview(ids + end)
                    size = len(ids) // 4
                    first = size % capacity or capacity
                    stops = range(first, size + 1, capacity)
                    at = 0
                    for piece, stop in enumerate(stops):
                        crc = zlib.crc32(ids[4 * at : 4 * stop])
                        for column, value in zip(out, (doc, piece, at, stop - at, crc)):
                            column.append(value)
                        at = stop
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(out, kinds)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(run, _PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, *, doc_id="doc_id", text="text",
                   capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset`` there.

    A null or empty text is one piece of the end id alone; rows that share a
    ``doc_id`` are packed one by one; an empty table gives no rows.  Only the
    counts per length (at most ``capacity``) and the places (at most
    ``capacity ** 2``) pass through the driver; pieces of one length are
    numbered in chunks, so that no task holds all pieces of a common length.
    """
    space = workspace(docs.sparkSession, "packing")
    pieces = space.write(
        "pieces", token_pieces(docs, tokenizer, end_id, doc_id=doc_id, text=text, capacity=capacity)
    ).df
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = plan(counts, capacity)
    chunks = max(64, -(-sum(counts.values()) // CHUNK_ROWS))
    chunk = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)).alias("chunk")
    dealt = pieces.select("*", chunk)
    earlier = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("rows")).select(
        "length", "chunk", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("earlier")
    )
    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        dealt.withColumn("row", F.row_number().over(within))
        .join(offsets, ["length", "chunk"])
        .select("doc_id", "piece", "start", "length", "ids_crc32",
                (F.col("earlier") + F.col("row") - 1).alias("rank"))
    )
    shared = docs.sparkSession.sparkContext.broadcast(places[np.lexsort((places[:, 1], places[:, 0]))])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            row = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            number = rank - row[:, 1]
            sequence = row[:, 2] + number // row[:, 3]
            offset = row[:, 4] + number % row[:, 3] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    return ranked.mapInArrow(put, _PIECES + ", sequence_id bigint, offset bigint")
