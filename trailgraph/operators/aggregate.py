"""Aggregations over edges and triplets."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trailgraph.operators.triplets import BOTH_ENDS, as_column, triplets

# Neighbour ids that one part of a list spans.
PART_IDS = 100_000


def out_degrees(edges: DataFrame) -> DataFrame:
    """Out-degree of every vertex that has an out-edge; parallel edges count."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("attr"))


@dataclass(frozen=True)
class Send:
    """A message to one end of each triplet, where ``when`` holds."""

    to: str
    message: Column | str
    when: Column | str | None = None


def sent_messages(view: DataFrame, sends: Iterable[Send]) -> DataFrame:
    """``(id, msg)`` rows for the given sends over one reading of a triplet view.

    The receiver comes out of an exploded list, so what aggregates by it cannot
    reuse the partitioning of the joins below, and those stay free to be split.
    """
    messages = []
    for send in sends:
        message = F.struct(F.col(send.to).alias("id"), as_column(send.message).alias("msg"))
        messages.append(message if send.when is None else F.when(as_column(send.when), message))
    sent = view.select(F.explode(F.array(*messages)).alias("sent")).filter("sent IS NOT NULL")
    return sent.select("sent.id", "sent.msg")


def aggregate_messages(
    vertices: DataFrame,
    edges: DataFrame,
    sends: Iterable[Send],
    merge: Callable[[Column], Column] | Merge,
    ends: Iterable[str] = BOTH_ENDS,
) -> DataFrame:
    """Send along every triplet and merge per receiver: ``(id, msg)``.

    ``merge`` is an aggregate such as ``F.min``; it is applied before the
    shuffle as well, so a hub receives one row per partition.  A ``Merge`` is a
    function of the user's own.
    """
    return merged(sent_messages(triplets(vertices, edges, ends), sends), merge)


def merged(messages: DataFrame, merge: Callable[[Column], Column] | Merge) -> DataFrame:
    if isinstance(merge, Merge):
        return merged_messages(messages, merge)
    return messages.groupBy("id").agg(merge(F.col("msg")).alias("msg"))


@dataclass(frozen=True)
class Merge:
    """A merge of messages that no built-in aggregate gives.

    ``reduce(values, starts)`` gets the messages (an Arrow array) of some
    receivers one after another, and where those of each start; it returns one
    message for each.  It must not depend on the order of the messages, nor on
    which of them are merged first, because it is applied before the shuffle as
    well as after it.
    """

    reduce: Callable[[pa.Array, np.ndarray], pa.Array]


#: Messages merged at once before the shuffle.
MERGED_ROWS = 100_000


def merged_messages(messages: DataFrame, merge: Merge) -> DataFrame:
    """``(id, msg)``: the messages of each receiver merged by ``merge``.

    A task merges what it sends, so a receiver gets a few rows of each; after
    the shuffle, a task holds one merged message and the rows of one batch.
    """
    reduce, most, schema = merge.reduce, MERGED_ROWS, messages.schema

    def groups(batches: list, ordered: bool) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks()
        ids = rows.column(0).combine_chunks()
        values = rows.column(1).combine_chunks()
        keys = ids.to_numpy(zero_copy_only=False)
        if not ordered:
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values.take(pa.array(order))
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        merged = reduce(values, starts)
        merged = merged if isinstance(merged, pa.Array) else pa.array(merged)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys[starts], ids.type), merged.cast(values.type)], names=["id", "msg"]
        )

    def before(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                yield groups(held, False)
                held, rows = [], 0
        if rows:
            yield groups(held, False)

    def after(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            found = groups([batch] if last is None else [last, batch], True)
            yield found.slice(0, found.num_rows - 1)
            last = found.slice(found.num_rows - 1)
        if last is not None:
            yield last

    partial = messages.mapInArrow(before, schema)
    return partial.repartition("id").sortWithinPartitions("id").mapInArrow(after, schema)


def canonical_edges(
    edges: DataFrame, merge: Callable[[Column], Column] = F.min
) -> DataFrame:
    """Edges oriented from the smaller id to the larger, parallel ones merged."""
    return edges.groupBy(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    ).agg(merge(F.col("attr")).alias("attr"))


def _incident(edges: DataFrame, direction: str) -> DataFrame:
    """``(id, other, src, dst, attr)``: edges seen from one or both ends."""
    seen_from = {"out": ["src"], "in": ["dst"], "either": ["src", "dst"]}[direction]
    views = [
        edges.select(
            F.col(end).alias("id"),
            F.col("dst" if end == "src" else "src").alias("other"),
            "src",
            "dst",
            "attr",
        )
        for end in seen_from
    ]
    return views[0] if len(views) == 1 else views[0].unionByName(views[1])


def _collect(rows: DataFrame, item: Column, name: str, part_ids: int) -> DataFrame:
    """Lists of distinct items with their number of copies ``n``, sorted.

    The list of a vertex comes in parts: part ``p`` has the neighbours with ids
    from ``p * part_ids`` on.  So no list is longer than ``part_ids`` times the
    different attributes of parallel edges, a part depends on its rows alone,
    and lists in order of ``part`` are sorted.
    """
    other = F.col("other")
    part = ((other - F.pmod(other, F.lit(part_ids))) / part_ids).cast("bigint")
    counted = rows.groupBy("id", part.alias("part"), item.alias("item")).agg(
        F.count(F.lit(1)).alias("n")
    )
    entry = F.struct("item.*", "n")
    return counted.groupBy("id", "part").agg(F.sort_array(F.collect_list(entry)).alias(name))


def collect_edges(edges: DataFrame, direction: str, part_ids: int = PART_IDS) -> DataFrame:
    """Incident edges ``(src, dst, attr, n)`` per vertex and part; ``direction``
    is in, out or either."""
    return _collect(
        _incident(edges, direction), F.struct("src", "dst", "attr"), "edges", part_ids
    )


def collect_neighbors(
    vertices: DataFrame, edges: DataFrame, direction: str, part_ids: int = PART_IDS
) -> DataFrame:
    """Neighbours ``(id, attr, n)`` per vertex and part, ``n`` edges each."""
    others = vertices.select(F.col("id").alias("other_id"), F.col("attr").alias("other_attr"))
    rows = _incident(edges, direction).join(others, F.col("other") == F.col("other_id"))
    item = F.struct(F.col("other").alias("id"), F.col("other_attr").alias("attr"))
    return _collect(rows, item, "neighbors", part_ids)
