"""Sharding by histogram sort.

Documents are ordered by a hash of their text, then by id, so that equal texts
stand together.  Splitters of that order are found by probing: every round
counts the exact bytes below some probes per splitter, in the tasks, and only
the counts travel; the probes close in until the bytes below each splitter are
within the tolerance, or one document lies between two probes.  Then the
documents are exchanged once, into ranges of about equal bytes, several to a
shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trailgraph.llm.common import free_name, workspace

SHARDS = 8
#: Bytes of a range that one task gets, and ranges of a shard at most.
RANGE_BYTES = 16 << 20
RANGES = 4096
#: Probes per round: up to so many per splitter, and so many in all.
PROBES = 32
MOST_PROBES = 1_000_000
#: By how much of a shard's bytes a splitter may be off.
TOLERANCE = 1e-5
#: The same, where more exactness would divide a group of equal texts.
GROUP_TOLERANCE = 5e-3


def _probe_bytes(probes: list[int], ids: int) -> np.ndarray:
    """Probes count ``ids`` keys to each hash; one behind all keys is the highest."""

    def key(probe: int) -> bytes:
        high, low = divmod(probe, ids)
        return high.to_bytes(8, "big") + low.to_bytes(8, "big") if high < 1 << 64 else b"\xff" * 16

    return np.array([key(probe) for probe in probes], "S16")


def _keys(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Order-keeping 16-byte keys of a hash, a signed long, and an id from 0 on."""
    both = np.stack([high.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63), low.astype(np.uint64)], axis=1)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").reshape(-1)


def histogram(sized: DataFrame, probes: list[int], ids: int) -> list[tuple[int, int, int, int]]:
    """Of the rows ``(high, low, size)`` between probes, where there are any: the
    first key, the key behind the last one, exact bytes and rows, in order."""
    sought = _probe_bytes(probes, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _keys(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            place = np.searchsorted(sought, keys, side="right")
            start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            stop = np.append(start[1:], len(keys))
            total = np.append(0, np.cumsum(batch.column(2).to_numpy()[order]))
            raw = keys.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(place[start].astype(np.int32)),
                    pa.array([raw[16 * i : 16 * i + 16] for i in start], pa.binary()),
                    pa.array([raw[16 * i - 16 : 16 * i] for i in stop], pa.binary()),
                    pa.array(total[stop] - total[start]),
                    pa.array(stop - start),
                ],
                names=["place", "first", "last", "size", "rows"],
            )

    counted = (
        sized.mapInArrow(run, "place int, first binary, last binary, size bigint, rows bigint")
        .groupBy("place")
        .agg(*[getattr(F, how)(name).alias(name) for name, how in
               (("first", "min"), ("last", "max"), ("size", "sum"), ("rows", "sum"))])
    )

    def probe(key: bytes) -> int:
        return int.from_bytes(key[:8], "big") * ids + int.from_bytes(key[8:], "big")

    return [
        (probe(row["first"]), probe(row["last"]) + 1, row["size"], row["rows"])
        for row in sorted(counted.collect(), key=lambda row: row["place"])
    ]


def splitters(
    sized: DataFrame, total: int, count: int, ids: int, parts: int, exact: int, loose: int
) -> list[int]:
    """Probes below which lie the bytes of 1, 2, ... of ``parts`` equal parts.

    Within ``exact`` bytes, or as near as whole documents allow; within
    ``loose`` if a group of equal texts would be divided otherwise.
    """
    wanted = [total * part // parts for part in range(1, parts)]
    spans = [((0, 0, 0), (ids << 64, total, count))] * len(wanted)  # probe, bytes and rows below
    chosen: dict[int, int] = {}
    each = max(2, min(PROBES, MOST_PROBES // parts))
    while len(chosen) < len(wanted):
        probes: set[int] = set()
        for number, (left, right) in enumerate(spans):
            if number not in chosen:
                unit = ids if (right[0] - 1) // ids > left[0] // ids else 1
                step = max(unit, (right[0] - left[0]) // (each + 1) // unit * unit)
                inner = range(left[0] // unit * unit + step, right[0], step)
                probes.update((left[0], *inner, right[0]))
        found = histogram(sized, sorted(probes), ids)
        sizes = np.cumsum([size for _, _, size, _ in found])
        rows = np.cumsum([n for _, _, _, n in found])
        for number, goal in enumerate(wanted):
            if number in chosen:
                continue
            at = min(int(np.searchsorted(sizes, goal, side="left")), len(found) - 1)
            first, behind, size, n = found[at]
            left = (first, int(sizes[at]) - size, int(rows[at]) - n)
            right = (behind, int(sizes[at]), int(rows[at]))
            spans[number] = left, right
            nearest = min((left, right), key=lambda end: abs(end[1] - goal))
            off = abs(nearest[1] - goal)
            one_group = (right[0] - 1) // ids == left[0] // ids
            if off <= exact or n <= 1 or right[0] - left[0] <= 1 or (one_group and off <= loose):
                chosen[number] = nearest[0]
    return sorted(chosen.values())


def _rows_below(sized: DataFrame, bounds: list[int], ids: int) -> list[int]:
    """Rows below each of the sorted bounds."""
    found = histogram(sized, bounds, ids)
    rows = np.append(0, np.cumsum([n for _, _, _, n in found]))
    return rows[np.searchsorted([behind for _, behind, _, _ in found], bounds, side="right")].tolist()


def shard_documents(
    docs: DataFrame,
    shards: int = SHARDS,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    range_bytes: int = RANGE_BYTES,
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with shard, slot in the shard and size, and the names of those columns.

    The law is ``bytes``: every shard gets about the same bytes, the size of a
    document being the bytes of its text plus 1 (null: 1).  Equal texts stand
    side by side, and only a group too large for the tolerance is divided.
    Slots count from 0 without gaps in the order of the keys.  A null ``doc_id``
    comes first; an empty table gives no rows.  If rows are equal in text and
    ``doc_id``, the table is written once with a number for each row, which takes the
    place of the id in the order, so that such a group can be divided as well.
    """
    space = workspace(docs.sparkSession, "sharding")
    columns, row = docs.columns, free_name(docs.columns, "row")
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    keys = docs.select(hashed.alias("high"), F.col(doc_id).cast("bigint").alias("low"))
    number_of = F.col(doc_id).cast("bigint")
    if keys.groupBy("high", "low").count().filter("count > 1").limit(1).count():
        docs = space.write("numbered", docs.withColumn(row, F.monotonically_increasing_id())).df
        number_of = F.col(row)
    names = {name: free_name(docs.columns, name) for name in ("shard", "slot", "size")}
    high, low = free_name(docs.columns, "key_high"), free_name(docs.columns, "key_low")
    span, number = free_name(docs.columns, "span"), free_name(docs.columns, "number")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1
    sized = space.write(
        "sizes", docs.select(hashed.alias("high"), number_of.alias("low"), size.alias("size")),
        total=F.sum("size"), rows=F.count(F.lit(1)), least=F.min("low"), most=F.max("low"),
    )
    total, count = sized.observed["total"] or 0, sized.observed["rows"]
    least, most = (sized.observed[name] or 0 for name in ("least", "most"))
    id_from_0 = lambda column: F.coalesce(F.col(column) - least + 1, F.lit(0))
    ids = most - least + 2
    table = sized.df.select("high", id_from_0("low").alias("low"), "size")
    each = max(1, min(RANGES, -(-total // (shards * range_bytes))))  # ranges of a shard
    parts = shards * each
    bounds: list[int] = []
    starts = [0] * parts
    if count:
        shard = total / shards
        bounds = splitters(
            table, total, count, ids, parts, int(shard * TOLERANCE), int(shard * GROUP_TOLERANCE)
        )
        before = [0, *_rows_below(table, bounds, ids)]
        starts = [before[part] - before[part // each * each] for part in range(parts)]
    shared = docs.sparkSession.sparkContext.broadcast((_probe_bytes(bounds, ids), np.array(starts)))

    @F.pandas_udf("int")
    def span_of(high: pd.Series, low: pd.Series) -> pd.Series:
        keys = _keys(high.to_numpy(), low.to_numpy())
        return pd.Series(np.searchsorted(shared.value[0], keys, side="right"))

    @F.pandas_udf("bigint")
    def start_of(span: pd.Series) -> pd.Series:
        return pd.Series(shared.value[1][span.to_numpy()])

    keyed = docs.select("*", hashed.alias(high), number_of.alias(low), size.alias(names["size"]))
    keyed = keyed.withColumn(low, id_from_0(low))
    moved = keyed.withColumn(span, span_of(high, low)).repartitionById(parts, F.col(span))
    ordered = Window.partitionBy(span).orderBy(high, low)
    placed = moved.withColumn(number, F.row_number().over(ordered) - 1)
    placed = placed.withColumn(names["shard"], F.floor(F.col(span) / each).cast("int"))
    placed = placed.withColumn(names["slot"], start_of(span) + F.col(number))
    return placed.select(*[F.col(f"`{name}`") for name in columns], *names.values()), names
