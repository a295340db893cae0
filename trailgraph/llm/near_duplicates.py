"""Near-duplicate documents by SimHash, compared bit-sliced.

Fingerprints within the radius agree on whole bands of bits, whichever bits
differ, so those that agree on enough bands meet in a group.  A group is stored
vertically: word ``p`` of a lane block holds bit ``p`` of 64 fingerprints.  One
fingerprint is compared with 64 at once, plane by plane, the distances held in
carry-save counters, and a block is given up once all its lanes exceed the
radius.  A group hands on a tree over each set of linked ones, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trailgraph.graph import PropertyGraph
from trailgraph.llm.common import free_name, slices, workspace

RADIUS = 4
SHINGLE = 4
#: Fingerprints of a group compared by one task; larger groups are split in blocks.
GROUP_ROWS = 2048
#: Aim for groups of at most so many, by more bands, as the input grows.
MEAN_GROUP = 256
#: Pairs of a fingerprint and a lane block that are compared at once.
PAIRS = 1 << 14
#: Edges down from one fingerprint in the tree that stands for a linked set.
FAN_OUT = 8
# A-Z become a-z.
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a lower-cased text, as unsigned 64 bits."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, 42)]
    else:
        ends, at = [], -1
        for word in words:
            at += len(word) + 1
            ends.append(at)
        starts = [0, *[end + 1 for end in ends]]
        hashes = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(bits), 255):  # so that bytes can hold the sums
        counts += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, doc_id="doc_id", text="text", shingle=SHINGLE) -> DataFrame:
    """``(doc_id, fp)``, ``fp`` with the bits of the unsigned fingerprint; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, batch.column(1)):
                found = [fingerprint(t or b"", shingle) for t in rows.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.array(found, np.uint64).view(np.int64))],
                    names=["doc_id", "fp"],
                )

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text)).mapInArrow(
        run, "doc_id bigint, fp bigint"
    )


def lane_blocks(values: np.ndarray) -> np.ndarray:
    """Bit planes, ``(blocks, 64 planes)``: bit ``l`` of a word is that of lane ``l``."""
    blocks = -(-len(values) // 64)
    padded = np.zeros(64 * blocks, "<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8), bitorder="little").reshape(blocks, 64, 64)
    planes = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(planes).view("<u8").reshape(blocks, 64)


def lanes_within(planes: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of a block and a value: which pairs have lanes within the
    radius, and those lanes as bits.  ``planes`` is ``(pairs, 64)``."""
    alive = np.arange(len(values))
    width = radius.bit_length()
    counters = np.zeros((width, len(values)), np.uint64)
    over = np.zeros(len(values), np.uint64)
    start = (1 << width) - 1 - radius  # counting from here overflows beyond the radius
    for bit in range(width):
        if start >> bit & 1:
            counters[bit] = ~np.uint64(0)
    for plane in range(64):
        bit_of = (values[alive] >> np.uint64(plane)) & np.uint64(1)
        differ = planes[alive, plane] ^ (np.uint64(0) - bit_of)
        for bit in range(width):
            carry = counters[bit] & differ
            counters[bit] ^= differ
            differ = carry
        over |= differ
        if plane % 8 == 7:
            near = over != ~np.uint64(0)
            if not near.all():
                alive, over, counters = alive[near], over[near], counters[:, near]
                if not len(alive):
                    break
    return alive, ~over


def linked(values: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions ``i < j`` of values within the radius, some at a time."""
    values = values.astype("<u8")
    planes = lane_blocks(values)
    count, blocks = len(values), len(planes)
    first = np.arange(count) // 64
    ends = np.cumsum(blocks - first)
    for at in range(0, int(ends[-1]) if count else 0, PAIRS):
        number = np.arange(at, min(at + PAIRS, int(ends[-1])))
        one = np.searchsorted(ends, number, side="right")
        block = first[one] + number - (ends[one] - (blocks - first[one]))
        hit, lanes = lanes_within(planes[block], values[one], radius)
        if not len(hit):
            continue
        bits = np.unpackbits(lanes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        row, lane = np.nonzero(bits)
        i, j = one[hit][row], block[hit][row] * 64 + lane
        keep = (j > i) & (j < count)
        yield i[keep], j[keep]


def many_linked(values: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each of many small consecutive groups of at most 64 values."""
    starts = np.cumsum(sizes) - sizes
    group = np.repeat(np.arange(len(sizes)), sizes)
    lane = np.arange(len(values)) - starts[group]
    lanes = np.zeros((len(sizes), 64), "<u8")
    lanes[group, lane] = values
    planes = lane_blocks(lanes.reshape(-1))
    ones, others = [], []
    for at in range(0, len(values), PAIRS):
        one = np.arange(at, min(at + PAIRS, len(values)))
        hit, found = lanes_within(planes[group[one]], values[one].astype("<u8"), radius)
        bits = np.unpackbits(found.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        row, other = np.nonzero(bits)
        i = one[hit[row]]
        keep = (other > lane[i]) & (other < sizes[group[i]])
        ones.append(i[keep])
        others.append((starts[group[i]] + other)[keep])
    return np.concatenate(ones), np.concatenate(others)


class Forest:
    """Keeps the smallest position of each linked set."""

    def __init__(self, count: int):
        self.root = np.arange(count)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (onward := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = onward

    def edges(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A tree over each linked set, as two arrays of values: at most ``FAN_OUT``
        below each, so that no fingerprint ends up with all edges of a large set."""
        order = np.argsort(self.root, kind="stable")
        roots = self.root[order]
        start = np.searchsorted(roots, roots)
        rank = np.arange(len(order)) - start
        above = order[start + np.maximum(rank - 1, 0) // FAN_OUT]
        below = rank > 0
        return values[order[below]], values[above[below]]


def group_links(values: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Trees over the sets linked inside consecutive groups, as two arrays of values."""
    forest = Forest(len(values))
    starts = np.cumsum(sizes) - sizes
    small = (sizes > 1) & (sizes <= 64)
    rows = np.repeat(small, sizes)
    where = np.flatnonzero(rows)
    if len(where):
        i, j = many_linked(values[where], sizes[small], radius)
        forest.add(where[i], where[j])
    for group in np.flatnonzero(sizes > 64):
        start, size = int(starts[group]), int(sizes[group])
        for i, j in linked(values[start : start + size], radius):
            forest.add(start + i, start + j)
    return forest.edges(values)


def _bands(count: int, radius: int) -> list[list[tuple[int, int]]]:
    """For each choice of bands that must agree: their ``(shift, bits)``.

    With ``radius + w`` bands, at least ``w`` agree within the radius; ``w``
    grows with the input so that groups stay small.
    """
    whole = 1
    while count / 2 ** (64 * whole / (radius + whole)) > MEAN_GROUP:
        whole += 1
    bands = radius + whole
    edges = [round(64 * b / bands) for b in range(bands + 1)]
    spans = [(a, b - a) for a, b in zip(edges, edges[1:])]
    return [list(chosen) for chosen in combinations(spans, whole)]


def _banded(distinct: DataFrame, count: int, radius: int) -> DataFrame:
    keys = []
    for number, chosen in enumerate(_bands(count, radius)):
        key = F.lit(0).cast("bigint")
        for shift, bits in chosen:
            part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1))
            key = F.shiftleft(key, bits).bitwiseOR(part)
        keys.append(F.struct(F.lit(number).alias("choice"), key.alias("key")))
    return distinct.select("fp", F.explode(F.array(*keys)).alias("band")).select(
        "fp", "band.choice", "band.key"
    )


def _split(banded: DataFrame, space) -> DataFrame:
    """Groups of at most about ``2 * GROUP_ROWS``: a larger one is cut into
    blocks by hash, and each two of its blocks meet in a group of their own."""
    hot = space.write(
        "hot",
        banded.groupBy("choice", "key").count().filter(F.col("count") > GROUP_ROWS)
        .select("choice", "key", F.ceil(F.col("count") / GROUP_ROWS).cast("int").alias("blocks")),
        rows=F.count(F.lit(1)),
    )
    plain = banded.select("fp", "choice", "key", F.lit(0).alias("one"), F.lit(0).alias("two"))
    if not hot.observed["rows"]:
        return plain
    few = hot.observed["rows"] <= 10_000
    table = F.broadcast(hot.df) if few else hot.df
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("block"))
    )
    cut = (
        banded.join(table, ["choice", "key"])
        .withColumn("block", block)
        .select("fp", "choice", "key", "block", other.alias("other"))
        .select("fp", "choice", "key", F.least("block", "other").alias("one"),
                F.greatest("block", "other").alias("two"))
    )
    return plain.join(table, ["choice", "key"], "left_anti").unionByName(cut)


def fingerprint_links(distinct: DataFrame, count: int, space, radius: int = RADIUS) -> DataFrame:
    """Pairs of distinct fingerprints with the components of all links within the
    radius; the two of a pair are linked, if not directly."""
    grouping = ["choice", "key", "one", "two"]
    dealt = _split(_banded(distinct, count, radius), space)
    ordered = dealt.repartition(*grouping).sortWithinPartitions(*grouping)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: np.ndarray | None = None
        for columns, last in _with_last(batches):
            rows = columns if rest is None else np.concatenate([rest, columns], axis=1)
            if not rows.shape[1]:
                continue
            new = np.flatnonzero((rows[1:, 1:] != rows[1:, :-1]).any(axis=0)) + 1
            cut = rows.shape[1] if last else (int(new[-1]) if len(new) else 0)
            rest = rows[:, cut:]
            if not cut:
                continue
            edges = np.concatenate([[0], new[new < cut], [cut]])
            a, b = group_links(rows[0, :cut].view(np.uint64), np.diff(edges), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
                )

    return ordered.select("fp", *grouping).mapInArrow(run, "a bigint, b bigint")


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, bool]]:
    """The columns of each batch as rows of longs, and an empty last one."""
    width = 5
    for batch in batches:
        yield np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]), False
    yield np.zeros((width, 0), np.int64), True


def near_duplicates(docs: DataFrame, *, doc_id="doc_id", text="text", radius=RADIUS, shingle=SHINGLE) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per row of ``docs``.

    Documents link if their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest ``doc_id`` reachable over links.  Texts
    without words (null, empty) have fingerprint zero and link like any other.
    A null ``doc_id`` carries links but is never a component; a component of
    nulls alone is null.  Equal fingerprints are one before anything is compared.
    """
    space = workspace(docs.sparkSession, "near-duplicates")
    printed = space.write("fingerprints", fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle)).df
    distinct = space.write(
        "distinct", printed.groupBy("fp").agg(F.min("doc_id").alias("least")), rows=F.count(F.lit(1))
    )
    links = space.write(
        "links",
        fingerprint_links(distinct.df.select("fp"), distinct.observed["rows"], space, radius).distinct(),
        rows=F.count(F.lit(1)),
    )
    if not links.observed["rows"]:
        named = distinct.df.select("fp", F.col("least").alias("component_id"))
        return printed.join(named, "fp").select("doc_id", "fp", "component_id")
    graph = PropertyGraph.from_edges(links.df.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    parts = graph.wcc().vertices.select(F.col("id").alias("fp"), F.col("attr").alias("part"))
    member = parts.join(distinct.df, "fp")
    least = space.write("least", member.groupBy("part").agg(F.min("least").alias("smallest"))).df
    labels = space.write(
        "labels", parts.join(least, "part").select("fp", F.col("smallest").alias("component_id"))
    ).df
    named = distinct.df.join(labels, "fp", "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id")
    )
    named = space.write("named", named).df
    return printed.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, *, doc_id="doc_id", text="text", **options) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id.

    Rows that repeat that id all stay; rows without an id stay.
    """
    found = near_duplicates(docs, doc_id=doc_id, text=text, **options)
    name = free_name(docs.columns, "kept")
    first = found.filter("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(first, F.col(f"`{doc_id}`") == F.col(name), "left_semi")
    return kept.unionByName(docs.filter(F.col(doc_id).isNull()))
