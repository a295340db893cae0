"""Near-duplicate documents by bottom-k sketches from one hash function.

A document is the set of the hashes of its word shingles.  It retains the first
of them in one order that holds for all documents: by how common the hash is,
then by the hash.  Of ``n`` hashes it retains ``n - ceil(threshold * n) + 1``,
which is the least number that makes two sets within the threshold share a
retained one, whatever the order.  So the inverted lists of retained hashes lose
no link, and the order only decides how long they are.

How common a hash is, is read from counters, each shared by the hashes with the
same leading bits.  Their number grows with the input up to a bound, so that
their levels may be sent to every task at any size of it.

Sets that are equal are one before anything is compared, and so are lists with
the same members.  Members of a list first compare short signatures, and those
without a partner that they do not rule out go.  Of the others, neighbours in each
list are compared first, which settles large groups of copies without all of
their pairs.  Then, only in lists that still hold several components, sketches
of the smallest hashes travel with the lists, and the pairs of different
components go on whose union sketch does not rule them out.  The first lists of
a member travel as well, and two members are compared in the first list that
they share, so a pair is not found again in each of its lists.  Every pair that
counts as a link is confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trailgraph.graph import PropertyGraph
from trailgraph.llm.common import slices, workspace
from trailgraph.llm.words import INCREMENT, byte_class, hashes_of, mixed, words_of

SHINGLE = 3
#: The least similarity of linked documents, in hundredths.
PERCENT = 85
#: Counters that say how common a hash is: one for so many bytes of text, and two
#: to this power at least and at most.
CELL_BYTES = 32
CELL_BITS = (16, 25)
#: Counters, and bytes of bits, in one row while they are added up: two to this power.
CHUNK_BITS = 14
#: Bits that say which sets are wanted: two to this power.
WANTED_BITS = 26
#: Bits of a signature, and in how many of them linked documents may differ: they
#: differ in one of 13, so in more than that with a probability below 1e-11.
SIGNED_BITS = 128
SIGNED_RADIUS = 36
#: Smallest hashes in a sketch.
SKETCH = 256
#: Members of a list compared by one task; longer lists are cut in blocks, each two of which meet.
GROUP_ROWS = 1024
#: Standard errors that an estimate may lie below the threshold.
ERRORS = 6
#: Values in so few sketches of a list are counted pair by pair.
FEW = 16
#: Members of a list at most for which each pair is looked at by itself.
SHORT = 6
#: Lists of a member that travel with it, so that pairs are compared in their first common one alone.
FIRST_LISTS = 64
_LAST = np.uint32(0xFFFFFFFF)
_WORD = (1 << 64) - 1
# Blanks between words.
_GAPS = b" \t\n\x0b\x0c\r"


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, rising within each, and where each text starts among them."""
    words = words_of(texts, byte_class(_GAPS))
    hashes = hashes_of(words.distinct)[words.code]
    rows = len(texts)
    sizes = np.bincount(words.row, minlength=rows)
    first = np.cumsum(sizes) - sizes
    each = np.where(sizes >= shingle, sizes - shingle + 1, np.minimum(sizes, 1))
    row = np.repeat(np.arange(rows), each)
    begin = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + first[row]
    length = np.minimum(sizes, shingle)[row]
    found = mixed(length.astype(np.uint64) + np.uint64(INCREMENT))
    for step in range(shingle):
        here = length > step
        word = hashes[np.minimum(begin + step, max(0, len(hashes) - 1))] if len(hashes) else hashes
        found = np.where(here, mixed(found * np.uint64(INCREMENT) + word), found) if len(found) else found
    edges = np.concatenate([[0], np.cumsum(each)])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        found[a:b].sort()
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    starts = np.concatenate([[0], np.cumsum(np.bincount(row[fresh], minlength=rows))])
    return found[fresh], starts


def _cells(hashes: np.ndarray, cells: int) -> np.ndarray:
    """The counter of each hash, of ``cells``, a power of two."""
    return (hashes >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def common_levels(docs: DataFrame, space) -> np.ndarray:
    """For each counter, how many half powers of two it lies above the mean; near it or below, 0."""
    chunk = 1 << CHUNK_BITS
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    all_cells = 1 << min(max((size // CELL_BYTES).bit_length(), CELL_BITS[0]), CELL_BITS[1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(all_cells, np.uint16)  # of a task; fuller ones are common enough
        for batch in batches:
            for rows in slices(batch, batch.column(0)):
                found, times = np.unique(_cells(shingle_sets(rows.column(0))[0], all_cells), return_counts=True)
                cells[found] = np.minimum(cells[found] + times, 0xFFFF)
        for at in range(0, len(cells), chunk):
            part = cells[at : at + chunk]
            if part.any():
                width = np.min_scalar_type(int(part.max())).itemsize
                yield _row(chunk=at // chunk, cells=bytes([width]) + part.astype(f"<u{width}").tobytes())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[place] = sums.get(place, 0) + np.frombuffer(cells, f"<u{cells[0]}", offset=1).astype(np.int64)
        for place, cells in sums.items():
            yield _row(chunk=place, cells=cells.tobytes(), total=int(cells.sum()))

    told = docs.mapInArrow(count, "chunk int, cells binary").repartition("chunk")
    added = space.write("cells", told.mapInArrow(add, "chunk int, cells binary, total bigint"), n=F.sum("total"))
    mean = max(1.0, (added.observed["n"] or 0) / all_cells)

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                over = np.ceil(2 * np.log2(np.maximum(np.frombuffer(cells, "<i8") / mean, 1.0)))
                yield _row(chunk=place, cells=np.where(over > 1, over, 0).astype(np.uint8).tobytes())

    levels = np.zeros(all_cells, np.uint8)
    for row in added.df.select("chunk", "cells").mapInArrow(level, "chunk int, cells binary").collect():
        levels[row["chunk"] * chunk :][:chunk] = np.frombuffer(row["cells"], np.uint8)
    return levels


def _row(**values) -> pa.RecordBatch:
    kinds = {"chunk": pa.int32(), "cells": pa.binary(), "total": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for k, v in values.items()], names=list(values))


def _keys(hashes: np.ndarray, starts: np.ndarray) -> list[bytes | None]:
    from xxhash import xxh3_128_digest

    return [xxh3_128_digest(hashes[a:b].tobytes()) if b > a else None
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def retained(hashes: np.ndarray, starts: np.ndarray, levels: np.ndarray, percent: int) -> pa.ListArray:
    """The first hashes of each set in the common order, as many as links need."""
    sizes = np.diff(starts)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort((row << 8) + levels[_cells(hashes, len(levels))], kind="stable")
    keep = np.where(sizes > 0, sizes - (percent * sizes + 99) // 100 + 1, 0)
    first = np.arange(len(hashes)) - starts[:-1][row] < keep[row]
    bounds = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes[order[first]].view(np.int64)))


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each set, one bit of the smallest hash in each of ``SIGNED_BITS`` bins, as two longs."""
    rows = len(starts) - 1
    row = np.repeat(np.arange(rows), np.diff(starts))
    place = row * SIGNED_BITS + (hashes % np.uint64(SIGNED_BITS)).astype(np.int64)
    bits = np.zeros(rows * SIGNED_BITS, np.uint8)
    bits[place[::-1]] = (hashes[::-1] >> np.uint64(8)).astype(np.uint8) & 1  # the smallest comes last and stays
    return np.packbits(bits, bitorder="little").view("<i8").reshape(rows, 2)


def _sets(docs: DataFrame, levels, percent: int) -> DataFrame:
    """``(doc_id, n, key, retained, low, high)`` of each row; ``key`` names the set, null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, batch.column(1)):
                hashes, starts = shingle_sets(rows.column(1))
                signed = signatures(hashes, starts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.diff(starts)), pa.array(_keys(hashes, starts), pa.binary()),
                     retained(hashes, starts, levels.value, percent), pa.array(signed[:, 0]), pa.array(signed[:, 1])],
                    names=["doc_id", "n", "key", "retained", "low", "high"],
                )

    return docs.mapInArrow(
        run, "doc_id bigint, n bigint, key binary, retained array<bigint>, low bigint, high bigint"
    )


def _full_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, hashes)`` of the classes in ``wanted`` (``node``, ``key``), from the texts again.

    A fixed number of bits tells the tasks which keys are wanted, and perhaps
    some that are not; the join on the key lets only the wanted pass.
    """
    bits = 1 << WANTED_BITS
    chunk = 1 << CHUNK_BITS + 3

    def place(key: bytes) -> int:
        return int.from_bytes(key[:8], "little") % bits

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.unique(np.array([place(k) for k in batch.column(0).to_pylist()], np.int64))
            for at in np.unique(places // chunk).tolist():
                here = np.zeros(chunk, np.uint8)
                here[places[places // chunk == at] % chunk] = 1
                yield _row(chunk=at, cells=np.packbits(here).tobytes())

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[at] = sums.get(at, np.uint8(0)) | np.frombuffer(cells, np.uint8)
        for at, cells in sums.items():
            yield _row(chunk=at, cells=cells.tobytes())

    marked = np.zeros(bits // 8, np.uint8)
    told = wanted.select("key").mapInArrow(mark, "chunk int, cells binary").repartition("chunk")
    for row in told.mapInArrow(unite, "chunk int, cells binary").collect():
        marked[row["chunk"] * chunk // 8 :][: chunk // 8] = np.frombuffer(row["cells"], np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(marked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for rows in slices(batch, batch.column(0)):
                hashes, starts = shingle_sets(rows.column(0))
                keys, found = [], []
                for number, key in enumerate(_keys(hashes, starts)):
                    if key is not None and known[(at := place(key)) >> 3] >> (7 - at % 8) & 1:
                        keys.append(key)
                        found.append(hashes[starts[number] : starts[number + 1]].astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(found, pa.binary())], names=["key", "hashes"]
                )

    # copies are one before the join, so that a large group does not meet in it
    each = texts.mapInArrow(run, "key binary, hashes binary").groupBy("key").agg(F.first("hashes").alias("hashes"))
    return each.join(wanted, "key").select("node", "hashes")


def sketch_allows(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the union sketch of two rising sets does not rule a link out."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    if large <= SKETCH:
        return True
    union = np.union1d(a[:SKETCH], b[:SKETCH])[:SKETCH]
    shared = int((_inside(union, a[:SKETCH]) & _inside(union, b[:SKETCH])).sum())
    return shared / len(union) >= _least(len(union), (small + large) / (1 + percent / 100), percent)


def _least(count, union, percent: int):
    """The estimate from ``count`` of ``union`` elements below which there is no link."""
    t = percent / 100
    return t - ERRORS * np.sqrt(t * (1 - t) / np.maximum(count, 1) * np.maximum(0, 1 - count / union)) - 1e-9


def _inside(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    at = np.searchsorted(others, values)
    return (at < len(others)) & (others[np.minimum(at, len(others) - 1)] == values)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those ``(a, b)`` whose full sets are within the threshold."""
    one = sets.select(F.col("node").alias("a"), F.col("hashes").alias("of_a"))
    two = sets.select(F.col("node").alias("b"), F.col("hashes").alias("of_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                if not sketch_allows(x, y, percent):
                    held.append(False)
                    continue
                shared = int(_inside(x, y).sum())
                held.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(held, pa.bool_()))

    met = pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b")
    return met.mapInArrow(run, "a bigint, b bigint")


def neighbours(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of members next to each other by size in a list, or in a block of a long one."""
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / GROUP_ROWS))
    before = F.lag(F.struct("node", "size")).over(
        _window(["value", block], ["size", "node"])
    )
    pairs = lists.select("node", "size", before.alias("before")).filter(
        F.col("before").isNotNull() & (100 * F.col("before.size") >= percent * F.col("size"))
    )
    return _ordered(pairs, "node", "before.node").distinct()


def _window(keys, order):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*order)


def _ordered(pairs: DataFrame, one: str, two: str) -> DataFrame:
    return pairs.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))


def possible_links(
    labels: np.ndarray, sizes: np.ndarray, sketches: list[np.ndarray], percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Positions of members with different labels that their sketches do not rule out.

    A sketch holds the leading halves of the smallest hashes, so two different
    ones may look equal, which only ever adds to an estimate.
    """
    count = len(labels)
    lengths = np.array([len(s) for s in sketches])
    if count <= SHORT:
        return _of_few(labels, sizes, sketches, percent)
    owner = np.repeat(np.arange(count), lengths)
    _, value, times = np.unique(np.concatenate(sketches), return_inverse=True, return_counts=True)
    shared = np.zeros((count, count), np.float32)
    few = (times > 1) & (times <= FEW)
    order = np.argsort(value, kind="stable")
    begin = np.cumsum(times) - times
    for length in np.unique(times[few]).tolist():
        groups = owner[order[begin[few & (times == length)][:, None] + np.arange(length)]]
        for i in range(length):
            for j in range(i + 1, length):
                np.add.at(shared, (groups[:, i], groups[:, j]), 1)
                np.add.at(shared, (groups[:, j], groups[:, i]), 1)
    many = np.flatnonzero(times > FEW)
    column = np.full(len(times), -1)
    for at in range(0, len(many), 1024):
        part = many[at : at + 1024]
        column[part] = np.arange(len(part))
        here = column[value] >= 0
        has = np.zeros((count, len(part)), np.float32)
        has[owner[here], column[value[here]]] = 1
        shared += has @ has.T
        column[part] = -1
    whole = sizes <= SKETCH
    last = np.array([s[-1] if not w else np.iinfo(np.uint32).max for s, w in zip(sketches, whole)], np.uint32)
    if whole.all():
        upto = np.repeat(lengths[:, None], count, axis=1)
    else:
        upto = np.stack([np.searchsorted(s, last, side="right") for s in sketches])
    union = upto + upto.T - shared
    both = (sizes[:, None] + sizes[None, :]) / (1 + percent / 100)
    low, high = np.minimum(sizes[:, None], sizes[None, :]), np.maximum(sizes[:, None], sizes[None, :])
    near = (labels[:, None] != labels[None, :]) & (100 * low >= percent * high)
    exact = whole[:, None] & whole[None, :]
    near &= np.where(
        exact, 100 * shared >= percent * union, shared >= union * _least(union, both, percent)
    )
    i, j = np.nonzero(np.triu(near, 1))
    return i, j


def _of_few(labels, sizes, sketches, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """``possible_links`` for so few members that each pair is looked at."""
    found: tuple[list, list] = ([], [])
    for i in range(len(labels)):
        for j in range(i + 1, len(labels)):
            small, large = sorted((int(sizes[i]), int(sizes[j])))
            if labels[i] == labels[j] or 100 * small < percent * large:
                continue
            a, b = sketches[i], sketches[j]
            upto = min(a[-1] if sizes[i] > SKETCH else _LAST, b[-1] if sizes[j] > SKETCH else _LAST)
            shared = int(_inside(a, b).sum())
            union = int(np.searchsorted(a, upto, "right") + np.searchsorted(b, upto, "right")) - shared
            if large <= SKETCH:
                allowed = 100 * shared >= percent * union
            else:
                allowed = shared >= union * _least(union, (small + large) / (1 + percent / 100), percent)
            if allowed:
                found[0].append(i)
                found[1].append(j)
    return np.array(found[0], np.int64), np.array(found[1], np.int64)


def in_blocks(lists: DataFrame, compared: list[str]) -> DataFrame:
    """The members of each list, or of each two blocks of a long one, next to each other."""
    blocks = F.ceil(F.col("members") / GROUP_ROWS).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    meets = F.explode(
        F.when(F.col("blocks") == 1, F.array(F.lit(0)))
        .otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")))
    )
    grouping = ["value", "one", "two"]
    dealt = (
        lists.select("*", blocks.alias("blocks"), own.alias("own"))
        .select("*", meets.alias("other"))
        .select("value", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), *compared)
    )
    return dealt.repartition(*grouping).sortWithinPartitions(*grouping)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Consecutive rows with the same first three columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[column.to_pylist() for column in batch.columns]):
            if held and row[:3] != held[0][:3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def with_partners(lists: DataFrame, percent: int) -> DataFrame:
    """The nodes that have a partner in some list whose size and signature allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[int] = []
        for rows in _groups(batches):
            if len(rows) == 2:  # most lists
                (*_, one, small, low, high), (*_, two, large, low2, high2) = sorted(rows, key=lambda row: row[4])
                apart = ((low ^ low2) & _WORD).bit_count() + ((high ^ high2) & _WORD).bit_count()
                if apart <= SIGNED_RADIUS and 100 * small >= percent * large:
                    found += [one, two]
                continue
            nodes, sizes, low, high = (np.array(c, np.int64) for c in list(zip(*rows))[3:])
            bits = np.stack([low, high]).view(np.uint64)
            partner = np.zeros(len(nodes), bool)
            for at in range(0, len(nodes), 256):
                part = slice(at, at + 256)
                apart = np.bitwise_count(bits[:, part, None] ^ bits[:, None, :]).sum(axis=0, dtype=np.int32)
                small, large = np.minimum(sizes[part, None], sizes), np.maximum(sizes[part, None], sizes)
                allowed = (apart <= SIGNED_RADIUS) & (100 * small >= percent * large)
                partner[part] |= allowed.sum(axis=1) > 1  # itself is one
            found += nodes[partner].tolist()
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["node"])
                found = []
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["node"])

    ordered = in_blocks(lists, ["node", "size", "low", "high"])
    return ordered.mapInArrow(run, "node bigint").distinct()


def not_met(value: int, labels: np.ndarray, sizes: np.ndarray, firsts: list[list[int]], percent: int) -> np.ndarray:
    """For positions ``i < j`` of the list ``value``, whether the two could link and meet in no list before it."""
    small, large = np.minimum(sizes[:, None], sizes), np.maximum(sizes[:, None], sizes)
    found = np.triu((labels[:, None] != labels) & (100 * small >= percent * large), 1)
    known = [np.array(v, np.int64) for v in firsts]
    known = [v[v < value] for v in known]
    owner = np.repeat(np.arange(len(known)), [len(v) for v in known])
    _, number, times = np.unique(np.concatenate(known), return_inverse=True, return_counts=True)
    column = np.full(len(times), -1)
    several = np.flatnonzero(times > 1)
    for at in range(0, len(several), 1024):
        if not found.any():
            break
        part = several[at : at + 1024]
        column[part] = np.arange(len(part))
        here = column[number] >= 0
        has = np.zeros((len(known), len(part)), np.float32)
        has[owner[here], column[number[here]]] = 1
        found &= has @ has.T == 0
        column[part] = -1
    return found


def listed_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """``other_pairs`` as the lists give them: once each, unless the two meet beyond their first ``FIRST_LISTS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            *numbers, firsts, sketches = list(zip(*rows))[3:]
            nodes, sizes, labels = (np.array(c, np.int64) for c in numbers)
            wanted = not_met(rows[0][0], labels, sizes, firsts, percent)
            at = np.flatnonzero(wanted.any(axis=0) | wanted.any(axis=1))
            if not len(at):
                continue
            i, j = possible_links(labels[at], sizes[at], [np.frombuffer(sketches[n], "<u4") for n in at], percent)
            i, j = at[i], at[j]
            i, j = i[wanted[i, j]], j[wanted[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[j])], names=["a", "b"])

    ordered = in_blocks(lists, ["node", "size", "label", "firsts", "sketch"])
    return _ordered(ordered.mapInArrow(run, "a bigint, b bigint"), "a", "b")


def with_firsts(lists: DataFrame) -> DataFrame:
    """``lists`` with ``firsts``, the first lists of each member in the order of their values."""
    firsts = F.slice(F.sort_array(F.collect_set("value")), 1, FIRST_LISTS).alias("firsts")
    return lists.join(lists.groupBy("node").agg(firsts), "node")


def other_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of a list with different labels that their sketches do not rule out."""
    return listed_pairs(lists, percent).distinct()


def _sketched(sets: DataFrame) -> DataFrame:
    """``(node, sketch)``: the leading halves of the smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.frombuffer(v.as_buffer(), "<u8", min(SKETCH, len(v.as_buffer()) // 8)) >> np.uint64(32))
                     .astype("<u4").tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.binary())], names=["node", "sketch"]
            )

    return sets.mapInArrow(run, "node bigint, sketch binary")


def _components(links: DataFrame) -> DataFrame:
    """``(node, label)`` of the nodes that have links."""
    graph = PropertyGraph.from_edges(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return graph.wcc().vertices.select(F.col("id").alias("node"), F.col("attr").alias("label"))


def near_duplicates(docs: DataFrame, *, doc_id="doc_id", text="text", percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``.

    Words lie between blanks, A-Z become a-z, and the shingles are of three
    words; a text with fewer is one shingle.  Documents link if the share of
    common shingles is ``percent`` hundredths or more; ``component_id`` is the
    smallest ``doc_id`` reachable.  A text without words, null or empty, links
    with nothing.  Rows that repeat are all kept or none of them.  A null
    ``doc_id`` carries links, but names no component unless nothing else is
    there; it is kept only then.  Other columns are not looked at.

    No link is lost in the lists.  A link would be lost if its signatures differ
    in more than ``SIGNED_RADIUS`` bits, or if the sketches of sets of more than
    ``SKETCH`` shingles estimate it more than ``ERRORS`` standard errors too low:
    about one in a billion.
    """
    spark = docs.sparkSession
    space = workspace(spark, "bottom-k")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    texts = rows.select("text")
    levels = spark.sparkContext.broadcast(common_levels(texts, space))
    printed = space.write("sets", _sets(rows, levels, percent)).df
    classes = space.write(
        "classes",
        printed.filter("key IS NOT NULL").groupBy("key")
        .agg(F.min("doc_id").alias("least"), F.first("n").alias("size"), F.first("retained").alias("retained"),
             F.first("low").alias("low"), F.first("high").alias("high"))
        .withColumn("node", F.monotonically_increasing_id()),
    ).df
    entries = classes.select("node", "size", F.explode("retained").alias("value"))
    several = entries.groupBy("value").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = space.write("met", entries.join(several, "value")).df
    # lists with the same members are one, known by their number and two sums of hashes
    alike = met.groupBy("value").agg(
        F.max("members").alias("members"), F.bit_xor(F.xxhash64("node")).alias("one"),
        F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("two"),
    )
    kept = alike.groupBy("members", "one", "two").agg(F.min("value").alias("value")).select("value")
    signed = space.write(
        "signed", met.join(kept, "value", "left_semi").join(classes.select("node", "low", "high"), "node")
    ).df
    paired = with_partners(signed, percent)
    lists = space.write(
        "lists", signed.drop("low", "high").join(paired, "node", "left_semi"), rows=F.count(F.lit(1))
    )
    labels = _labels(lists.df, classes, texts, space, percent) if lists.observed["rows"] else None
    named = classes.select("key", "node", "least")
    if labels is None:
        named = named.select("key", F.col("least").alias("component_id"))
    else:
        labelled = space.write(
            "labelled", named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        ).df
        least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
        named = space.write("named", labelled.join(least, "label").select("key", "component_id")).df
    lone = printed.filter("key IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    found = printed.filter("key IS NOT NULL").join(named, "key").select("doc_id", "n", "component_id").unionByName(lone)
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _labels(lists: DataFrame, classes: DataFrame, texts: DataFrame, space, percent: int) -> DataFrame | None:
    """``(node, label)`` of the nodes that have links, by component; or nothing."""
    wanted = lists.select("node").distinct().join(classes.select("node", "key"), "node")
    sets = space.write("full", _full_sets(texts, wanted)).df
    near = space.write("near", neighbours(lists, percent)).df
    links = space.write("near-links", confirmed(near, sets, percent), rows=F.count(F.lit(1)))
    parts = None
    labelled = lists.withColumn("label", F.col("node"))
    if links.observed["rows"]:
        parts = space.write("parts", _components(links.df)).df
        labelled = _labelled(lists, parts)
    labelled = space.write("labelled-lists", labelled).df
    mixed = labelled.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    open_ = space.write("open", labelled.join(mixed.filter("low < high").select("value"), "value")).df
    sketches = space.write("sketches", _sketched(sets)).df
    others = other_pairs(with_firsts(open_).join(sketches, "node"), percent).join(near, ["a", "b"], "left_anti")
    others = space.write("others", others).df
    more = space.write("other-links", confirmed(others, sets, percent), rows=F.count(F.lit(1)))
    if not more.observed["rows"] or parts is None:
        return _components(more.df) if more.observed["rows"] else parts
    # what is linked already is one node for the links found since
    onward = more.df
    for end in ("a", "b"):
        onward = _labelled(onward.withColumnRenamed(end, "node"), parts).drop("node").withColumnRenamed("label", end)
    joined = space.write("joined", _components(onward.filter("a <> b").distinct())).df
    known = lists.select("node").distinct()
    return (
        _labelled(known, parts)
        .join(joined.select(F.col("node").alias("label"), F.col("label").alias("final")), "label", "left")
        .select("node", F.coalesce("final", "label").alias("label"))
    )


def _labelled(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` with the ``label`` of their ``node``; a node without links is its own."""
    return rows.join(parts, "node", "left").withColumn("label", F.coalesce("label", "node"))
