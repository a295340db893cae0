"""Repeated passages, deleted by aligning overlapping documents in pairs.

A passage is a block of lines with enough words that stands, contiguous, in two
documents.  It consists of shortest runs with enough words, from each of its
lines on and up to each of its lines.  Every document gives these runs, at most
two a line, known by 128 bits of their lines.  A run that several documents hold
names overlapping pairs: each of its holders is paired with the earliest one.
So a document has no more partners than runs, none of them is left out, and a
frequent run makes no more pairs than it has holders.

Each pair is aligned by patience: the longest chain of common lines that are
unique on both sides, the same again in the gaps between them, and from each
aligned line on as far as the documents agree on both sides.  That is done again
with what is left until no common line is left, so crossing passages are found
too.  The blocks are deleted from the later document.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trailgraph.llm.common import free_name, slices, workspace

#: Words that a deleted block has at least.
MIN_WORDS = 20
_RUNS = "id bigint, version bigint, place int, size int, run bigint, check bigint"


def worded_lines(text: str) -> list[str]:
    """The lines with words, without outer blanks."""
    return [clean for line in text.split("\n") if (clean := line.strip())]


def _known(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(
        F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(text).alias("version"), F.col(text).alias("text")
    ).filter("id IS NOT NULL AND text IS NOT NULL")


def shortest_runs(words: list[int], least: int) -> Iterator[tuple[int, int]]:
    """``(first, last)`` of the shortest runs that start or end at each line and
    have ``least`` words, each once."""
    first = open_ = total = 0
    for last, count in enumerate(words):
        total += count
        while first < last and total - words[first] >= least:
            total -= words[first]
            first += 1
        if total < least:
            continue
        # runs up to ``last`` start at ``first``; those of earlier starts that are still open end here too
        yield first, last
        for start in range(open_, first):
            yield start, last
        open_ = first + 1


def document_runs(docs: DataFrame, doc_id: str, text: str, min_words: int) -> DataFrame:
    """One row per shortest run of lines with enough words, at its first ``place``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        names = ["id", "version", "place", "size", "run", "check"]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())

        def batch_of(columns):
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)

        out: tuple[list, ...] = tuple([] for _ in names)
        for batch in batches:
            for rows in slices(batch, batch.column(2)):
                for doc, version, content in zip(*[column.to_pylist() for column in rows.columns]):
                    lines = worded_lines(content)
                    digests = [xxh3_128_digest(line.encode()) for line in lines]
                    for first, last in shortest_runs([len(line.split()) for line in lines], min_words):
                        key = struct.unpack("<qq", xxh3_128_digest(b"".join(digests[first : last + 1])))
                        for column, value in zip(out, (doc, version, first, last + 1 - first, *key)):
                            column.append(value)
                        if len(out[0]) >= 50_000:
                            yield batch_of(out)
                            out = tuple([] for _ in names)
        if out[0]:
            yield batch_of(out)

    return _known(docs, doc_id, text).mapInArrow(run, _RUNS)


def longest_chain(places: list[int]) -> list[int]:
    """Indices of a longest rising chain, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(places)
    for number, place in enumerate(places):
        pile = bisect_left(tops, place)
        before[number] = piles[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(place)
            piles.append(number)
        else:
            tops[pile], piles[pile] = place, number
    chain = []
    number = piles[-1] if piles else -1
    while number >= 0:
        chain.append(number)
        number = before[number]
    return chain[::-1]


Match = tuple[int, int]


def _chain(matches: list[Match]) -> list[Match]:
    """A longest chain of matches that rises on both sides, of those that are
    unique on both sides if there are any."""
    ones = Counter(one for one, _ in matches)
    others = Counter(other for _, other in matches)
    unique = [m for m in matches if ones[m[0]] == 1 and others[m[1]] == 1]
    ordered = sorted(unique or matches, key=lambda m: (m[0], -m[1]))
    return [ordered[n] for n in longest_chain([other for _, other in ordered])]


def _with_gaps(matches: list[Match]) -> list[Match]:
    """The chain of all matches, with those of the gaps between its lines, and so on."""
    found: list[Match] = []
    open_ = [matches]
    while open_:
        inside = open_.pop()
        chain = _chain(inside)
        found.extend(chain)
        if len(chain) == len(inside):
            continue
        gaps: dict[int, list[Match]] = {}
        for match in inside:
            gap = bisect_left(chain, match)
            before = gap == 0 or (chain[gap - 1][0] < match[0] and chain[gap - 1][1] < match[1])
            after = gap == len(chain) or (match[0] < chain[gap][0] and match[1] < chain[gap][1])
            if before and after:
                gaps.setdefault(gap, []).append(match)
        open_.extend(gaps.values())
    return found


def aligned(runs: list[tuple[int, int, int]]) -> set[int]:
    """The places of the later document that align with the earlier one, from the
    common runs ``(place, earlier place, size)`` of the pair.

    A block that an aligned line grows to holds the runs the line is part of, so
    it has enough words.
    """
    common = {(place + k, other + k) for place, other, size in runs for k in range(size)}
    found: set[int] = set()
    left = sorted(common)
    while left:
        for one, other in _with_gaps(left):
            for step in (-1, 1):
                at = 0
                while (one + at, other + at) in common and (at == 0 or one + at not in found):
                    found.add(one + at)
                    at += step
        left = [match for match in left if match[0] not in found]
    return found


def lines_to_delete(matches: list[tuple]) -> list[int]:
    """Places from the ``(earlier id, earlier version, place, earlier place,
    size)`` of one document, sorted."""
    deleted: set[int] = set()
    for _, pair in groupby(matches, key=itemgetter(0, 1)):
        deleted |= aligned([match[2:] for match in pair])
    return sorted(deleted)


def repeated_lines(docs: DataFrame, *, doc_id: str, text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """``(id, version, places)`` of the documents that lose lines."""
    space = workspace(docs.sparkSession, "line-dedup")
    runs = space.write("runs", document_runs(docs, doc_id, text, min_words)).df
    doc = F.struct("id", "version", "place")
    key = ["run", "check"]
    earliest = space.write(
        "earliest",
        runs.groupBy(*key).agg(F.min(doc).alias("first"), F.max(doc).alias("last"))
        .filter("first.id < last.id OR first.version < last.version")
        .select(*key, F.col("first.id").alias("from_id"), F.col("first.version").alias("from_version"),
                F.col("first.place").alias("from_place")),
    ).df
    matches = runs.join(earliest, key).filter("id <> from_id OR version <> from_version")
    order = ["id", "version", "from_id", "from_version", "place", "from_place", "size"]
    return _per_document(matches, order, lines_to_delete)


def _per_document(matches: DataFrame, columns: list[str], places_from) -> DataFrame:
    """``(id, version, places)``: what ``places_from`` makes of each document's rows, sorted, where it is not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*[column.to_pylist() for column in batch.columns])

        found: tuple[list, ...] = ([], [], [])
        schema = pa.schema({"id": pa.int64(), "version": pa.int64(), "places": pa.list_(pa.int32())})
        for (doc, version), group in groupby(rows(), key=itemgetter(0, 1)):
            # rows that repeat a document repeat its matches
            places = places_from([row[2:] for row, _ in groupby(group)])
            if places:
                for column, value in zip(found, (doc, version, places)):
                    column.append(value)
            if len(found[0]) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, schema.types)], schema=schema)
                found = ([], [], [])
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, schema.types)], schema=schema)

    ordered = matches.select(*columns).repartition("id", "version").sortWithinPartitions(*columns)
    return ordered.mapInArrow(run, "id bigint, version bigint, places array<int>")


def without_lines(text: str, places: list[int]) -> str:
    """``text`` without the lines with words at ``places``."""
    gone, place, kept = set(places), -1, []
    for line in text.split("\n"):
        if line.strip():
            place += 1
            if place in gone:
                continue
        kept.append(line)
    return "\n".join(kept)


def dedup_lines(
    docs: DataFrame, *, doc_id="doc_id", text="text", min_words: int = MIN_WORDS,
    deleted: str | None = None, least_left: float | None = None,
) -> DataFrame:
    """``docs`` with repeated blocks deleted from the text of later documents.

    Later means a larger ``doc_id``; rows that share id and text are one
    document, and different texts under one id are ordered by a hash.  A line
    without words neither counts nor ends a block.  A text that loses all its
    words ends without any; rows with a null id or text stay as they are, and an empty
    table gives no rows.  With ``deleted``, a column of that name lists the
    places of the deleted lines, counted among the lines with words.  With
    ``least_left``, a document goes if it loses lines and then has no words or
    less than that share of them.  Other columns are kept, whatever their names.
    """
    gone = repeated_lines(docs, doc_id=doc_id, text=text, min_words=min_words)
    name = deleted or free_name(docs.columns, "deleted")
    keyed = [free_name(docs.columns, n) for n in ("gone_id", "gone_version")]
    gone = gone.select(F.col("id").alias(keyed[0]), F.col("version").alias(keyed[1]), F.col("places").alias(name))
    same = (F.col(doc_id).cast("bigint") == F.col(keyed[0])) & (F.xxhash64(text) == F.col(keyed[1]))
    joined = docs.join(gone.hint("shuffle_hash"), same, "left").select(*docs.columns, name)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, batch.column(place)):
                cut = rows.column(rows.num_columns - 1)
                if cut.null_count < len(cut):
                    before = rows.column(place).to_pylist()
                    texts = [t if c is None else without_lines(t, c) for t, c in zip(before, cut.to_pylist())]
                    rows = rows.set_column(place, rows.schema.field(place), pa.array(texts, rows.column(place).type))
                    if least_left is not None:
                        stays = [a is b or _enough(b, a, least_left) for a, b in zip(before, texts)]
                        rows = rows.filter(pa.array(stays))
                yield rows

    cleaned = joined.mapInArrow(run, joined.schema)
    return cleaned if deleted else cleaned.drop(name)


def _enough(left: str, text: str, share: float) -> bool:
    words = len(left.split())
    return words > 0 and words >= share * len(text.split())


def drop_repeated(docs: DataFrame, *, least_left: float = 0.0, **options) -> DataFrame:
    """``dedup_lines``, without the documents of which no word is left."""
    return dedup_lines(docs, least_left=least_left, **options)
