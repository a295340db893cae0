"""Ranked lexical search over bit-sliced Bloom signatures.

Documents of like size stand side by side in a block.  A signature row of a
block is a bitmap over its documents, and a term sets some rows, once for each
power of two that its occurrences reach.  The rows of a query term, cut with
each other, say for every document of the block at most how often it holds the
term.  The most that this can be worth, summed over the terms of an item, bounds
the score from above.  Every document whose bound does not lie below the score
that is certainly needed is scored anew from its text.

The index is a written table and answers any items.  The score needed is first
taken from one block of every task, so that the second pass knows it everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trailgraph.llm.common import slices, workspace
from trailgraph.llm.words import INCREMENT, byte_class, hashes_of, mixed, words_of

TOP = 20
#: Documents of a block, bytes of their texts, and bits of a signature, at most.
LANES = 1024
BLOCK_BYTES = 4 << 20
BLOCK_BITS = 1 << 25
#: Powers of two of the occurrences of a term that have rows of their own.
LEVELS = 5
#: Rows that a term sets for a power, and rows of a signature for each of those settings.
ROWS = 4
BITS_EACH = 8
#: Bytes of items that are looked for in one pass; more items make more passes.
ITEM_BYTES = 64 << 10
# Bytes that are in no term; the factors of the score.
_GAPS = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_FOLD = bytes(32 if c in _GAPS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_SCALE, _K, _B = 1000, 12, 25
_INDEX = (
    "term string, docs bigint, block int, width int, filled bigint, terms bigint, ids array<bigint>, "
    "sizes array<bigint>, bounds array<bigint>, signature binary, texts binary"
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _at_level(hashes: np.ndarray, level: int) -> np.ndarray:
    return mixed(hashes + np.uint64((level + 1) * INCREMENT & (1 << 64) - 1))


def _rows_of(entries: np.ndarray, width: int) -> np.ndarray:
    """The signature rows of hashed settings, ``(settings, ROWS)``."""
    step = (entries >> np.uint64(32)) | np.uint64(1)
    each = entries[:, None] + step[:, None] * np.arange(ROWS, dtype=np.uint64)
    return (each & np.uint64(width - 1)).astype(np.int64)


def levels_of(times: np.ndarray) -> np.ndarray:
    """How many of the powers 1, 2, 4, ... ``times`` reaches, ``LEVELS`` at most."""
    return np.minimum(np.frexp(times.astype(np.float64))[1], LEVELS)


class _Pending:
    """Documents that wait for their block."""

    def __init__(self):
        self.ids, self.sizes, self.texts, self.entries, self.bytes = [], [], [], [], 0

    def row(self, number: int, width: int) -> dict:
        lanes = -(-len(self.ids) // 8) * 8
        bits = np.zeros((width, lanes), bool)
        for lane, entries in enumerate(self.entries):
            bits[_rows_of(entries, width).ravel(), lane] = True
        data = b"".join(self.texts)
        return {
            "block": number, "width": width, "filled": len(self.ids), "terms": int(sum(self.sizes)), "ids": self.ids,
            "sizes": self.sizes, "bounds": np.cumsum([0, *map(len, self.texts)]).tolist(),
            "signature": np.packbits(bits, axis=1, bitorder="little").tobytes(),
            "texts": pa.compress(data, codec="zstd", asbytes=True),
        }


def build_index(docs: DataFrame, space, *, doc_id="doc_id", text="text"):
    """The index of all documents that have terms, with the observed ``docs`` and ``terms``.

    Its rows are blocks, and counts of the documents of each term in a slice of
    a task.  Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("term", pa.string()), ("docs", pa.int64()), ("block", pa.int32()), ("width", pa.int32()),
            ("filled", pa.int64()), ("terms", pa.int64()), ("ids", pa.list_(pa.int64())),
            ("sizes", pa.list_(pa.int64())), ("bounds", pa.list_(pa.int64())), ("signature", pa.binary()),
            ("texts", pa.binary()),
        ])
        waiting: dict[int, _Pending] = {}
        blocks = 0

        def closed(width: int) -> pa.RecordBatch:
            nonlocal blocks
            blocks += 1
            return pa.RecordBatch.from_pylist([waiting.pop(width).row(blocks - 1, width)], schema)

        for batch in batches:
            for rows in slices(batch, batch.column(1)):
                words = words_of(rows.column(1), byte_class(_GAPS))
                terms = words.distinct
                hashed = hashes_of(words.distinct)
                key = np.sort(words.row.astype(np.int64) * max(1, len(terms)) + words.code)
                new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
                times = np.diff(np.append(new, len(key)))
                row, code = np.divmod(key[new], max(1, len(terms)))
                counts = np.bincount(code, minlength=len(terms))
                yield pa.RecordBatch.from_arrays(
                    [words.distinct, pa.array(counts), *[pa.nulls(len(terms), f.type) for f in list(schema)[2:]]],
                    schema=schema,
                )
                reached = levels_of(times)
                sizes = np.bincount(words.row, minlength=rows.num_rows)
                starts = np.searchsorted(row, np.arange(rows.num_rows + 1))
                ids, texts = rows.column(0).to_pylist(), rows.column(1).cast(pa.binary())
                for number in np.flatnonzero(sizes).tolist():
                    a, b = starts[number], starts[number + 1]
                    own, upto = hashed[code[a:b]], reached[a:b]
                    entries = np.concatenate([_at_level(own[upto > level], level) for level in range(LEVELS)])
                    width = max(512, 1 << (BITS_EACH * len(entries) - 1).bit_length())
                    held = waiting.setdefault(width, _Pending())
                    content = texts[number].as_py()
                    held.ids.append(ids[number])
                    held.sizes.append(int(sizes[number]))
                    held.texts.append(content)
                    held.entries.append(entries)
                    held.bytes += len(content)
                    if held.bytes >= BLOCK_BYTES or len(held.ids) >= min(LANES, max(8, BLOCK_BITS // width)):
                        yield closed(width)
        for width in list(waiting):
            yield closed(width)

    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text))
    return space.write(
        "index", rows.mapInArrow(run, _INDEX), docs=F.sum("filled"), terms=F.sum("terms")
    )


@dataclass(frozen=True)
class Items:
    """Items with the weights of their terms; ``term`` and ``weight`` lie one item after another."""

    names: list
    starts: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    vocabulary: dict[bytes, int]

    def scores(self, worth: np.ndarray) -> np.ndarray:
        """Of each item, the sum of ``worth`` (by term, or by term and lane) over its terms."""
        found = np.zeros((len(self.names), *worth.shape[1:]), np.int64)
        for number in range(len(self.names)):
            here = slice(self.starts[number], self.starts[number + 1])
            found[number] = self.weight[here] @ worth[self.term[here]]
        return found


def weighed(items: list[tuple], df: dict[bytes, int], docs: int) -> Items:
    """``items`` are ``(name, terms)``; terms that no document has are left out."""
    vocabulary: dict[bytes, int] = {}
    starts, term, weight = [0], [], []
    for _, terms in items:
        own: dict[int, int] = {}
        for t in terms:
            if df.get(t):
                number = vocabulary.setdefault(t, len(vocabulary))
                own[number] = own.get(number, 0) + math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1)))
        term.extend(own)
        weight.extend(own.values())
        starts.append(len(term))
    return Items([name for name, _ in items], np.array(starts), np.array(term, np.int64),
                 np.array(weight, np.int64), vocabulary)


def _lengths(sizes: np.ndarray, docs: int, terms: int) -> np.ndarray:
    return np.array([100 - _B + _B * n * docs // terms for n in sizes.tolist()], np.int64)


def _worth(times: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * times // (_SCALE * times + _K * lengths)


def upper_bounds(items: Items, hashed: np.ndarray, signature: np.ndarray, sizes: np.ndarray, lengths: np.ndarray):
    """No less than the score of each item for each document of a block.

    ``signature`` is ``(rows, lanes / 8)``.
    """
    width, lanes = len(signature), len(sizes)
    most = [np.zeros_like(sizes), *[np.minimum((1 << level) - 1, sizes) for level in range(1, LEVELS)], sizes]
    worth = np.stack([_worth(times, lengths) for times in most])
    found = np.zeros((len(items.names), lanes), np.int64)
    if not len(hashed):
        return found
    reached = np.zeros((len(hashed), lanes), np.uint8)
    alive = None
    for level in range(LEVELS):
        rows = _rows_of(_at_level(hashed, level), width)
        here = np.bitwise_and.reduce(signature[rows], axis=1)
        alive = here if alive is None else alive & here
        reached += np.unpackbits(alive, axis=1, count=lanes, bitorder="little")
    return items.scores(worth[reached, np.arange(lanes)])


def _search(index: DataFrame, items: Items, docs: int, terms: int, top: int, needed, first_only: bool) -> DataFrame:
    """``(item, doc_id, score)``: of each task, the best documents of each item.

    With ``first_only``, a task looks at its first block alone.
    """
    context = index.sparkSession.sparkContext
    shared = context.broadcast((items, hashes_of(pa.array(items.vocabulary, pa.binary())), needed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, hashed, least = shared.value
        least = least.copy()
        best: list[list[tuple]] = [[] for _ in wanted.names]
        number = {t: k for t, k in wanted.vocabulary.items()}
        done = False
        for batch in batches:
            if done:
                continue
            for block in range(batch.num_rows):
                width, ids, sizes, bounds, signature, texts = (c[block] for c in batch.columns)
                ids, sizes, bounds = ids.as_py(), np.array(sizes.as_py(), np.int64), bounds.as_py()
                lengths = _lengths(sizes, docs, terms)
                planes = np.frombuffer(signature.as_buffer(), np.uint8).reshape(width.as_py(), -1)
                bound = upper_bounds(wanted, hashed, planes, sizes, lengths)
                content = None
                for lane in np.argsort(-bound.max(axis=0, initial=0), kind="stable").tolist():
                    if not (bound[:, lane] >= least).any():
                        continue
                    if content is None:
                        content = pa.decompress(texts.as_buffer(), bounds[-1], codec="zstd", asbytes=True)
                    own = content[bounds[lane] : bounds[lane + 1]].translate(_FOLD).split()
                    places = np.fromiter(map(number.get, own, repeat(-1)), np.int64, len(own))
                    times = np.bincount(places[places >= 0], minlength=len(number))
                    scores = wanted.scores(_worth(times, lengths[lane]))
                    for item in np.flatnonzero(scores >= least).tolist():
                        held = best[item]
                        held.append((-int(scores[item]), ids[lane] is None, ids[lane] or 0))
                        if len(held) >= 2 * top:
                            held.sort()
                            del held[top:]
                            least[item] = max(least[item], -held[-1][0])
                done = first_only
                if done:
                    break
        found = [(k, None if none else doc, -score) for k, held in enumerate(best)
                 for score, none, doc in sorted(held)[:top]]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        columns = zip(*found) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["item", "doc_id", "score"]
        )

    blocks = index.filter("width IS NOT NULL").select("width", "ids", "sizes", "bounds", "signature", "texts")
    return blocks.mapInArrow(run, "item int, doc_id bigint, score bigint")


def _best(found: DataFrame, key: str, top: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _item_blocks(items: DataFrame, item: str, text: str) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size, an item as a whole."""
    lines = items.select(F.col(item).alias("item"), F.col(text).alias("text")).filter(
        "item IS NOT NULL AND text IS NOT NULL"
    )
    total = lines.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // ITEM_BYTES))
    number = F.pmod(F.xxhash64("item"), F.lit(blocks))
    for block in range(blocks):
        found: dict = {}
        for name, content in lines.filter(number == block).collect() if total else []:
            found.setdefault(name, []).extend(terms_of(content))
        if found:
            yield list(found.items())


def ranked_search(
    docs: DataFrame, items: DataFrame, *, doc_id="doc_id", text="text", item="item_id", item_text="text", top: int = TOP
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the best documents of each item.

    A term is a run of letters and digits and of all characters beyond ASCII;
    A-Z become a-z.  A null or empty text has no terms and is not counted.  A
    null item id or text is no item; items that share an id are one, with the
    terms of both.  Only scores above 0 are listed; equal ones by ascending
    ``doc_id``, null last.  Rows of ``docs`` that repeat are listed each.
    Without documents or items there are no rows.  Other columns are not looked at.

    The index is built in one pass and read twice for each block of items.
    """
    spark = docs.sparkSession
    space = workspace(spark, "lexical-search")
    index = build_index(docs, space, doc_id=doc_id, text=text)
    n_docs, n_terms = index.observed["docs"] or 0, index.observed["terms"] or 0
    kind = items.schema[item].dataType
    found = None
    for block in _item_blocks(items, item, item_text) if n_docs else []:
        asked = {t for _, terms in block for t in terms}
        if not asked:
            continue
        words = spark.createDataFrame([(t.decode(),) for t in sorted(asked)], "term string")
        counts = index.df.filter("term IS NOT NULL").join(F.broadcast(words), "term")
        df = {r["term"].encode(): r["docs"] for r in counts.groupBy("term").agg(F.sum("docs").alias("docs")).collect()}
        wanted = weighed(block, df, n_docs)
        needed = np.ones(len(block), np.int64)
        sample = _best(_search(index.df, wanted, n_docs, n_terms, top, needed, True), "item", top)
        for row in sample.filter(F.col("rank") == top).collect():
            needed[row["item"]] = row["score"]
        best = _best(_search(index.df, wanted, n_docs, n_terms, top, needed, False), "item", top)
        names = spark.createDataFrame(list(enumerate(wanted.names)), f"item int, item_id {kind.simpleString()}")
        part = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id bigint, score bigint")
    return found
