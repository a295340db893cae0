"""Benchmark decontamination with an FM-index per shard of training text.

The words of the phrases make up the alphabet; any other word of a document can
be in no phrase and ends a run.  A shard is some megabytes of whole documents
of one task.  Its runs are sorted by suffix, their last column is kept in a
wavelet matrix, and all phrases are searched backwards at once, through ranks.
The rows found are walked back to sampled suffixes, which gives the places, and
overlapping places merge into spans.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trailgraph.llm.common import add_struct, free_name, workspace

WINDOW = 13
#: Bytes of phrase text searched in one pass; more phrases make more passes.
PHRASE_BYTES = 16 << 20
#: Every so many places of a shard, and where a run starts, the suffix array is kept.
SAMPLED = 16
_END = b"\x00"
# A-Z become a-z; bytes up to 0x7F that are neither digit nor letter part words.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c > 0x7F else 32
    for c in range(256)
)
RESULT = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, n_hit bigint, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Phrases:
    """Windows of items: the words as numbers from 1, and who has each window."""

    def __init__(self, items: Iterable[tuple[object, str | None]], window: int = WINDOW):
        windows: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            words = words_of(text)
            if item is None or not words:
                continue
            for start in range(max(1, len(words) - window + 1)):
                windows.setdefault(tuple(words[start : start + window]), set()).add(str(item))
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.symbols = np.zeros((len(windows), window), np.int32)  # right-aligned
        for row, words in enumerate(windows):
            self.symbols[row, window - len(words) :] = [
                number.setdefault(word, len(number) + 1) for word in words
            ]
        self.items = [sorted(names) for names in windows.values()]
        self.shortest = int(self.lengths.min()) if len(windows) else 0


class WaveletMatrix:
    """Ranks in a sequence of numbers below ``2 ** bits``."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            ones = (values >> bit) & 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = len(values) - int(before[-1])
            self.levels.append((bit, before, zeros))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low = np.zeros_like(places)
        high = places
        for bit, before, zeros in self.levels:
            one = ((symbols >> bit) & 1).astype(bool)
            low_ones, high_ones = before[low], before[high]
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return high - low


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array; zeros are all different, the earlier the smaller.

    Doubles the compared length, each time only among suffixes still tied.
    """
    n = len(symbols)
    ends = symbols == 0
    first = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + int(ends.sum()))
    following = np.append(first[1:], 0)
    key = first * (int(first.max()) + 1) + following
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)

    def number(places: np.ndarray, keys: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Rank sorted ``places``, and return a mask of those still tied."""
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        starts = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
        rank[places] = base[starts]
        alone = new & np.append(new[1:], True)
        return ~alone

    slots = np.arange(n)
    slots = slots[number(order, key[order], slots)]
    step = 2
    while len(slots):
        places = order[slots]
        key = rank[places] * n + rank[np.minimum(places + step, n - 1)]
        inner = np.argsort(key, kind="stable")
        order[slots] = places[inner]
        slots = slots[number(places[inner], key[inner], slots)]
        step *= 2
    return order


class ShardIndex:
    """FM-index over symbols whose runs end in zeros; the last symbol is a zero."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        order = suffix_order(symbols)
        last = symbols[order - 1]
        self.columns = WaveletMatrix(last, max(1, int(alphabet).bit_length()))
        self.last = last
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet + 1))])
        kept = (order % SAMPLED == 0) | (last == 0)
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.kept_places = order[kept]
        self.kept = kept
        self.size = len(symbols)

    def find(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of rows that start with each right-aligned pattern."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        width = patterns.shape[1]
        alive = np.arange(len(patterns))
        for back in range(width):
            alive = alive[(lengths[alive] > back) & (high[alive] > low[alive])]
            if not len(alive):
                break
            symbol = patterns[alive, width - 1 - back]
            start = self.below[symbol]
            low[alive] = start + self.columns.rank(symbol, low[alive])
            high[alive] = start + self.columns.rank(symbol, high[alive])
        return low, high

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of ``rows`` start: back to the nearest sample.

        The starts of runs are samples too, so no walk crosses a zero.
        """
        found = np.empty(len(rows), np.int64)
        open_, row, steps = np.arange(len(rows)), rows.copy(), 0
        while len(open_):
            done = self.kept[row]
            at = open_[done]
            found[at] = (self.kept_places[self.kept_before[row[done]]] + steps) % self.size
            open_, row = open_[~done], row[~done]
            symbol = self.last[row]
            row = self.below[symbol] + self.columns.rank(symbol, row)
            steps += 1
        return found


def _search(texts: pa.Array, phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Words, merged spans and items of each text of a shard."""
    data = [(t or b"").translate(_FOLD) for t in texts.cast(pa.binary()).to_pylist()]
    words = (b" " + _END + b" ").join([*data, b""]).split()
    number = {**phrases.vocabulary, _END: -1}
    symbols = np.fromiter(map(number.get, words, repeat(0)), np.int32, len(words))
    ends = np.flatnonzero(symbols == -1)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    counts = ends - starts
    found = [(int(n), [], []) for n in counts]
    if not phrases.shortest:
        return found
    inside = np.flatnonzero(symbols > 0)
    if not len(inside):
        return found
    breaks = np.flatnonzero(np.diff(inside) > 1)
    run_first = np.concatenate([[0], breaks + 1])
    run_size = np.diff(np.append(run_first, len(inside)))
    long_runs = np.repeat(run_size >= phrases.shortest, run_size)
    run_number = np.repeat(np.arange(len(run_size)), run_size)[long_runs]
    kept = inside[long_runs]
    if not len(kept):
        return found
    # a zero behind each run
    turn = np.append(run_number[1:] != run_number[:-1], True)
    at = np.arange(len(kept)) + np.concatenate([[0], np.cumsum(turn)[:-1]])
    sequence = np.zeros(len(kept) + int(turn.sum()), np.int32)
    sequence[at] = symbols[kept]
    origin = np.zeros(len(sequence), np.int64)
    origin[at] = kept
    index = ShardIndex(sequence, len(phrases.vocabulary))
    low, high = index.find(phrases.symbols, phrases.lengths)
    sizes = np.maximum(high - low, 0)
    if not sizes.any():
        return found
    pattern = np.repeat(np.arange(len(sizes)), sizes)
    rows = np.repeat(low, sizes) + np.arange(len(pattern)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = origin[index.places(rows)]
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + phrases.lengths[pattern], -1)
    hit = np.flatnonzero(np.cumsum(edge) > 0)
    document = np.searchsorted(ends, first)
    for doc, one in sorted(set(zip(document.tolist(), pattern.tolist()))):
        found[doc][2].extend(phrases.items[one])
    cut = np.flatnonzero(np.diff(hit) > 1) + 1
    for span in np.split(hit, cut):
        doc = int(np.searchsorted(ends, span[0]))
        found[doc][1].append((int(span[0] - starts[doc]), int(span[-1] + 1 - starts[doc])))
    return found


def _phrase_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list[list]:
    """The phrase table in blocks of bounded size."""
    lines = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).filter(
        "item IS NOT NULL AND text IS NOT NULL"
    )
    total = lines.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-total // block_bytes)
    if blocks <= 1:
        yield [tuple(row) for row in lines.collect()]
        return
    number = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for block in range(blocks):
        yield [tuple(row) for row in lines.filter(number == block).collect()]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    phrase_bytes: int = PHRASE_BYTES,
) -> tuple[DataFrame, str]:
    """``docs`` and a struct column of ``RESULT``, whose name is returned too.

    ``spans`` are merged ranges of words that lie in an occurrence of a window
    of ``window`` words of an item (all its words, if it has fewer); ``items``
    are the ids of the items with occurring windows, as sorted text.  A null or
    empty text has no words; an item that has a null id or no words is no item;
    items that share an id are one.  Rows of ``docs`` stay as they are, repeated
    ones too.  No row is shuffled: a pass of phrases is a map over the documents,
    and only phrases beyond ``phrase_bytes`` need another one, over a written table.
    """
    spark = docs.sparkSession
    space = workspace(spark, "decontamination")
    name = free_name(docs.columns, "contamination")
    before = free_name(docs.columns, "contamination_before")
    found = None
    for number, block in enumerate(_phrase_blocks(benchmark, item, item_text, phrase_bytes)):
        phrases = spark.sparkContext.broadcast(Phrases(block, window))
        if found is not None:
            found = space.write(f"pass-{number}", found).df.withColumnRenamed(name, before)
        found = _one_pass(docs if found is None else found, text, name, phrases)
        if before in found.columns:
            found = found.withColumn(name, _merged(F.col(before), F.col(name))).drop(before)
    return found, name


def _one_pass(docs: DataFrame, text: str, name: str, phrases) -> DataFrame:
    def make():
        def compute(texts: pa.Array) -> pa.Array:
            return pa.array(
                [
                    {
                        "n_words": n,
                        "spans": [{"start": a, "end": b} for a, b in spans],
                        "n_hit": sum(b - a for a, b in spans),
                        "items": sorted(set(items)),
                    }
                    for n, spans, items in _search(texts, phrases.value)
                ],
                pa.struct(
                    {
                        "n_words": pa.int64(),
                        "spans": pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()})),
                        "n_hit": pa.int64(),
                        "items": pa.list_(pa.string()),
                    }
                ),
            )

        return compute

    return add_struct(docs, text, name, RESULT, make)


def _merged(one, other):
    """Two results of the same row in one: spans that touch or overlap merge."""
    spans = F.array_sort(F.concat(one["spans"], other["spans"]))

    def add(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        touches = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["start"])
        return F.when(
            touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))
        ).otherwise(F.concat(done, F.array(span)))

    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    merged = F.aggregate(spans, empty, add)
    return F.struct(
        one["n_words"].alias("n_words"),
        merged.alias("spans"),
        F.aggregate(merged, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.array_sort(F.array_union(one["items"], other["items"])).alias("items"),
    )


def contaminated(found: DataFrame, name: str, share: int = 20):
    """Whether a ``share``-th of the words or more lie in occurrences."""
    n_hit, n_words = F.col(f"{name}.n_hit"), F.col(f"{name}.n_words")
    return (n_hit > 0) & (F.lit(share) * n_hit >= n_words)


def without_spans(text: str | None, spans) -> str | None:
    """``text`` with spans of words removed, and the blanks around the rest kept."""
    if not text or not spans:
        return text
    raw = text.encode()
    folded = raw.translate(_FOLD)
    places, at = [], 0
    for word in folded.split():
        at = folded.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    kept, done = [], 0
    for span in spans:
        kept.append(raw[done : places[span["start"]][0]])
        done = places[span["end"] - 1][1]
    return b"".join([*kept, raw[done:]]).decode()


def remove_contamination(docs: DataFrame, benchmark: DataFrame, mode: str = "drop", **options) -> DataFrame:
    """``docs`` without contaminated rows (``drop``), or with the spans of
    contaminated rows cut out of their texts (``cut``).  Other rows stay as they are."""
    text = options.get("text", "text")
    found, name = find_contamination(docs, benchmark, **options)
    if mode == "drop":
        return found.filter(~contaminated(found, name)).drop(name)
    cut = F.udf(without_spans, "string")
    cleaned = F.when(contaminated(found, name), cut(F.col(text), F.col(f"{name}.spans")))
    return found.withColumn(text, cleaned.otherwise(F.col(text))).select(*docs.columns)
