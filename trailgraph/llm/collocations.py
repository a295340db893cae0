"""Phrase collocations, mined with stripes.

A stripe is an associative counter of the words that follow a prefix.  Each
slice of texts gives one stripe for each prefix of two words, and one for the
empty prefix, whose counter holds the words themselves.  A phrase that ends its
piece is followed by the empty word.  Stripes of a prefix are merged element by
element, and the merged ones hold everything: an entry counts an extension, the
total of a stripe counts its prefix, and the largest entry says whether a longer
phrase subsumes the prefix.

The prefixes that stand for more than a thousandth of all words, and the empty
one, are cut into segments by a hash of the next word, so that no task merges a
hot stripe alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from trailgraph.llm.common import slices, workspace
from trailgraph.llm.words import byte_class, hashes_of, words_of

LEAST = 10
TOP = 2000
#: Words of a candidate at most; the stripes are made for this length.
LONGEST = 3
#: Bytes of text whose stripes are merged before they are shuffled.
STRIPE_BYTES = 6 << 20
#: Rows of stripes that leave a task at once, and bytes of text looked through for hot prefixes.
BATCH_ROWS = 1 << 16
HOT_BYTES = 2 << 20
#: A prefix with more than this share of all words is hot, and cut into segments.
HOT_SHARE = 1e-3
SEGMENTS = 64
# Bytes that end a piece, and bytes between words.
_STOPS = b".,;:!?\n\x0b\x0c\r"
_GAPS = b" \t" + _STOPS
_TOTAL = "\n"
_STRIPES = "prefix string, nexts string, counts string"


def _grams(lang: pa.Array, text: pa.Array) -> tuple[np.ndarray, ...]:
    """For each word: the place of its language, and its and the next two words'
    places (0: the piece has ended); then the distinct languages and words."""
    words = words_of(text, byte_class(_GAPS), byte_class(_STOPS))
    langs = lang.dictionary_encode()
    first = words.code + np.int32(1)
    second, third = np.zeros_like(first), np.zeros_like(first)
    goes_on = (words.row[1:] == words.row[:-1]) & (words.piece[1:] == words.piece[:-1])
    second[:-1][goes_on] = first[1:][goes_on]
    both = goes_on[:-1] & goes_on[1:]
    third[:-2][both] = first[2:][both]
    place = langs.indices.to_numpy()[words.row]
    names = pa.concat_arrays([pa.array([""], pa.string()), words.distinct])
    return place, first, second, third, langs.dictionary.cast(pa.string()), names


def _counted(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct rows of the columns in order, and how often each occurs."""
    if not len(columns[0]):
        return (*columns, np.zeros(0, np.int64))
    widths = [int(c.max()) + 1 for c in columns]
    if np.prod([float(w) for w in widths]) < 2.0**62:
        key = columns[0].astype(np.int64)
        for column, width in zip(columns[1:], widths[1:]):
            key *= width
            key += column
        key.sort()
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        rows, rest, found = len(key), key[new], []
        del key
        for width in reversed(widths[1:]):
            rest, digit = np.divmod(rest, width)
            found.append(digit.astype(np.int32))
        found = [rest.astype(np.int32), *reversed(found)]
    else:
        order = np.lexsort(columns[::-1])
        rows = len(order)
        ordered = [c[order] for c in columns]
        differs = np.logical_or.reduce([c[1:] != c[:-1] for c in ordered])
        new = np.flatnonzero(np.concatenate([[True], differs]))
        found = [c[new] for c in ordered]
    return (*found, np.diff(np.append(new, rows)))


def _taken(values: tuple[pa.Array, ...], places: list[np.ndarray]) -> list[pa.Array]:
    return [v.take(pa.array(p)) for v, p in zip(values, places)]


def _prefixes(lang: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """The words, a blank between, then a tab and the language."""
    return pc.binary_join_element_wise(pc.binary_join_element_wise(first, second, " "), lang, "\t")


def hot_prefixes(docs: DataFrame, space) -> list[str]:
    """Prefixes of two words that stand for more than ``HOT_SHARE`` of all words, and some more.

    A slice tells those above half the share within it; one above the share
    overall cannot lose more than half of it that way.  So at most
    ``2 / HOT_SHARE`` prefixes are told to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, batch.column(1), min(HOT_BYTES, STRIPE_BYTES)):
                place, first, second, _, langs, names = _grams(*rows.columns)
                *pair, count = _counted(place, first, second)
                del place, second, _
                often = count > HOT_SHARE / 2 * len(first)
                told = _prefixes(*_taken((langs, names, names), [column[often] for column in pair]))
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([told, pa.nulls(1, pa.string())]), pa.array([*count[often], len(first)])],
                    names=["prefix", "rows"],
                )
                del first, pair, count, often, told, langs, names
                pa.default_memory_pool().release_unused()

    told = docs.mapInArrow(run, "prefix string, rows bigint").groupBy("prefix").agg(F.sum("rows").alias("rows"))
    told = space.write("hot", told).df
    words = told.filter("prefix IS NULL").first()
    least = HOT_SHARE / 2 * words["rows"] if words else 0
    return [r["prefix"] for r in told.filter(F.col("prefix").isNotNull() & (F.col("rows") > least)).collect()]


def stripes(docs: DataFrame, hot: list[str]) -> DataFrame:
    """The stripes of each slice of ``docs`` (``lang``, ``text``): next words, and
    the total before their counts, blanks between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = pa.array([str(k) for k in range(SEGMENTS)])
        wide = pa.array(hot, pa.string())
        for batch in batches:
            for rows in slices(batch, batch.column(1), STRIPE_BYTES):
                place, first, second, third, langs, names = _grams(*rows.columns)
                if not len(first):
                    continue
                part = (hashes_of(names) % np.uint64(SEGMENTS)).astype(np.int64)
                lang, segment, word, count = _counted(place, part[first], first)
                new = _starts([lang, segment])
                prefix = pc.binary_join_element_wise(*_taken((parts, langs), [segment[new], lang[new]]), "\t\t")
                yield from _stripes_of(new, prefix, word, count, names)
                *key, word, count = _counted(place, first, second, third)
                del place, first, second, third, lang
                # of each pair of words, where its entries start, its prefix, and whether that is hot
                new = _starts(key)
                prefix = _prefixes(*_taken((langs, names, names), [column[new] for column in key]))
                hot_pair = pc.is_in(prefix, wide).to_numpy(zero_copy_only=False)
                pair = np.repeat(np.arange(len(new), dtype=np.int32), np.diff(np.append(new, len(word))))
                del key, new, langs
                cut = hot_pair[pair]
                segment = np.where(cut, part[word], 0).astype(np.int32)
                if cut.any():  # the entries of a segment together
                    order = np.lexsort((word, segment, pair))
                    pair, segment, word, count = (column[order] for column in (pair, segment, word, count))
                    del order
                new = _starts([pair, segment])
                pair, segment = pair[new], segment[new]
                marks = pc.if_else(pa.array(hot_pair[pair]), parts.take(pa.array(segment)), "")
                prefix = pc.binary_join_element_wise(marks, prefix.take(pa.array(pair)), "\t")
                del cut, pair, segment, marks
                yield from _stripes_of(new, prefix, word, count, names)
                del new, prefix, word, count, names
                pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, _STRIPES)


def _starts(key: list[np.ndarray]) -> np.ndarray:
    """Where runs of rows with the same ``key`` start."""
    differs = np.logical_or.reduce([column[1:] != column[:-1] for column in key])
    return np.concatenate([[0], np.flatnonzero(differs) + 1])


def _stripes_of(new, prefix: pa.Array, word, count, names: pa.Array) -> Iterator[pa.RecordBatch]:
    """One row for each run of entries, which start at ``new``; ``BATCH_ROWS`` at a time."""
    ends = np.append(new, len(word))
    for at in range(0, len(new), BATCH_ROWS):
        bounds = ends[at : at + BATCH_ROWS + 1]
        first, after = int(bounds[0]), int(bounds[-1])
        bounds = bounds - first
        counts = count[first:after]
        total = pa.array(np.add.reduceat(counts, bounds[:-1])).cast(pa.string())
        bounds = pa.array(bounds.astype(np.int32))
        nexts = pa.ListArray.from_arrays(bounds, names.take(pa.array(word[first:after])))
        counts = pa.ListArray.from_arrays(bounds, pa.array(counts).cast(pa.string()))
        # copied, so that the batch doesn't hold, or send, the prefixes of the others
        some = prefix.take(pa.array(np.arange(at, at + len(bounds) - 1)))
        yield pa.RecordBatch.from_arrays(
            [some, pc.binary_join(nexts, " "),
             pc.binary_join_element_wise(total, pc.binary_join(counts, " "), " ")],
            names=["prefix", "nexts", "counts"],
        )


def merged_stripes(told: DataFrame, least: int) -> DataFrame:
    """``(prefix, next, n)`` of the merged stripes; ``next`` is a line feed for the total.

    Stripes meet by prefix, segment included, and are merged by an aggregation
    that needs no other shuffle and may spill.  What occurs fewer than ``least``
    times is dropped here, but for totals of segments.  No entry of a prefix
    occurs more often than the prefix, so rare prefixes go before their stripes
    are taken apart.
    """
    entry = F.explode(
        F.arrays_zip(
            F.concat(F.array(F.lit(_TOTAL)), F.split("nexts", " ")).alias("next"), F.split("counts", " ").alias("n")
        )
    )
    total = F.sum(F.substring_index("counts", " ", 1).cast("bigint")).over(Window.partitionBy("prefix"))
    often = told.repartition("prefix").withColumn("total", total).filter(
        (F.col("total") >= least) | ~F.col("prefix").startswith("\t")
    )
    entries = often.select("prefix", entry.alias("entry"))
    merged = (
        entries.select("prefix", F.col("entry.next").alias("next"), F.col("entry.n").cast("bigint").alias("n"))
        .groupBy("prefix", "next").agg(F.sum("n").alias("n"))
    )
    of_segment = (F.col("next") == _TOTAL) & ~F.col("prefix").startswith("\t")
    return merged.filter((F.col("n") >= least) | of_segment)


def collocations(
    docs: DataFrame, *, text="text", lang="lang", least: int = LEAST, top: int | None = TOP,
    subsumed: tuple[int, int] = (50, 100),
) -> DataFrame:
    """The best-scoring phrases of two and three words of each language.

    Columns: ``lang, rank, phrase, a, l, r, n, score``.  A null language is
    ``und``; a null or empty text has no words; rows that repeat count each
    time; equal scores are ordered by ``a``, then by the bytes of the phrase; an
    empty table gives no rows.  Other columns are not looked at.  Words are kept
    apart by blanks and tabs, pieces end at ``.,;:!?`` and line ends, and A-Z
    become a-z.  A candidate occurs ``least`` times; ``score`` is a million
    times ``a * a / (l * r)`` for the cut with the lowest score, floored, in
    exact arithmetic as long as ``a`` is below 10^16.  Candidates inside a
    longer candidate with the share ``subsumed`` of their count are dropped.
    ``top`` rows of each language are returned, all without it.
    """
    spark = docs.sparkSession
    space = workspace(spark, "collocations")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    told = space.write(
        "merged", merged_stripes(stripes(rows, hot_prefixes(rows, space)), least)
    ).df
    prefix = told.withColumn("prefix", F.expr("substring(prefix, instr(prefix, '\t') + 1)"))  # without the segment
    named = prefix.select(
        F.substring_index("prefix", "\t", 1).alias("words"),
        F.expr("substring(prefix, instr(prefix, '\t') + 1)").alias("lang"),
        "next",
        "n",
    )
    totals = named.filter(F.col("next") == _TOTAL)
    entries = named.filter((F.col("next") != _TOTAL) & (F.col("next") != ""))
    in_all = totals.filter("words = ''").groupBy("lang").agg(F.sum("n").alias("n"))
    singles = entries.filter("words = ''").select("lang", F.col("next").alias("word"), F.col("n").alias("f"))
    first, second = F.substring_index("words", " ", 1), F.substring_index("words", " ", -1)
    pairs = space.write(
        "pairs",
        totals.filter("words <> '' AND NOT endswith(words, ' ')").groupBy("lang", "words").agg(F.sum("n").alias("a"))
        .filter(F.col("a") >= least).select("lang", "words", first.alias("w1"), second.alias("w2"), "a"),
    ).df
    triples = entries.filter("words <> ''").select(
        "lang", "words", first.alias("w1"), F.concat_ws(" ", second, "next").alias("rest"),
        F.col("next").alias("w3"), F.col("n").alias("a"),
    )

    def count_of(table: DataFrame, key: str, name: str, found: str, value: str) -> DataFrame:
        return table.select("lang", F.col(found).alias(key), F.col(value).alias(name))

    part, whole = subsumed
    right = triples.groupBy("lang", "words").agg(F.max("a").alias("longer"))
    left = triples.groupBy("lang", F.col("rest").alias("words")).agg(F.max("a").alias("longer"))
    longer = right.unionByName(left).groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    two = (
        pairs.join(longer, ["lang", "words"], "left")
        .filter(F.col("longer").isNull() | (F.lit(whole) * F.col("longer") < F.lit(part) * F.col("a")))
        .join(count_of(singles, "w1", "l", "word", "f"), ["lang", "w1"])
        .join(count_of(singles, "w2", "r", "word", "f"), ["lang", "w2"])
        .select("lang", F.col("words").alias("phrase"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    )
    cuts = (
        triples.join(count_of(pairs, "words", "l2", "words", "a"), ["lang", "words"])
        .join(count_of(pairs, "rest", "r1", "words", "a"), ["lang", "rest"])
        .join(count_of(singles, "w1", "l1", "word", "f"), ["lang", "w1"])
        .join(count_of(singles, "w3", "r2", "word", "f"), ["lang", "w3"])
        .select("lang", F.concat_ws(" ", "words", "w3").alias("phrase"), "a", "l1", "r1", "l2", "r2",
                _score("a", "l1", "r1").alias("s1"), _score("a", "l2", "r2").alias("s2"))
    )
    early = F.col("s1") <= F.col("s2")
    three = cuts.select(
        "lang", "phrase", "a", F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(best))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(in_all, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def _score(a: str, left: str, right: str):
    a, left, right = (F.col(name).cast("decimal(20,0)") for name in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(8,0)") * a * a, left * right)
