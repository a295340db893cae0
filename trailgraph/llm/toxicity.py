"""Toxicity by a counterfactually regularised linear classifier.

The features are words and parts of words that tell the labels apart in a
bounded sample of labelled documents.  The fit adds to the usual loss a penalty
on how much a score changes when the identity terms of a labelled document are
swapped for others of their kind or for nothing, so that naming a group does not
make a text toxic.  Identity terms are always features, so the penalty can reach them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trailgraph.llm.common import add_struct, crc32_remainder, free_name, slices, workspace

#: Labelled documents that the fit reads at most: those with the smallest hashes.
SAMPLE_ROWS = 12_000
#: Features kept, and documents of the sample that a feature is in at least.
FEATURES = 768
LEAST_DOCS = 4
#: Standard errors by which its rates under the two labels differ at least.
LEAST_STRENGTH = 3.0
#: Words whose features a task remembers.
KNOWN_WORDS = 150_000
#: Letters of a word beyond which its features are not remembered.
LONG_WORD = 64
#: Weight of the swap penalty and of the ridge.
SWAP_PENALTY = 10.0
RIDGE = 1e-4
# Groups of terms that can stand for each other.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["female", "male", "transgender", "nonbinary"],
    ["gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"],
    ["black", "white", "asian", "latino", "african", "european", "arab"],
    ["mexican", "chinese", "american", "german", "french", "spanish", "indian", "turkish"],
    ["immigrants", "refugees", "foreigners", "citizens"],
    ["immigrant", "refugee", "foreigner", "citizen"],
    ["disabled", "deaf", "blind", "autistic"],
    ["old", "young", "elderly"],
    ["mujeres", "hombres"], ["mujer", "hombre"], ["musulmanes", "cristianos", "judíos"],
    ["femmes", "hommes"], ["femme", "homme"], ["musulmans", "chrétiens", "juifs"],
    ["frauen", "männer"], ["frau", "mann"], ["muslime", "christen", "juden"],
]
_WORD = re.compile(r"[^\W_]+")
_SWAPS = {term: group[(k + 1) % len(group)] for group in IDENTITY_TERMS for k, term in enumerate(group)}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def word_features(word: str) -> Iterator[str]:
    """The word and all its parts of 4 and 5 letters, its ends marked; a long word goes by its hash."""
    marked = f"^{word}$"
    for n in (4, 5):
        for k in range(len(marked) - n + 1):
            yield marked[k : k + n]
    yield marked if len(word) <= LONG_WORD else f"^#{sha256(word.encode(errors='surrogatepass')).hexdigest()}$"


def _features(words: set[str], parts_of: dict[str, list]) -> set[str]:
    found: set[str] = set()
    for word in words:
        if len(word) > LONG_WORD:
            found.update(word_features(word))
            continue
        parts = parts_of.get(word)
        if parts is None:
            parts = parts_of[word] = [] if word in _SWAPS else list(set(word_features(word)))
        found.update(parts)
    return found


class Model:
    """Weights of features, the bias, and what each word met so far contributes."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.number = {feature: k for k, feature in enumerate(weights)}
        self.known: dict[str, tuple[int, ...]] = {}

    def present(self, text: str | None) -> list[int]:
        """Numbers of the features in a text, each once."""
        known, found = self.known, set()
        if len(known) > KNOWN_WORDS:
            known.clear()
        for word in set(words_of(text)):
            numbers = known.get(word)
            if numbers is None:
                parts = [f"^{word}$"] if word in _SWAPS else word_features(word)
                numbers = tuple({self.number[p] for p in parts if p in self.number})
                if len(word) <= LONG_WORD:
                    known[word] = numbers
            if numbers:
                found.update(numbers)
        return sorted(found)

    def scores(self, texts: list[str | None]) -> list[float]:
        weights = list(self.weights.values())
        sums = [self.bias + sum(weights[k] for k in self.present(text)) for text in texts]
        return (1 / (1 + np.exp(-np.clip(sums, -30, 30)))).tolist()


def swapped(words: set[str]) -> set[str]:
    """The words with every identity term replaced by the next of its kind."""
    return {_SWAPS.get(word, word) for word in words}


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str,
                   held_out, rows: int) -> DataFrame:
    """``(text, label)`` of at most ``rows`` labelled documents outside ``held_out``.

    The sample is of the smallest hashes, so it is the same on every run.  An id
    counts once: with the smallest of its texts, and as toxic if any of its labels is.
    Labels are broadcast: ``rows`` ids and labels, a proven bound.
    """
    wanted = (
        labels.select(F.col(f"`{doc_id}`").alias("of"), F.col(f"`{label}`").cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("of").isNotNull())
        .filter(~held_out("of"))
        .groupBy("of").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("of"), "of")
        .limit(rows)
    )
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    met = texts.join(F.broadcast(wanted), F.col("id") == F.col("of"))
    return met.groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label")


def choose_features(sample: DataFrame, features: int, least: int) -> list[str]:
    """The features that tell the labels apart best, counted over the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_of: dict[str, list] = {}
        counts = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[label].update(_features(set(words_of(text)), parts_of))
                if len(counts[0]) + len(counts[1]) > 1_000_000:
                    yield from _counted(counts)
                    counts, parts_of = (Counter(), Counter()), {}
        yield from _counted(counts)

    per_label = sample.groupBy("label").count().collect()
    totals = {row["label"]: row["count"] for row in per_label}
    if len(totals) < 2:
        return []
    found = sample.mapInArrow(run, "feature string, clean bigint, toxic bigint").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    rate_1, rate_0 = F.col("toxic") / totals[1], F.col("clean") / totals[0]
    spread = F.sqrt((F.col("toxic") + 1) / totals[1] ** 2 + (F.col("clean") + 1) / totals[0] ** 2)
    best = (
        found.filter(F.col("toxic") + F.col("clean") >= least)
        .withColumn("strength", F.abs(rate_1 - rate_0) / spread)
        .filter(F.col("strength") >= LEAST_STRENGTH)
        .orderBy(F.desc("strength"), "feature")
        .limit(features)
    )
    return [row["feature"] for row in best.select("feature").collect()]


def _counted(counts: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
    names = list(counts[0].keys() | counts[1].keys())
    for at in range(0, len(names), 50_000):
        some = names[at : at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.string()), *[pa.array([c[n] for n in some], pa.int64()) for c in counts]],
            names=["feature", "clean", "toxic"],
        )


def fit(
    docs: DataFrame, labels: DataFrame, held_out, *, label="toxic", doc_id="doc_id", text="text",
    sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, swap_penalty: float = SWAP_PENALTY,
) -> Model:
    """A model from labelled documents for which ``held_out(column)`` is false.

    Without documents of both labels, every score is the share of toxic ones
    (one half without any).  A null text counts as empty, and an id once, however
    many rows have it; labels other than 0 and 1, and of null ids, do not count.
    Other columns may have any names.
    """
    space = workspace(docs.sparkSession, "toxicity")
    sample = space.write(
        "sample", bounded_sample(docs, labels, label, doc_id, text, held_out, sample_rows)
    ).df
    chosen = choose_features(sample, features, LEAST_DOCS)
    if not chosen:
        share = sample.agg(F.avg("label")).first()[0]
        return Model({}, 0.0 if share is None else float(np.log((share + 0.01) / (1.01 - share))))
    identity = [f"^{term}$" for term in _SWAPS]
    model = Model(dict.fromkeys([*chosen, *identity], 0.0), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            real = [model.present(t) for t in texts]
            sets = [set(words_of(t)) for t in texts]
            other = [model.present(" ".join(swapped(words))) for words in sets]
            plain = [model.present(" ".join(words - _SWAPS.keys())) for words in sets]
            numbers = [pa.array(column, pa.list_(pa.int32())) for column in (real, other, plain)]
            yield pa.RecordBatch.from_arrays(
                [*numbers, batch.column(1)], names=["real", "swapped", "plain", "label"]
            )

    # at most ``sample_rows`` rows of at most as many numbers as there are features
    rows = sample.mapInArrow(run, "real array<int>, swapped array<int>, plain array<int>, label int").collect()
    real = np.zeros((len(rows), len(model.weights)), np.float32)
    changes = []
    for number, row in enumerate(rows):
        real[number, row["real"]] = 1
        for other in (row["swapped"], row["plain"]):
            if other != row["real"]:
                changes.append(real[number].copy())
                changes[-1][other] -= 1
    change = np.array(changes, np.float32).reshape(-1, real.shape[1])
    weights, bias = _solve(real, np.array([row["label"] for row in rows]), change, swap_penalty)
    return Model(dict(zip(model.weights, weights.tolist())), bias)


def _solve(x: np.ndarray, y: np.ndarray, change: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Newton steps for the mean logistic loss, the mean squared change of the
    score under swaps, and a small ridge."""
    n, width = x.shape
    weight = np.full(n, 1 / n)
    both = np.hstack([x, np.ones((n, 1), np.float32)])
    fixed = np.zeros((width + 1, width + 1))
    fixed[:width, :width] = RIDGE * np.eye(width)
    if len(change):
        fixed[:width, :width] += penalty / len(change) * (change.T @ change)
    theta = np.zeros(width + 1)
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(both @ theta, -30, 30)))
        gradient = both.T @ (weight * (p - y)) + fixed @ theta
        scaled = both * (weight * np.maximum(p * (1 - p), 1e-6))[:, None].astype(np.float32)
        step = np.linalg.solve(both.T @ scaled + fixed + 1e-9 * np.eye(width + 1), gradient)
        theta -= step
        if np.abs(step).max() < 1e-4:
            break
    return theta[:width], float(theta[width])


def score(docs: DataFrame, model: Model, *, text="text") -> tuple[DataFrame, str]:
    """``docs`` with a struct column holding ``score``, and its name; a null or
    empty text gets the score of a text without any feature.  All rows stay, repeated
    ones and other columns too."""
    name = free_name(docs.columns, "toxicity")
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def make():
        mine = Model(*shared.value)

        def compute(texts: pa.Array) -> pa.Array:
            return pa.array([{"score": s} for s in mine.scores(texts.to_pylist())], pa.struct({"score": pa.float64()}))

        return compute

    return add_struct(docs, text, name, "score double", make), name


def held_out(column: str):
    """A fifth of the documents, by crc32 of the id, is never learned from."""
    return crc32_remainder(column, 5) == 0


def drop_toxic(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """``docs`` without those that score one half or more; rows that repeat go or
    stay together, and columns stay whatever their names."""
    model = fit(docs, labels, held_out, **columns)
    found, name = score(docs, model, text=columns.get("text", "text"))
    return found.filter(F.col(f"{name}.score") < 0.5).drop(name)
