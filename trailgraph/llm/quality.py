"""Quality by kernel ridge regression on document statistics.

Random Fourier features stand for a Gaussian kernel over standardised
statistics of a text.  Every task sums its part of the normal equations, the
sums meet in a few more tasks, and the ridge solution is found from one small
matrix.  Scores are calibrated by isotonic regression on a part of the learning
rows that the ridge has not seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trailgraph.llm.common import crc32_remainder, slices, workspace

FEATURES = 256
RIDGE = 1e-3
SEED = 20260
#: Cells of the score histogram that the calibration is fitted to.
CELLS = 1000
#: One learning row in so many calibrates.
CALIBRATION = 4
STATISTICS = [
    "log_words", "word_length", "long_words", "distinct_words", "top_word", "top_three",
    "repeats", "upper", "digits", "punctuation", "symbols", "stops", "log_line_words",
    "repeated_lines", "unlike_letters", "entropy",
]
# Punctuation of prose, and other printable symbols of ASCII.
_PROSE = b".,;:'\"-()?"
_OTHER = b"!#$%&*+/<=>@[\\]^_`{|}~"
_PAIRS = re.compile(rb"(\S+)(?:\s+\1(?!\S))+")


def statistics(text: str | None) -> list[float]:
    """Numbers that describe how a whole text is written; zeros without words."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(raw)
    lower = raw.lower()
    counts = Counter(lower.split())
    common = [count for _, count in counts.most_common(3)]
    lines = [line for line in raw.split(b"\n") if line.strip()]
    letters = np.bincount(np.frombuffer(lower, np.uint8), minlength=256)
    share = letters[letters > 0] / size
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    pieces = sum(raw.count(b"%c" % c) for c in _PROSE)
    odd = sum(raw.count(b"%c" % c) for c in _OTHER)
    upper = sum(letters[97:123]) - np.count_nonzero(
        (array := np.frombuffer(raw, np.uint8)) - 97 < 26
    )
    return [
        float(np.log1p(n)),
        size / n,
        sum(len(w) > 14 for w in words) / n,
        len(counts) / n,
        common[0] / n,
        sum(common) / n,
        repeats / n,
        float(upper) / size,
        float(letters[48:58].sum()) / size,
        pieces / n,
        odd / n,
        (raw.count(b". ") + raw.count(b".\n")) / n,
        float(np.log1p(n / max(1, len(lines)))),
        1 - len(set(lines)) / max(1, len(lines)),
        float((array > 127).sum()) / size,
        float(-(share * np.log2(share)).sum()),
    ]


def document_statistics(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """``(doc_id, x)`` with the statistics of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, batch.column(1)):
                found = [statistics(t) for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "x"]
                )

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text)).mapInArrow(
        run, "doc_id bigint, x array<double>"
    )


class Model:
    """Standardisation, random features, ridge weights and calibration."""

    def __init__(self, mean, spread, features: int = FEATURES, width: int | None = None):
        self.mean, self.spread = np.asarray(mean), np.maximum(np.asarray(spread), 1e-9)
        draw = np.random.default_rng(SEED)
        scale = 1 / np.sqrt(len(self.mean))  # the kernel is as wide as the cloud of documents
        self.directions = draw.normal(0, scale, (len(self.mean), features))
        self.phases = draw.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.steps, self.levels = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.steps, self.levels), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows ``(x, label)`` of the outer products of their features."""
    width = len(model.weights)
    upper = np.triu_indices(width)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(upper[0]) + width)
        for batch in batches:
            phi = model.features(_matrix(batch.column(0)))
            y = batch.column(1).to_numpy().astype(float)
            total += np.concatenate([(phi.T @ phi)[upper], phi.T @ y])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(upper[0]) + width)
        for batch in batches:
            for row in range(batch.num_rows):
                total += batch.column(0).slice(row, 1).flatten().to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = rows.mapInArrow(part, "sums array<double>").repartition(8)
    total = np.zeros(len(upper[0]) + width)
    for row in parts.mapInArrow(meet, "sums array<double>").collect():
        total += np.array(row["sums"])
    gram = np.zeros((width, width))
    gram[upper] = total[: len(upper[0])]
    return gram + np.triu(gram, 1).T, total[len(upper[0]) :]


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing sequence, by pooling neighbours that fall."""
    pools: list[list[float]] = []
    for value, weight in zip(values, weights):
        pools.append([value * weight, weight, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            total, weight, count = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + weight, pools[-1][2] + count]
    return np.concatenate([np.full(count, total / weight) for total, weight, count in pools])


def _calibrate(rows: DataFrame, model: Model) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.clip(model.raw(_matrix(batch.column(0))), -0.5, 1.5)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.floor((raw + 0.5) / 2 * CELLS).astype(np.int32)), batch.column(1)], names=["cell", "label"]
            )

    cells = rows.mapInArrow(run, "cell int, label int").groupBy("cell").agg(
        F.sum("label").alias("good"), F.count(F.lit(1)).alias("rows")
    ).collect()
    if not cells:
        model.steps, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return
    cells.sort(key=lambda row: row["cell"])
    rows_ = np.array([row["rows"] for row in cells], float)
    good = np.array([row["good"] for row in cells], float)
    model.steps = (np.array([row["cell"] for row in cells]) + 0.5) / CELLS * 2 - 0.5
    model.levels = isotonic(good / rows_, rows_)


def fit(known: DataFrame, features: int = FEATURES) -> Model:
    """A model from rows ``(doc_id, x, label)``; without rows every score is one half."""
    moments = [f(F.col("x")[k]) for k in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]
    row = known.agg(F.count(F.lit(1)), *moments).first()
    if not row[0]:
        return Model([0.0] * len(STATISTICS), [1.0] * len(STATISTICS), features)
    model = Model(row[1::2], row[2::2], features)
    calibrates = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION)) == 0
    gram, right = _normal_equations(known.filter(~calibrates).select("x", "label"), model)
    count = max(1.0, gram[-1, -1])
    ridge = RIDGE * count * np.eye(len(gram))
    ridge[-1, -1] = 1e-9 * count
    model.weights = np.linalg.solve(gram + ridge + 1e-12 * np.eye(len(gram)), right)
    _calibrate(known.filter(calibrates).select("x", "label"), model)
    return model


def held_out(column: str):
    """A third of the documents, by crc32 of the id, is never learned from."""
    return crc32_remainder(column, 3) == 1


def score_quality(
    docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text", label="quality",
    features: int = FEATURES,
) -> DataFrame:
    """``(doc_id, score)``, one row per row of ``docs``.

    All labelled documents outside ``held_out`` are learned from; a document
    with several labels counts with the largest.  The texts are read once: their
    statistics are a table, from which the fit and the scores are made.
    """
    space = workspace(docs.sparkSession, "quality")
    table = space.write("statistics", document_statistics(docs, doc_id=doc_id, text=text)).df
    marked = (
        labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    known = space.write("known", table.join(marked, "doc_id").select("doc_id", "x", "label")).df
    model = fit(known, features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = model.scores(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

    return table.mapInArrow(run, "doc_id bigint, score double")
