"""Quality scores by Bradley-Terry ranking.

A text is a vector of features of its bytes and words. The utility of a text is linear in them; the chance that one text
is preferred to another is the logistic function of the difference of their utilities. Weights are fitted by the logistic
loss on differences of pairs of labelled texts, one of each label, in a sample of bounded size. A quantile of the utilities
of all labelled training texts, the share of label 0, is the threshold; a score is the chance to be preferred to a text whose utility lies so far below the threshold
that a score of `CUT` means the threshold itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import IS_SEPARATOR, Slice, find_words, list_array, text_slices

#: Labelled texts of each label used for fitting, those with the least hash of their id.
SAMPLE = 20_000
#: Partners of each labelled text.
PARTNERS = 8
#: Distinct utilities that are gathered at once when a quantile is looked for, and cells that narrow it down to them.
BRACKET = 4096
#: Bits of the hash of an id that make a cell of counts.
CELL_BITS = 14
RIDGE = 1e-3
STEPS = 40
CUT = 0.7

FEATURES = (
    "log_words", "log_bytes", "bytes_by_word", "upper", "letters", "digits", "marks", "exclamations", "bars", "lines",
    "distinct", "adjacent", "most_frequent", "capitalised", "stops", "long_words",
)


def _flags(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


UPPER = _flags((65, 90))
LETTERS = _flags((65, 90), (97, 122), (128, 255))
DIGITS = _flags((48, 57))
STOPS = _flags((44, 44), (46, 46))
MARKS = _flags((33, 47), (58, 64), (91, 96), (123, 126)) & ~STOPS
EXCLAMATIONS = _flags((33, 33))
BARS = _flags((124, 124))
LINES = _flags((10, 10))


def text_features(part: Slice) -> np.ndarray:
    """A row of FEATURES for each text; shares are of bytes that aren't blank, or of words; an empty text has zeros."""
    words = find_words(part)
    n = part.last - part.first
    bounds = np.concatenate([[0], np.cumsum(words.counts)])

    def by_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(flags)])
        return np.diff(running[at]).astype(float)

    n_words = words.counts.astype(float)
    dark = by_row(~IS_SEPARATOR[part.data], part.offsets)
    shares = [by_row(table[part.data], part.offsets) / np.maximum(dark, 1) for table in (UPPER, LETTERS, DIGITS, MARKS, EXCLAMATIONS, BARS, LINES)]
    first_bytes, last_bytes = part.data[words.starts], part.data[words.ends - 1]
    adjacent = np.zeros(len(words.hashes), dtype=bool)
    adjacent[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.rows[1:] == words.rows[:-1])
    distinct, most = np.zeros(n), np.zeros(n)
    for row in range(n):
        if words.counts[row]:
            _, times = np.unique(words.hashes[bounds[row] : bounds[row + 1]], return_counts=True)
            distinct[row], most[row] = len(times), times.max()
    by_word = [
        distinct, by_row(adjacent, bounds), most, by_row(UPPER[first_bytes], bounds), by_row(STOPS[last_bytes], bounds),
        by_row(words.ends - words.starts > 12, bounds),
    ]
    columns = [np.log1p(n_words), np.log1p(dark), dark / np.maximum(n_words, 1), *shares, *[x / np.maximum(n_words, 1) for x in by_word]]
    return np.stack(columns, axis=1)


def _measuring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = len(FEATURES)
    for batch in batches:
        for part in text_slices(batch.column("text")):
            n = part.last - part.first
            features = text_features(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(part.first, n), list_array(np.arange(n + 1) * width, features.ravel(), pa.float64())],
                names=["doc_id", "features"],
            )


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, features) for each row of `docs`."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measuring, "doc_id long, features array<double>")


@dataclass
class Ranking:
    """A fitted model: a text's utility is (features - mean) / scale times weights."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def utilities(self, features: np.ndarray) -> np.ndarray:
        return self._widened((features - self.mean) / self.scale) @ self.weights

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.utilities(features) - self.threshold + np.log(CUT / (1 - CUT)), -500, 500)))

    @staticmethod
    def _widened(standard: np.ndarray) -> np.ndarray:
        """The clipped features and their squares, as junk may be too much or too little of something."""
        clipped = np.clip(standard, -6, 6)
        return np.concatenate([clipped, clipped**2 / 6], axis=1)


def fit(features: np.ndarray, labels: np.ndarray, seed: int = 7) -> Ranking:
    """A model from labelled rows. Without rows of both labels nothing can be ranked: all texts get the score 1 - CUT or
    CUT, whichever label there is (CUT without any)."""
    width = len(FEATURES)
    if len(np.unique(labels)) < 2:
        lower = 1.0 if len(labels) and not labels.any() else 0.0
        return Ranking(np.zeros(width), np.ones(width), np.zeros(2 * width), 2 * lower * np.log(CUT / (1 - CUT)))
    mean, scale = features.mean(axis=0), features.std(axis=0)
    scale[scale < 1e-9] = 1.0
    x = Ranking._widened((features - mean) / scale)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    draw = np.random.Generator(np.random.PCG64(seed))
    winners = np.concatenate([np.repeat(good, PARTNERS), draw.choice(good, PARTNERS * len(bad))])
    losers = np.concatenate([draw.choice(bad, PARTNERS * len(good)), np.repeat(bad, PARTNERS)])
    difference = x[winners] - x[losers]
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):  # Newton steps on the mean logistic loss with a ridge
        p = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))
        gradient = difference.T @ p / len(p) - RIDGE * w
        curvature = (difference * (p * (1 - p))[:, None]).T @ difference / len(p) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    utility = np.sort(x @ w)
    at = len(bad)
    return Ranking(mean, scale, w, float((utility[at - 1] + utility[at]) / 2))


def training_rows(doc_id: Column) -> Column:
    """Rows whose labels may be learned: crc32 of the id as text doesn't leave 2 on division by 4. No id: as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 != 2


def by_features(compute, name: str):
    """For `mapInArrow` over (doc_id, features): (doc_id, what `compute` makes of the features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = batch.column("features").flatten().to_numpy().reshape(len(batch), len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(compute(features))], names=["doc_id", name])

    return run


def between(values: DataFrame, at: int) -> float:
    """The middle of the values in places `at` and `at` + 1 (from 1) of (u, n), distinct values with their numbers.

    Counts in equal cells narrow the range that holds both places until its distinct values are few.
    """
    low, high = values.agg(F.min("u"), F.max("u")).first()
    below = 0
    while True:
        inside = values.where(F.col("u").between(low, high))
        if low == high or inside.count() <= BRACKET:
            break
        cell = F.least(F.floor((F.col("u") - low) / F.lit(high - low) * BRACKET), F.lit(BRACKET - 1))
        cells = sorted(tuple(r) for r in inside.groupBy(cell.alias("cell")).agg(F.sum("n"), F.min("u"), F.max("u")).collect())
        reach = below + np.cumsum([c[1] for c in cells])
        first, last = (int(np.searchsorted(reach, place)) for place in (at, at + 1))
        if (low, high) == (cells[first][2], cells[last][3]):
            break
        below = int(reach[first] - cells[first][1])
        low, high = cells[first][2], cells[last][3]
        if first < last:  # the two places are the ends of neighbouring cells
            return (cells[first][3] + cells[last][2]) / 2
    found = sorted((r["u"], r["n"]) for r in inside.collect())
    reach = below + np.cumsum([n for _, n in found])
    return sum(found[int(np.searchsorted(reach, place))][0] for place in (at, at + 1)) / 2


def first_by_hash(rows: DataFrame, sample: int) -> DataFrame:
    """The first `sample` rows of (doc_id, features, ...) by the hash of their id, as a written table.

    Counts in equal cells of the hash tell up to where rows are wanted; only those are ordered, by tasks, so that the
    driver gets counts and `sample` rows however many partitions there are.
    """
    cell = F.shiftright(F.xxhash64("doc_id"), 64 - CELL_BITS)
    counts = sorted(tuple(r) for r in rows.groupBy(cell.alias("cell")).count().collect())
    reach = np.cumsum([n for _, n in counts])
    at = int(np.searchsorted(reach, sample))
    wanted = rows.where(cell <= counts[at][0]) if at < len(counts) else rows
    return materialize(wanted.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(sample), "sample")


def learn(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranking:
    """Weights fitted on at most `sample` labelled training rows of each label, taken by the hash of their id; the threshold
    is that of all labelled training rows."""
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    rows = materialize(measured.join(known, "doc_id").where(training_rows(F.col("doc_id"))), "labelled")
    parts = [first_by_hash(rows.where(F.col("quality") == label), sample).select("features", "quality").toPandas() for label in (0, 1)]
    labels_found = np.concatenate([p["quality"].to_numpy(dtype=int) for p in parts])
    features = [np.stack(p["features"].to_numpy()) for p in parts if len(p)]
    model = fit(np.concatenate(features) if features else np.zeros((0, len(FEATURES))), labels_found)
    if not all(map(len, parts)) or max(map(len, parts)) < sample:
        return model
    utilities = rows.select("doc_id", "features").mapInArrow(by_features(model.utilities, "u"), "doc_id long, u double")
    values = materialize(utilities.groupBy("u").agg(F.count("*").alias("n")), "utilities")
    return replace(model, threshold=between(values, rows.where("quality = 0").count()))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, score, predicted.

    Only the text is an input of a score. NULL and empty texts are scored by their zero features. Labels are read from
    training rows alone; a label other than 0 or 1, or without id, is left out, and several labels of one document all
    count. Repeated rows get equal scores. An empty table gives an empty result.
    """
    measured = materialize(measure(docs), "features")
    model = learn(measured, labels)

    scored = measured.mapInArrow(by_features(model.scores, "score"), "doc_id long, score double")
    return scored.select("doc_id", (~training_rows(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` whose text reaches `CUT`, with all their columns; nothing is shuffled."""
    model = learn(measure(docs), labels)

    def keeping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column("text")):
                rows = batch.slice(part.first, part.last - part.first)
                yield rows.filter(pa.array(model.scores(text_features(part)) >= CUT))

    return docs.mapInArrow(keeping, docs.schema)
