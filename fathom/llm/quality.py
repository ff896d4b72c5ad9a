"""Operator 11, a quality classifier: ridge regression on random Fourier features of document statistics, with isotonic calibration.

* A pass over the whole texts gives each document ``STATISTICS``: shapes of words, classes of bytes, repetition of words and lines.
  Texts are read once; the statistics are written out and all else reads those.
* Statistics are standardised by mean and deviation over all documents and projected by fixed random directions: cosines of the
  projections approximate a Gaussian kernel of width ``WIDTH`` times the root of their number.
* Each task sums the normal equations of its labelled rows for each of ``FOLDS`` folds. Features are whole numbers of 2^-12, so sums are
  exact in any order and reruns agree. (FEATURES + 1)(FEATURES + 2) sums a fold reach the driver, whatever the table.
* Isotonic calibration: rows scored by the model of the other folds are counted in bins of a thousandth; pooling adjacent violators over
  these bins (at most ``BINS``) gives a rising function. The final model is of all folds.

Scores are of the text alone: equal texts score equally. Null and empty texts have statistics of 0 and are scored by them. A doc_id with
several labels takes the smallest; each row of a repeated doc_id teaches. Labels other than 0 and 1 are left out. Without usable
labels, or documents, the score is 0.5; with labels of one class it is that class. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import saved, tune

FEATURES = 256
FOLDS = 2
WIDTH = 1.0
RIDGE = 1e-4
FAR = 6.0
UNIT = 1 << 12
BINS = 3000
SEED = 11
STATISTICS = (
    "words", "word_length", "word_spread", "lower", "upper", "digits", "spaces", "marks", "symbols", "beyond_ascii", "capitalised", "all_capitals", "symbol_ends", "symbol_words",
    "short_words", "distinct_words", "repeated_words", "commonest_word", "line_length", "repeated_lines", "entropy", "equal_bytes",
)

SPACE, LOWER, UPPER, DIGIT, MARK, SYMBOL, BEYOND = range(7)
CLASS = np.full(256, SYMBOL, dtype=np.int8)
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = LOWER, UPPER, DIGIT, BEYOND
CLASS[list(b".,;:!?'\"-()")] = MARK


def statistics_of(text: str | None) -> list[float]:
    """The values of ``STATISTICS`` for a text."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    if not len(data):
        return [0.0] * len(STATISTICS)
    kinds = CLASS[data]
    share = np.bincount(kinds, minlength=7) / len(data)
    letters = share[LOWER] + share[UPPER]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], kinds == SPACE, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    counts = np.bincount(data, minlength=256)
    p = counts[counts > 0] / len(data)
    lines = text.split("\n")
    out = [share[LOWER], share[UPPER] / letters if letters else 0.0, share[DIGIT], share[SPACE], share[MARK], share[SYMBOL], share[BEYOND]]
    tail = [np.log1p(len(data) / len(lines)), 1 - len(set(lines)) / len(lines), float(-(p * np.log2(p)).sum()), float((data[1:] == data[:-1]).mean()) if len(data) > 1 else 0.0]
    n = len(starts)
    if not n:
        return [0.0] * 3 + [float(x) for x in out] + [0.0] * 8 + [float(x) for x in tail]
    sizes = ends - starts
    words = text.split()
    tally: dict[str, int] = {}
    for word in words:
        tally[word] = tally.get(word, 0) + 1
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    total = lambda of: np.add.reduceat(np.append(of, 0).astype(np.int64), np.stack([starts, ends], 1).reshape(-1))[::2]
    capitals, plain = total(kinds == UPPER), total((kinds == LOWER) | (kinds == BEYOND) | (kinds == DIGIT))
    shapes = [
        (kinds[starts] == UPPER).mean(), ((capitals > 1) & (plain == 0)).mean(), (kinds[ends - 1] == SYMBOL).mean(), (capitals + plain == 0).mean(), (sizes < 2).mean(),
        len(tally) / max(1, len(words)), again / max(1, len(words)), max(tally.values(), default=0) / max(1, len(words)),
    ]
    return [float(x) for x in (np.log1p(n), sizes.mean(), np.log1p(sizes.std()), *out, *shapes, *tail)]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics array<float>) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [statistics_of(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.list_(pa.float32()))], names=["doc_id", "statistics"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, statistics array<float>")


@dataclass
class Features:
    """Standardised statistics and fixed random directions."""

    mean: np.ndarray
    spread: np.ndarray

    def __post_init__(self) -> None:
        draw, d = np.random.default_rng(SEED), len(STATISTICS)
        self.directions = draw.normal(size=(d, FEATURES)) / (WIDTH * np.sqrt(d))
        self.shifts = draw.uniform(0, 2 * np.pi, FEATURES)

    def of(self, column: pa.ListArray) -> np.ndarray:
        """Whole-number features of a batch, with a constant one."""
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), len(STATISTICS))
        x = np.clip((values - self.mean) / self.spread, -FAR, FAR)
        return np.column_stack([np.rint(np.cos(x @ self.directions + self.shifts) * UNIT), np.full(len(x), float(UNIT))])


@dataclass
class Model:
    """Weights of the features, as whole numbers of 2^-24, and the calibration; no weights: a constant."""

    features: Features
    weights: np.ndarray | None
    raw: list[float]
    calibrated: list[float]

    def raw_bins(self, column: pa.ListArray) -> np.ndarray:
        """The ridge score in thousandths; -1 and 2 are the least and the most."""
        return bins(self.features.of(column) @ self.weights)

    def scores(self, column: pa.ListArray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(column), self.calibrated[0])
        return np.round(np.interp(self.raw_bins(column), self.raw, self.calibrated), 6)


def bins(products: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(products / (UNIT << 24) * 1000), -BINS // 3, BINS * 2 // 3).astype(np.int64)


def standardised(stats: DataFrame) -> Features:
    """Mean and deviation over all documents, of values in thousandths, so that sums are exact."""
    value = lambda i: F.rint(F.get("statistics", F.lit(i)).cast("double") * 1000).cast("long")
    sums = [f for i in range(len(STATISTICS)) for f in (F.sum(value(i)), F.sum((value(i) * value(i)).cast("decimal(38,0)")))]
    n, *got = stats.agg(F.count("*"), *sums).first()
    mean = np.array([float(x or 0) for x in got[::2]]) / max(1, n)
    square = np.array([float(x or 0) for x in got[1::2]]) / max(1, n)
    spread = np.sqrt(np.maximum(square - mean**2, 0.0))
    return Features(mean / 1000, np.where(spread > 0, spread, 1000.0) / 1000)


def normal_equations(taught: DataFrame, features: Features) -> np.ndarray:
    """[fold, i, j]: sums of feature i times feature j over the fold's rows; the last j is the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2), dtype=np.int64)
        for batch in batches:
            fold, x = batch.column("fold").to_numpy(), features.of(batch.column("statistics"))
            both = np.column_stack([x, batch.column("label").to_numpy().astype(np.float64)])
            for f in np.unique(fold):
                sums[f] += (x[fold == f].T @ both[fold == f]).astype(np.int64)  # whole numbers below 2^53, so the product is exact
        if sums.any():
            at = np.indices(sums.shape).reshape(3, -1)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()) for a in at] + [pa.array(sums.reshape(-1))], names=["fold", "i", "j", "total"])

    out = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2), dtype=np.float64)
    for row in taught.mapInArrow(run, "fold int, i int, j int, total long").groupBy("fold", "i", "j").agg(F.sum("total").alias("total")).toArrow().to_batches():
        out[tuple(row.column(c).to_numpy() for c in ("fold", "i", "j"))] = row.column("total").to_numpy()
    return out


def ridge(sums: np.ndarray) -> np.ndarray:
    """Weights, as whole numbers of 2^-24, of the ridge regression with these normal equations."""
    n = max(1.0, sums[-1, FEATURES] / UNIT**2)
    gram, target = sums[:, :-1] / (n * UNIT**2), sums[:, -1] / (n * UNIT)
    penalty = np.full(len(gram), RIDGE)
    penalty[-1] = 0.0
    return np.rint(np.clip(np.linalg.lstsq(gram + np.diag(penalty), target, rcond=None)[0], -64, 64) * (1 << 24))


def isotonic(counted: list[tuple[int, int, int]]) -> tuple[list[float], list[float]]:
    """Pools adjacent violators over (bin, rows, rows of label 1) in order: the points between which scores are interpolated."""
    blocks: list[list[float]] = []
    for at, n, ones in counted:
        blocks.append([at * n, n, ones])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return [b[0] / b[1] for b in blocks], [b[2] / b[1] for b in blocks]


def fitted(taught: DataFrame, features: Features) -> Model:
    """The model of labelled rows (statistics, label, fold)."""
    classes = [row.label for row in taught.select("label").distinct().collect()]
    if len(classes) < 2:
        return Model(features, None, [0.0], [float(classes[0]) if classes else 0.5])
    sums = normal_equations(taught, features)
    whole = sums.sum(axis=0)
    others = [ridge(whole - own) for own in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold = features.of(batch.column("statistics")), batch.column("fold").to_numpy()
            at = np.stack([bins(x @ w) for w in others], 1)[np.arange(len(x)), fold] if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("label")], names=["bin", "label"])

    counted = taught.mapInArrow(run, "bin long, label int").groupBy("bin").agg(F.count("*"), F.sum("label")).orderBy("bin").collect()
    return Model(features, ridge(whole), *isotonic([tuple(row) for row in counted]))


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document; rows whose crc32(doc_id) mod 3 is 1 don't teach."""
    tune(docs.sparkSession)
    stats = saved(statistics(docs), "quality-statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    taught = stats.join(known, "doc_id").where(~held_out()).select("statistics", "label", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    model = fitted(saved(taught, "quality-taught"), standardised(stats))
    return scored(stats, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def scored(stats: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(batch.column("statistics")))], names=["doc_id", "score"])


    return stats.mapInArrow(run, "doc_id long, score double")
