"""Operator 2, toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

* A text's terms are its lower-case words; all of the text counts. A term weighs (1 + ln tf) * idf * lean: idf is counted over all
  documents, lean grows with how surely the term marks toxic examples (the log of its likelihood ratio against chance, beyond
  ``CHANCE``) and is never below ``LEAST``, so that every term keeps a weight. Terms that no example has are in no vector.
* Examples are at most ``max_examples`` labelled documents, chosen by a hash of doc_id; every one of them is indexed with all
  its terms. Their distinct terms reach the driver, and the index, of the same bound, is broadcast.
* The index has postings of rare terms, a dense table of common ones, and the largest weights in each block of examples; examples
  of the same strongest term lie together. Texts are asked for TOGETHER at a time; blocks whose bounds fall short of the k-th
  best cosine of all of them are left out, and the k nearest are exact.
* The vote is the mean label of the k nearest, weighted by a power of the cosine, with a prior of the rate of label 1; it is mapped
  to a calibrated score through the votes on every example, each left out of its own vote.

Null and empty texts have no terms and score the prior's value. Rows with a null doc_id are scored too. Without any usable
label the score is 0. Equal texts score equally; ties of cosine go to the smaller position in the index. A doc_id that several rows share
teaches with its smallest text. Very long texts are counted whole.
"""

from __future__ import annotations

import io
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import give_back, saved, tune

MAX_EXAMPLES = 5_000
CHANCE = 6.0
LEAST = 0.02
NEAREST = 15
SHARP = 4.0
PRIOR = 0.5
BLOCK = 32
FIRST = 2
COMMON = 16
TOGETHER = 64
LETTERS = re.compile(r"[^\W\d_]+").findall


def terms(text: str | None) -> Counter:
    """Counts of the terms of a text."""
    return Counter(LETTERS((text or "").lower()))


def lean(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How surely a term marks toxic texts, from the numbers of toxic and of clean examples that have it: the root of the log of how
    unlikely so large a share of toxic ones is by chance, as far as that goes beyond CHANCE."""
    n, rate = toxic + clean, n1 / max(1, n1 + n0)
    part = lambda k, r: k * np.log(np.maximum(k, 1) / np.maximum(n * r, 1e-300))
    surprise = np.where(toxic > n * rate, part(toxic, rate) + part(clean, 1 - rate), 0.0)
    return LEAST + np.sqrt(np.maximum(0.0, surprise - CHANCE))


def slices(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start .. start + size of every slice, in order."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


@dataclass
class Index:
    """Block-max index of unit vectors over positions of terms; blocks of BLOCK consecutive examples.

    Terms of few examples have postings. Terms of one example in COMMON or more have a column each in a dense table, and of that their
    largest weight in each block: the sum of those, and the best of a block's examples by their rare terms, bounds its cosines.
    """

    labels: np.ndarray
    ids: np.ndarray
    at: np.ndarray  # of each term: its first posting; one more at the end
    docs: np.ndarray
    weights: np.ndarray
    column: np.ndarray  # of each term: its column, or -1
    dense: np.ndarray  # examples, filled up to whole blocks, by columns
    tops: np.ndarray  # blocks by columns
    own: tuple[np.ndarray, np.ndarray, np.ndarray]  # of each example: its first term; terms; weights

    @classmethod
    def build(cls, vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], ids: list[int], size: int) -> Index:
        """vectors: sorted term positions and weights of each example; size: the number of terms."""
        n = np.array([len(v[0]) for v in vectors], np.int64)
        term = np.concatenate([v[0] for v in vectors] or [np.zeros(0, np.int32)], dtype=np.int32, casting="unsafe")
        weight = np.concatenate([v[1] for v in vectors] or [np.zeros(0)])
        doc = np.repeat(np.arange(len(vectors), dtype=np.int32), n)
        often = np.bincount(term, minlength=size) * COMMON >= max(len(vectors), COMMON)
        column = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        blocks = -(-len(vectors) // BLOCK)
        dense = np.zeros((blocks * BLOCK, int(often.sum())))
        many = often[term]
        dense[doc[many], column[term[many]]] = weight[many]
        tops = dense.reshape(blocks, BLOCK, -1).max(axis=1) if blocks else np.zeros((0, dense.shape[1]))
        rare = np.flatnonzero(~many).astype(np.int32)
        rare = rare[np.argsort(term[rare], kind="stable")]
        first = np.concatenate([[0], np.cumsum(n)])
        return cls(np.array(labels, np.int64), np.array(ids, np.int64), np.searchsorted(term[rare], np.arange(size + 1)), doc[rare], weight[rare], column, dense, tops, (first, term, weight))

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skips: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (positions, weights) the k examples of greatest positive cosine (ties: the smaller position) and their
        cosines. skips: of each query an example that is left out, or -1."""
        n, m, blocks = len(self.labels), len(queries), len(self.tops)
        if not n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * m
        rare, common = np.zeros((m, blocks * BLOCK)), np.zeros((m, self.dense.shape[1]))
        for q, (positions, weights) in enumerate(queries):
            columns = self.column[positions]
            common[q, columns[columns >= 0]] = weights[columns >= 0]
            positions, weights = positions[columns < 0], weights[columns < 0]
            size = self.at[positions + 1] - self.at[positions]
            take = slices(self.at[positions], size)
            rare[q, :] = np.bincount(self.docs[take], self.weights[take] * np.repeat(weights, size), blocks * BLOCK)
        bound = rare.reshape(m, blocks, BLOCK).max(axis=2) + common @ self.tops.T
        need = np.zeros((m, blocks), bool)
        for q in range(m):
            best = np.argsort(-bound[q], kind="stable")[:FIRST]
            rows = (best[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            cos = rare[q, rows] + self.dense[rows] @ common[q]
            if skips:
                cos = cos[rows != skips[q]]
            least = np.partition(cos, -k)[-k] if len(cos) >= k else 0.0
            need[q] = bound[q] >= max(least - 1e-9, 1e-12)
        rows = (np.flatnonzero(need.any(axis=0))[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        rows = rows[rows < n]
        every = np.round(rare[:, rows] + common @ self.dense[rows].T, 12)
        out = []
        for q in range(m):
            cos = every[q]
            keep = cos > 0
            if skips and skips[q] >= 0:
                keep &= rows != skips[q]
            if keep.sum() > 4 * k:
                keep &= cos >= np.partition(cos[keep], -k)[-k]
            found, cos = rows[keep], cos[keep]
            top = np.lexsort((found, -cos))[:k]
            out.append((found[top], cos[top]))
        return out

    def nearest(self, positions: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of([(positions, weights)], k, [skip])[0]


@dataclass
class Model:
    words: list[str]
    index: Index
    weight: np.ndarray  # of each word: idf * lean
    base: float
    steps: tuple[np.ndarray, np.ndarray]

    def places(self) -> dict[str, int]:
        return {w: n for n, w in enumerate(self.words)}

    def vector(self, positions: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted positions and weights of the unit vector."""
        order = np.argsort(positions)
        positions = positions[order]
        w = (1 + np.log(counts[order])) * self.weight[positions]
        positions, w = positions[w > 0], w[w > 0]
        return positions, w / np.sqrt(w @ w) if len(w) else w

    def counted(self, text: str | None, place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        found = [(place[w], n) for w, n in terms(text).items() if w in place]
        both = np.array(found, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], skips: list[int] | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        out = []
        for near, cos in self.index.nearest_of(vectors, NEAREST, skips):
            w = np.clip(cos, 0, 1) ** SHARP
            out.append((float((w @ self.index.labels[near] + PRIOR * self.base) / (w.sum() + PRIOR)), near, cos))
        return out

    def scores(self, texts: list[str | None], place: dict[str, int]) -> list[tuple[float, list[int], list[float]]]:
        """Calibrated scores; the nearest examples' doc_ids and cosines as evidence."""
        out = []
        for at in range(0, len(texts), TOGETHER):
            vectors = [self.vector(*self.counted(t, place)) for t in texts[at : at + TOGETHER]]
            for vote, near, cos in self.votes(vectors):
                score = min(1.0, max(0.0, round(float(np.interp(vote, *self.steps)), 9)))
                out.append((score, self.index.ids[near].tolist(), cos.tolist()))
        return out


def calibration(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising map from votes to rates of label 1: pooled adjacent violators, each pool smoothed by its vote."""
    if len(votes) < 50 or labels.min() == labels.max():
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for part in np.array_split(order, min(50, len(votes) // 10)):
        x, n = float(votes[part].mean()), len(part)
        pools.append([x * n, float(labels[part].sum()) + x, n + 1.0, n])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    x, y = np.array([p[0] / p[3] for p in pools]), np.array([p[1] / p[2] for p in pools])
    return np.concatenate([[0.0], x, [1.0]]), np.concatenate([[min(0.0, y[0])], y, [max(1.0, y[-1])]])


def held_out(doc_id: int | str) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def is_held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def examples(docs: DataFrame, labels: DataFrame, max_examples: int) -> tuple[list[str], list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """The words of at most max_examples labelled documents, and of each document (doc_id, toxic, places of its words, counts)."""
    given = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic in (0, 1)").where(~is_held_out())
    given = given.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    given = saved(given.orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(max_examples), "toxicity-examples")
    teach = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(given), "doc_id")  # max_examples rows of 12 bytes
    teach = teach.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [terms(t.as_py()) for t in b.column(2)]
            counts = [np.array(list(g.values()), np.int32).tobytes() for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([" ".join(g) for g in got], pa.string()), pa.array(counts, pa.binary())], ["doc_id", "toxic", "words", "counts"])

    place: dict[str, int] = {}
    out = []
    for r in saved(teach.mapInArrow(run, "doc_id long, toxic int, words string, counts binary"), "toxicity-terms").orderBy("doc_id").toLocalIterator():
        at = np.array([place.setdefault(w, len(place)) for w in r.words.split(" ") if w], np.int32)
        out.append((r.doc_id, r.toxic, at, np.frombuffer(bytes(r.counts), np.int32)))
    return list(place), out


def frequencies(docs: DataFrame, words: list[str]) -> tuple[np.ndarray, int]:
    """In how many rows of docs each word stands, and the number of rows."""
    place = docs.sparkSession.sparkContext.broadcast("\n".join(words).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: n for n, w in enumerate(place.value.decode().split("\n"))}
        found, rows = np.zeros(len(at), np.int64), 0
        for b in batches:
            rows += b.num_rows
            for t in b.column(0):
                found[[at[w] for w in set(LETTERS((t.as_py() or "").lower())) if w in at]] += 1
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(found[some], rows))], ["p", "n"])
        del at
        give_back()

    counts = docs.select("text").mapInArrow(run, "p int, n long").groupBy("p").agg(F.sum("n").alias("n"))
    df, total = np.zeros(len(words), np.int64), 0
    got = counts.toArrow()  # a row a word of the examples
    place.destroy()
    p, n = got.column("p").to_numpy(), got.column("n").to_numpy()
    df[p[p >= 0]] = n[p >= 0]
    return df, int(n[p < 0].sum()) or total


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Model:
    """The model.

    labels (doc_id, toxic): rows with a null or another value than 0 and 1, and rows whose crc32(doc_id) mod 5 is 0, teach
    nothing; a doc_id labelled more than once counts as toxic if any row says so.
    """
    spark = docs.sparkSession
    tune(spark)
    words, rows = examples(docs, labels, max_examples)
    df, total = frequencies(docs, words) if rows else (np.zeros(0, np.int64), 0)
    y = np.array([r[1] for r in rows], np.int64)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    held = np.zeros((2, len(words)), np.int64)
    for _, toxic, at, _ in rows:
        held[toxic, at] += 1
    weight = np.log((1 + total) / (1 + df)) * lean(held[1], held[0], n1, n0)
    none = np.array([0.0, 1.0])
    model = Model(words, Index.build([], [], [], 0), weight, n1 / (len(y) + 1), (none, none))
    vectors = [model.vector(at, counts) for _, _, at, counts in rows]
    strongest = [int(p[np.argmax(w)]) if len(p) else -1 for p, w in vectors]
    order = sorted(range(len(rows)), key=lambda n: (strongest[n], rows[n][0]))
    vectors, ids = [vectors[n] for n in order], [rows[n][0] for n in order]
    del rows, held  # each copy of the examples' words that the driver holds counts
    model.index = Index.build(vectors, y[order].tolist(), ids, len(words))
    del vectors
    give_back()
    if ids:
        model.steps = calibration(*left_out(spark, model))
        model.index.own = (np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0))  # of no use to other texts
    give_back()
    return model


class Packer:
    """A file that compresses what is written to it, so that a pickled model is never whole in memory."""

    def __init__(self) -> None:
        self.out, self.squeeze = io.BytesIO(), zlib.compressobj(1)

    def write(self, data) -> None:
        data = memoryview(data).cast("B")
        for at in range(0, len(data), 1 << 20):
            self.out.write(self.squeeze.compress(data[at : at + (1 << 20)]))

    def done(self) -> bytes:
        self.out.write(self.squeeze.flush())
        return self.out.getvalue()


def packed(model: Model) -> bytes:
    import pickle

    out = Packer()
    pickle.dump(("\n".join(model.words), model.index, model.weight, model.base, model.steps), out, 5)
    return out.done()


def unpacked(data: bytes) -> Model:
    import pickle

    words, *rest = pickle.loads(zlib.decompress(data))
    return Model(words.split("\n"), *rest)


def left_out(spark, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The votes on all examples, each left out of its own, and their labels."""
    shared, n = spark.sparkContext.broadcast(packed(model)), len(model.index.labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = unpacked(shared.value)
        first, term, weight = own.index.own
        for b in batches:
            ids = b.column(0).to_pylist()
            for at in range(0, len(ids), TOGETHER):
                part = ids[at : at + TOGETHER]
                votes = [v[0] for v in own.votes([(term[first[i] : first[i + 1]].astype(np.int64), weight[first[i] : first[i + 1]]) for i in part], part)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(votes, pa.float64())], ["id", "vote"])
        del own
        give_back()

    got = spark.range(0, n, 1, max(1, min(24, n // 100))).mapInArrow(run, "id long, vote double").collect()  # max_examples rows
    shared.destroy()
    votes = np.zeros(n)
    votes[[r.id for r in got]] = [r.vote for r in got]
    return votes, model.index.labels


def clean(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """The rows of docs that score below 0.5. Texts are scored where they lie, so that none is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(packed(fit(docs.select("doc_id", "text"), labels, max_examples)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = unpacked(shared.value)
        place = own.places()
        for b in batches:
            yield b.filter(pa.array([s[0] < 0.5 for s in own.scores(b.column("text").to_pylist(), place)], pa.bool_()))
        del own, place
        give_back()

    return docs.mapInArrow(run, docs.schema)


def scores(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence array<long>, closeness array<double>) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(packed(fit(docs.select("doc_id", "text"), labels, max_examples)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = unpacked(shared.value)
        place = own.places()
        for b in batches:
            got = own.scores(b.column(1).to_pylist(), place)
            s = [g[0] for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.float64()))], ["doc_id", "score", "predicted", "evidence", "closeness"])
        del own, place
        give_back()

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int, evidence array<long>, closeness array<double>")
    return out.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "evidence", "closeness")
