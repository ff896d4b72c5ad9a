"""Operator 13, product-quantised codes of vectors, learned on distinct integer parts.

* A component x counts as the integer floor(256 x). A vector is cut into ``PARTS`` equal consecutive parts; equal parts of one position
  are one row with their number as its weight, counted in Spark with map-side combine.
* Weighted Lloyd runs over these distinct rows: a task assigns its rows to the nearest entries (squared Euclidean distance in integers,
  ties to the lower index) and gives one row of sums for each entry it used. An entry's next value is the floor of the mean.
  Codebooks are PARTS * ENTRIES short rows, whatever the table; they alone reach the driver.
* Codes and errors of distinct parts are joined back to the vectors. A part that more than one in ``HOT`` of the vectors has is joined
  by a broadcast table (at most PARTS * HOT rows by that rule), so that no key of the other join is hot. Sums of errors by label likewise.

Vectors that are null or hold null or non-finite components are dropped. Vectors of several lengths, or of one that the parts don't
divide, are filled up with zeros to the next multiple of the longest; that changes no distance between their own components.
Components saturate where squared distances could leave 64 bits (``limit``; beyond one million for usual widths). Rows may share a
vec_id; the first codebooks take rows in order of vec_id (null last), then components. Fewer than ENTRIES vectors give as many entries.
Null labels are one label. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import saved, tune

PARTS = 16
ENTRIES = 64
ROUNDS = 2
HOT = 1000


def limit(dim: int) -> int:
    """The largest size of a component at which the squared distance of two vectors of so many components stays below 2^62."""
    return int((2**60 / max(1, dim)) ** 0.5)


def integers(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, label, parts): kept vectors with a number of their own, as PARTS arrays of integers."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = embeddings.select("vec_id", "label", vector.alias("v")).where(F.col("v").isNotNull() & finite)
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // PARTS)
    most = float(limit(width * PARTS))
    whole = F.transform("v", lambda x: F.floor(F.least(F.greatest(x * 256, F.lit(-most)), F.lit(most))).cast("int"))
    filled = F.concat(whole, F.array_repeat(F.lit(0), F.lit(width * PARTS) - F.size("v")))
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.slice("whole", i * width + 1, F.lit(width)))
    return kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", filled.alias("whole")).select("row", "vec_id", "label", parts.alias("parts"))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Equally long lists of a batch as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry of each point, and the squared distance."""
    far = np.zeros((len(points), len(entries)), dtype=np.int64)
    for x, y in zip(points.T, entries.T, strict=True):
        far += (x[:, None] - y[None, :]) ** 2
    at = far.argmin(axis=1)
    return at, far[np.arange(len(points)), at]


def assigned(books: list[np.ndarray]) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A function from a batch of distinct parts to positions, points, codes and errors."""

    def run(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at, points = batch.column("pos").to_numpy(), matrix(batch.column("part"))
        code, error = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        for pos in np.unique(at):
            code[at == pos], error[at == pos] = nearest(points[at == pos], books[pos])
        return at, points, code, error

    return run


def next_books(distinct: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round of weighted Lloyd."""
    assign, width = assigned(books), books[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, ENTRIES, width + 1), dtype=np.int64)
        for batch in batches:
            at, points, code, _ = assign(batch)
            weight = batch.column("weight").to_numpy()
            np.add.at(total, (at, code), np.column_stack([points * weight[:, None], weight]))
        used = np.argwhere(total[:, :, width] > 0)
        yield pa.RecordBatch.from_pydict(
            {"pos": pa.array(used[:, 0], pa.int32()), "code": pa.array(used[:, 1], pa.int32()), "sums": pa.array([total[p, c].tolist() for p, c in used], pa.list_(pa.int64()))}
        )

    got = distinct.mapInArrow(sums, "pos int, code int, sums array<long>").groupBy("pos", "code")
    got = got.agg(*(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width + 1)))
    new = [book.copy() for book in books]
    for pos, code, *total in got.collect():
        new[pos][code] = [x // total[-1] for x in total[:-1]]
    return new


def brought(rows: DataFrame, table: DataFrame, on: Callable[[str, str], Column], values: tuple[str, ...], n: int) -> DataFrame:
    """rows with the values of table, which has one row for each key and its number of rows as weight: hot keys by broadcast, others by a shuffle."""
    hot, others = table.where(F.col("weight") * HOT > n), table.where(F.col("weight") * HOT <= n)
    first = rows.alias("r").join(F.broadcast(hot.alias("t")), on("r", "t"), "left").select("r.*", *(F.col(f"t.{v}").alias(v) for v in values))
    done, rest = first.where(F.col(values[0]).isNotNull()), first.where(F.col(values[0]).isNull()).drop(*values)
    return done.union(rest.alias("r").join(others.alias("t"), on("r", "t")).select("r.*", *(F.col(f"t.{v}") for v in values)))


def compress(embeddings: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, codes, error) for each kept vector, and the codebooks: by position, entries by components."""
    tune(embeddings.sparkSession)
    vectors = saved(integers(embeddings), "codes-vectors")
    n = vectors.count()
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(ENTRIES).select("parts").collect()
    books = [np.array([row.parts[pos] for row in first], dtype=np.int64).reshape(len(first), len(first[0].parts[pos]) if first else 0) for pos in range(PARTS)]
    exploded = vectors.select("row", F.posexplode("parts").alias("pos", "part"))
    distinct = saved(exploded.groupBy("pos", "part").agg(F.count("*").alias("weight")), "codes-distinct")
    if n:
        for _ in range(ROUNDS):
            books = next_books(distinct, books)
    assign = assigned(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, code, error = assign(batch)
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("part"), batch.column("weight"), pa.array(code, pa.int32()), pa.array(error)], names=["pos", "part", "weight", "code", "error"])

    table = saved(distinct.mapInArrow(coded, "pos int, part array<int>, weight long, code int, error long"), "codes-table")
    same = lambda r, t: (F.col(f"{r}.pos") == F.col(f"{t}.pos")) & (F.col(f"{r}.part") == F.col(f"{t}.part"))
    joined = brought(exploded, table, same, ("code", "error"), n)
    packed = joined.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("codes"), F.sum("error").alias("error"))
    return vectors.select("row", "vec_id", "label").join(packed, "row").select("vec_id", "label", F.col("codes.code").alias("codes"), "error"), books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.reshape(-1).tolist()).encode()).hexdigest()


def vector_codes(embeddings: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): codes in hexadecimal, two digits a part; errors summed over equal labels."""
    coded, books = compress(embeddings.select("vec_id", "embedding", "label"))
    hexed = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    rows = saved(coded.select("vec_id", "label", hexed.alias("code"), "error"), "codes-rows")
    labels = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("weight"))
    n = labels.agg(F.sum("weight")).first()[0] or 0
    got = brought(rows, labels, lambda r, t: F.col(f"{r}.label").eqNullSafe(F.col(f"{t}.label")), ("label_error",), n)
    return got.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
