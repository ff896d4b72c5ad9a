"""Operator 5, substring dedup: Rabin-Karp hashes of every 20-word window, counted in Spark.

1. ``windows``: blocks of documents are cut into words; a 64-bit polynomial hash of every window is made by doubling.
   Within a block only the first of equal windows travels (map-side combine, so a hot window costs one entry a block); the
   later ones are marked at once. Entries travel as packed columns, dealt by the high bits of the hash to as many buckets as
   the size of the texts asks for, so that the bucket that a task holds at a time doesn't grow with the table.
2. ``repeated``: in each bucket, equal hashes of different blocks meet; all but the earliest (doc_id, start) are marked.
3. ``dedup``: marks of a document merge into maximal removal intervals, which are cut out of its words.

A false match needs a collision of 64-bit hashes of two different windows: n**2 / 2**65 expected among n windows.
Null and wordless texts have no words. Rows with a null doc_id are kept whole. If a doc_id repeats, equal windows at the
same start tie and stay. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import bucket_bits, give_back, tune

WIDTH = 20
BLOCK_WORDS = 1 << 19
BASE = 0x9E3779B97F4A7C15
ENTRY = "bucket int, kind int, hashes binary, docs binary, starts binary"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of width values, by doubling: h(x + y) = h(x) * BASE**len(y) + h(y), modulo 2**64."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, size, piece, at = None, 1, values, width
    rest = width
    while rest:  # the lowest bits of width stand last in the window
        if rest & 1:
            at -= size
            tail = piece[at : at + n]
            out = tail if out is None else tail * np.uint64(pow(BASE, width - at - size, 1 << 64)) + out
        rest >>= 1
        if rest:
            piece = piece[:-size] * np.uint64(pow(BASE, size, 1 << 64)) + piece[size:]
            size *= 2
    mixed = out ^ (out >> np.uint64(32))
    return mixed * np.uint64(0xD6E8FEB86659FD93)


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest needs; the first byte says how many."""
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def pack_ids(ids: np.ndarray) -> bytes:
    """Ascending ids: the first in 8 bytes, then packed differences."""
    return np.int64(ids[0]).tobytes() + pack(np.diff(ids)) if len(ids) else b""


def unpack_ids(data: bytes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(unpack(data[8:]))]) + np.frombuffer(data[:8], np.int64)[0] if data else np.zeros(0, np.int64)


def equal_runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    cuts = np.flatnonzero(np.diff(values)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]) if len(values) else iter(())


def entries(docs: list[tuple[int, list[bytes]]], width: int, bits: int) -> Iterator[tuple]:
    """Rows of ENTRY for a block of documents."""
    docs = sorted((d for d in docs if len(d[1]) >= width), key=lambda d: d[0])
    if not docs:
        return
    digest = xxhash.xxh3_64_intdigest
    hashes = np.concatenate([rolling(np.fromiter(map(digest, w), np.uint64, len(w)), width) for _, w in docs])
    sizes = np.array([len(w) - width + 1 for _, w in docs])
    ids = np.repeat(np.array([i for i, _ in docs], np.int64), sizes)
    starts = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((starts, hashes)) if len(docs) > 1 and len(set(i for i, _ in docs)) < len(docs) else np.argsort(hashes, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = hashes[order[1:]] == hashes[order[:-1]]
    if same.any():
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        late = order[same & ((ids[order] != ids[head]) | (starts[order] != starts[head]))]
        late.sort()
        if len(late):
            yield int(xxhash.xxh32_intdigest(ids[late[:1]].tobytes()) & ((1 << bits) - 1)), 1, b"", pack_ids(ids[late]), pack(starts[late])
    first = np.sort(order[~same])
    bucket = (hashes[first] >> np.uint64(64 - bits)).astype(np.int64)
    first = first[np.argsort(bucket, kind="stable")]
    bucket.sort()
    plain = np.ascontiguousarray(hashes[first]).view(np.uint8).reshape(-1, 8)[:, :7]  # the top byte is the bucket's
    for lo, hi in equal_runs(bucket):
        yield int(bucket[lo]), 0, plain[lo:hi].tobytes(), pack_ids(ids[first[lo:hi]]), pack(starts[first[lo:hi]])


def windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    spark = docs.sparkSession
    tune(spark)
    bits = bucket_bits(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows, mb = [], 0
            for row in entries(held, width, bits):
                rows.append(row)
                mb += len(row[2])
                if mb > 4 << 20:
                    yield batch(rows)
                    rows, mb = [], 0
            if rows:
                yield batch(rows)

        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                held.append((i.as_py(), words(t.as_py())))
                size += len(held[-1][1])
                if size >= BLOCK_WORDS:
                    yield from flush()
                    held, size = [], 0
        yield from flush()
        give_back()

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENTRY)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["bucket", "kind", "hashes", "docs", "starts"])


def by_document(ids: np.ndarray, starts: np.ndarray) -> pa.Table:
    """One row a document: (doc_id, starts), starts packed."""
    if not len(ids):
        return pa.table({"doc_id": pa.array([], pa.int64()), "starts": pa.array([], pa.binary())})
    order = np.lexsort((starts, ids))
    ids, starts = ids[order], starts[order]
    cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return pa.table({"doc_id": pa.array(ids[cuts]), "starts": pa.array([pack(x) for x in np.split(starts, cuts[1:])], pa.binary())})


def meet(table: pa.Table) -> pa.Table:
    """Of one bucket: the windows that have an earlier equal, by document."""
    marked: list[tuple[np.ndarray, np.ndarray]] = []
    keys, ids, starts = [], [], []
    for kind, h, d, s in zip(*(table.column(c).to_pylist() for c in ("kind", "hashes", "docs", "starts"))):
        if kind:
            marked.append((unpack_ids(d), unpack(s)))
            continue
        wide = np.zeros((len(h) // 7, 8), np.uint8)
        wide[:, :7] = np.frombuffer(h, np.uint8).reshape(-1, 7)
        keys.append(wide.view("<u8").ravel())
        ids.append(unpack_ids(d))
        starts.append(unpack(s))
    if keys:
        k, i, s = np.concatenate(keys), np.concatenate(ids), np.concatenate(starts)
        order = np.argsort(k)
        again = k[order[1:]] == k[order[:-1]]
        part = np.zeros(len(k), bool)
        part[1:] |= again
        part[:-1] |= again
        order = order[part]  # only what repeats
        order = order[np.lexsort((s[order], i[order], k[order]))]
        k, i, s = k[order], i[order], s[order]
        new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
        head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        late = (i != i[head]) | (s != s[head])
        marked.append((i[late], s[late]))
    return by_document(np.concatenate([m[0] for m in marked]), np.concatenate([m[1] for m in marked]))


def repeated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, starts array<binary>): starts of the windows that also start earlier, one row a document."""
    found = windows(docs, width).groupBy("bucket").applyInArrow(meet, "doc_id long, starts binary")
    return found.groupBy("doc_id").agg(F.collect_list("starts").alias("starts"))


def spans(starts: list[bytes] | None, width: int, n: int) -> np.ndarray:
    """Boolean per word: covered by a marked window."""
    edge = np.zeros(n + 1, np.int64)
    for s in starts or ():
        at = unpack(s)
        at = at[at + width <= n]  # another row may share the doc_id
        np.add.at(edge, at, 1)
        np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def runs(covered: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, removed array<struct<start,end>> in words, kept string) for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    both = docs.join(repeated(docs, width).hint("shuffle_hash"), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t, s in zip(b.column(0), b.column(1), b.column(2)):
                w = words(t.as_py())
                covered = spans(s.as_py(), width, len(w))
                kept = [x for x, c in zip(w, covered) if not c] if covered.any() else w
                out.append((i.as_py(), len(w), [{"start": x, "end": y} for x, y in runs(covered)], b" ".join(kept).decode("utf-8", "surrogatepass")))
            types = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "n_words", "removed", "kept"])

    return both.select("doc_id", "text", "starts").mapInArrow(run, "doc_id long, n_words long, removed array<struct<start:long,end:long>>, kept string")
