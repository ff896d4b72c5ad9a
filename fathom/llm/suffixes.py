"""Operator 9, suffix-array dedup with a logarithmic index family.

The suffix arrays are sparse. A suffix is kept at an anchor: the leftmost least hash among the 27 positions at which a
24-byte string fits into a 50-byte window. Equal windows have equal anchors at equal offsets, so no 50-byte match is
lost, while only about one byte in 14 starts a kept suffix.

1. ``anchors``: every anchor's hash, packed and dealt by hash; those whose 24 bytes occur once in the table end here.
2. ``contexts``: for the others the bytes under the windows that belong to the anchor are fetched.
3. ``Family``: in each shard, suffixes come in batches by doc_id. A batch becomes a suffix array (its suffixes in byte order, with
   the smallest doc_id of each), is scanned against the existing levels for matches of 50 bytes, and becomes a level itself;
   levels of about equal size merge, so that n suffixes lie in at most log n levels and each is merged log n times.
4. ``dedup``: windows that also start in a smaller doc_id are cut out of the text.

Exact copies of a text are known by SHA-256 beforehand, need no context and lose all bytes (if there are 50). Pieces are told apart by
64-bit hash, suffixes by their bytes. There are as many shards as the size of the texts asks for. The levels are those of one run. Null texts are empty. Rows with a null doc_id are kept whole. Rows sharing a
doc_id are one document for comparison: none of them loses bytes to another. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import bucket_bits, give_back, saved, tune
from fathom.llm.substrings import by_document, equal_runs, pack, pack_ids, runs, unpack, unpack_ids

WIDTH = 50
SEED_BYTES = 24
BLOCK_BYTES = 3 << 20
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
POSITION = np.uint64(0xFFFFFFFF)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, size, out = len(x) - width + 1, 1, x
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:n], out[width - size : width - size + n]) if size < width else out[:n]


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the SEED_BYTES bytes at every position."""
    n = len(data) - SEED_BYTES + 1
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))
    h = np.zeros(n, np.uint64)
    for at in range(0, SEED_BYTES, 8):
        h ^= eight[at : at + n]
        h *= M1
        h ^= h >> np.uint64(29)
    h *= M2
    h ^= h >> np.uint64(32)
    return h


def anchored(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts laid end to end: hash, position, first and last start of the windows that belong to each."""
    nothing = np.zeros(0, np.int64)
    if len(data) < width:
        return np.zeros(0, np.uint64), nothing, nothing, nothing
    h = seed_hashes(data)
    key = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
    least = (sliding_min(key, width - SEED_BYTES + 1) & POSITION).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int64)
    fits = ends - starts >= width
    np.add.at(inside, starts[fits], 1)
    np.add.at(inside, ends[fits] - width + 1, -1)
    at = np.flatnonzero(np.cumsum(inside)[: len(least)] > 0)
    if not len(at):
        return np.zeros(0, np.uint64), nothing, nothing, nothing
    own = least[at]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
    pos = own[new]
    # least hashes crowd at small values; a product with an odd number spreads them over the shards, one to one
    return h[pos] * M1, pos, at[new], at[np.concatenate([new[1:] - 1, [len(at) - 1]])]


def laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(texts), np.uint8), ends, ends - sizes


def batched(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    """Lists of rows (row[1] has a length) of about size bytes."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def anchors(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """(bucket, hashes, docs, starts): every anchor, packed; 6 bytes of hash, one of which the bucket has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i.as_py(), raw(t.as_py())) for b in batches for i, t in zip(b.column(0), b.column(1)))
        for part in batched(rows, BLOCK_BYTES):
            first: dict[bytes, int] = {}
            for i, t in part:
                if len(t) >= width and i < first.get(t, i + 1):
                    first[t] = i  # copies of a text: the smallest doc_id alone can matter
            part = sorted((i, t) for t, i in first.items())
            if not part:
                continue
            data, ends, starts = laid([t for _, t in part])
            h, pos, _, _ = anchored(data, ends, starts, width)
            doc = np.searchsorted(ends, pos, "right")
            ids, local = np.array([i for i, _ in part], np.int64)[doc], pos - starts[doc]
            bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            tail = np.ascontiguousarray(h[order]).view(np.uint8).reshape(-1, 8)[:, 2:7]
            out = [(int(bucket[lo]), tail[lo:hi].tobytes(), pack_ids(ids[order[lo:hi]]), pack(local[order[lo:hi]])) for lo, hi in equal_runs(bucket)]
            if out:
                types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["bucket", "hashes", "docs", "starts"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "bucket int, hashes binary, docs binary, starts binary")


def recurring(table: pa.Table) -> pa.Table:
    """Of one bucket: the anchors whose seed occurs in more than one document."""
    keys, ids, at = [], [], []
    for h, d, s in zip(*(table.column(c).to_pylist() for c in ("hashes", "docs", "starts"))):
        wide = np.zeros((len(h) // 5, 8), np.uint8)
        wide[:, :5] = np.frombuffer(h, np.uint8).reshape(-1, 5)
        keys.append(wide.view("<u8").ravel())
        ids.append(unpack_ids(d))
        at.append(unpack(s))
    k, i, s = np.concatenate(keys), np.concatenate(ids), np.concatenate(at)
    order = np.argsort(k)
    same = k[order[1:]] == k[order[:-1]]
    part = np.zeros(len(k), bool)
    part[1:] |= same
    part[:-1] |= same
    order = order[part]
    k, i, s = k[order], i[order], s[order]
    if len(k):
        cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        low, high = np.minimum.reduceat(i, cuts), np.maximum.reduceat(i, cuts)
        many = np.repeat(low != high, np.diff(np.append(cuts, len(k))))
        i, s = i[many], s[many]
    return by_document(i, s)


def contexts(docs: DataFrame, wanted: DataFrame, width: int, bits: int) -> DataFrame:
    """(bucket, kind, docs, starts, sizes, bytes): for wanted anchors (doc_id, at array<binary>), the pieces of text under
    their windows. Of equal pieces in a block of documents only the smallest doc_id's travels; the others are matched, and
    go as rows of kind 1 without bytes."""
    # a left join, like the one in dedup: Spark then deals out the texts once for both
    both = docs.join(wanted.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i.as_py(), raw(t.as_py()), a.as_py()) for b in batches for i, t, a in zip(b.column(0), b.column(1), b.column(2)) if a.is_valid)
        for part in batched(rows, BLOCK_BYTES):
            part.sort(key=lambda r: r[0])
            data, ends, starts = laid([t for _, t, _ in part])
            h, pos, lo, hi = anchored(data, ends, starts, width)
            doc = np.searchsorted(ends, pos, "right")
            asked = np.unique(np.concatenate([np.concatenate([unpack(x) for x in a]) + starts[d] for d, (_, _, a) in enumerate(part)]))
            keep = np.isin(pos, asked, assume_unique=False)
            h, lo, hi, doc = h[keep], lo[keep], hi[keep], doc[keep]
            if not len(h):
                continue
            ids, local, sizes = np.array([i for i, _, _ in part], np.int64)[doc], lo - starts[doc], hi - lo + width
            text = data.tobytes()
            pieces = [text[x:y] for x, y in zip(lo.tolist(), (lo + sizes).tolist())]
            low: dict[bytes, int] = {}
            least = np.array([low.setdefault(p, i) for p, i in zip(pieces, ids.tolist())])  # ids ascend
            out = []
            if len(late := np.flatnonzero(ids > least)):
                late = late[np.argsort(ids[late], kind="stable")]
                out.append((int(ids[late[0]]) & ((1 << bits) - 1), 1, pack_ids(ids[late]), pack(local[late]), pack(sizes[late]), b""))
            stay = np.flatnonzero(ids == least)
            bucket = (h[stay] >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            for lo_, hi_ in equal_runs(bucket):
                own = stay[order[lo_:hi_]]
                out.append((int(bucket[lo_]), 0, pack_ids(ids[own]), pack(local[own]), pack(sizes[own]), b"".join([pieces[x] for x in own.tolist()])))
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["bucket", "kind", "docs", "starts", "sizes", "bytes"])
            del data, h, pos, text, pieces, low, out
            give_back()

    return both.mapInArrow(run, "bucket int, kind int, docs binary, starts binary, sizes binary, bytes binary")


class Family:
    """A logarithmic family of suffix arrays: levels of (suffixes in byte order, smallest doc_id of each). A suffix counts to its
    first width bytes: matches are no shorter, so its order beyond them decides nothing."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def array(suffixes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct suffixes in order, with their smallest ids. A stable sort merges runs that are sorted already."""
        order = np.argsort(suffixes, kind="stable")
        suffixes, ids = suffixes[order], ids[order]
        cuts = np.flatnonzero(np.concatenate([[True], suffixes[1:] != suffixes[:-1]]))
        return suffixes[cuts], np.minimum.reduceat(ids, cuts)

    def scan(self, suffixes: np.ndarray) -> np.ndarray:
        """For suffixes in order the smallest doc_id of an equal one in any level, or the largest integer."""
        low = np.full(len(suffixes), np.iinfo(np.int64).max)
        for keys, ids in self.levels:
            at = np.minimum(np.searchsorted(keys, suffixes), len(keys) - 1)
            hit = keys[at] == suffixes
            low[hit] = np.minimum(low[hit], ids[at[hit]])
        return low

    def add(self, suffixes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Takes in a batch whose ids are no smaller than those of earlier ones. Returns which of its suffixes also start in a
        smaller id: the batch's array is scanned against the levels, then levels merge while the last is half as large as the one
        before."""
        if not len(suffixes):
            return np.zeros(0, bool)
        order = np.argsort(suffixes, kind="stable")
        keys, least = self.array(suffixes[order], ids[order])
        known = np.minimum(self.scan(keys), least)
        new = np.concatenate([[True], suffixes[order[1:]] != suffixes[order[:-1]]])
        late = np.empty(len(suffixes), bool)
        late[order] = known[np.cumsum(new) - 1] < ids[order]
        self.levels.append((keys, least))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            (a, i), (b, j) = self.levels.pop(), self.levels.pop()
            self.levels.append(self.array(np.concatenate([a, b]), np.concatenate([i, j])))
        return late


def suffixes_at(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The first width bytes of the suffixes of data that start at the given places, as byte strings."""
    every = np.ndarray((len(data) - width + 1,), f"S{width}", np.ascontiguousarray(data), 0, (1,))
    return every[at]


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n of counts, end to end."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def run_table(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> pa.Table:
    """One row a document: (doc_id, starts, counts) of its runs of windows, packed."""
    order = np.lexsort((starts, ids))
    ids, starts, counts = ids[order], starts[order], counts[order]
    cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    packed = [pa.array([pack(x) for x in np.split(v, cuts[1:])] if len(ids) else [], pa.binary()) for v in (starts, counts)]
    return pa.table({"doc_id": pa.array(ids[cuts], pa.int64()), "starts": packed[0], "counts": packed[1]})


BATCH = 1 << 16


def matches(width: int):
    """Of one shard: the runs of windows that also start in a smaller doc_id, by document.

    Equal pieces meet first: of each, the smallest doc_id alone enters the family, and all others are matched whole.
    """

    def run(table: pa.Table) -> pa.Table:
        digest = xxhash.xxh3_64_intdigest
        keys, ids, starts, counts, texts = [], [], [], [], []
        done = [[], [], []]
        for kind, d, s, z, data in zip(*(table.column(c).to_pylist() for c in ("kind", "docs", "starts", "sizes", "bytes"))):
            sizes = unpack(z)
            if kind:
                for known, more in zip(done, (unpack_ids(d), unpack(s), sizes - width + 1)):
                    known.append(more)
                continue
            ends = np.cumsum(sizes)
            own = [data[x:y] for x, y in zip((ends - sizes).tolist(), ends.tolist())]
            keys.append(np.fromiter(map(digest, own), np.uint64, len(own)))
            ids.append(unpack_ids(d))
            starts.append(unpack(s))
            counts.append(sizes - width + 1)
            texts += own
        done = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in done]
        if not keys:
            return run_table(*done)
        k, i, s, c = map(np.concatenate, (keys, ids, starts, counts))
        order = np.lexsort((i, k))
        new = np.concatenate([[True], k[order[1:]] != k[order[:-1]]])
        head = order[np.flatnonzero(new)]  # of each piece the place with the smallest doc_id
        of = np.empty(len(k), np.int64)
        of[order] = np.cumsum(new) - 1
        whole = i > i[head][of]
        head = head[np.argsort(i[head], kind="stable")]  # batches come by doc_id
        of = np.argsort(np.argsort(i[order[np.flatnonzero(new)]], kind="stable"), kind="stable")[of]
        family, late, at = Family(), [], 0
        sizes = np.cumsum(c[head])
        while at < len(head):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH, "right")))
            part = head[at:to]
            data = np.frombuffer(b"".join([texts[x] for x in part.tolist()]), np.uint8)
            begin = np.cumsum(c[part] + width - 1) - (c[part] + width - 1)
            places = np.repeat(begin, c[part]) + ranges(c[part])
            late.append(family.add(suffixes_at(data, places, width), np.repeat(i[part], c[part])))
            at = to
        late = np.concatenate(late)
        # runs of matched windows within each piece
        first = np.cumsum(c[head]) - c[head]
        edge = np.zeros(len(late), bool)
        edge[first] = True
        begins = late & (edge | ~np.concatenate([[False], late[:-1]]))
        ends = late & np.concatenate([edge[1:] | ~late[1:], [True]])
        b, e = np.flatnonzero(begins), np.flatnonzero(ends)
        piece = np.searchsorted(first, b, "right") - 1
        per = np.bincount(piece, minlength=len(head))
        base = np.cumsum(per) - per
        del texts, family
        give_back()
        rest = np.flatnonzero(~whole & (per[of] > 0))  # every place of those pieces in that smallest doc_id
        n = per[of[rest]]
        pick = np.repeat(base[of[rest]], n) + ranges(n)
        x = np.flatnonzero(whole)
        return run_table(
            np.concatenate([done[0], i[x], np.repeat(i[rest], n)]),
            np.concatenate([done[1], s[x], np.repeat(s[rest], n) + b[pick] - first[piece[pick]]]),
            np.concatenate([done[2], c[x], e[pick] - b[pick] + 1]),
        )

    return run


def repeated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, found array<struct<starts,counts>>, whole): runs of windows that also start in a smaller doc_id; whole marks
    copies of a smaller doc_id's text."""
    spark = docs.sparkSession
    tune(spark)
    bits = bucket_bits(docs)
    texts = docs.where("doc_id is not null and text is not null")
    digests = saved(texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest")), "suffix-digests")
    low = digests.groupBy("digest").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1")
    copies = digests.join(low, "digest").where("doc_id > low").select("doc_id").distinct()
    seeds = anchors(docs, width, bits).groupBy("bucket").applyInArrow(recurring, "doc_id long, starts binary")
    seeds = seeds.groupBy("doc_id").agg(F.collect_list("starts").alias("at")).join(copies, "doc_id", "left_anti")
    found = contexts(docs, seeds, width, bits).groupBy("bucket").applyInArrow(matches(width), "doc_id long, starts binary, counts binary")
    found = found.groupBy("doc_id").agg(F.collect_list(F.struct("starts", "counts")).alias("found"), F.lit(False).alias("whole"))
    return found.unionByName(copies.select("doc_id", F.array().cast("array<struct<starts:binary,counts:binary>>").alias("found"), F.lit(True).alias("whole")))


def covered(found: list[dict], width: int, n: int) -> np.ndarray:
    """Boolean per byte: covered by a window of the runs found."""
    edge = np.zeros(n + 1, np.int64)
    for f in found:
        at, more = unpack(f["starts"]), unpack(f["counts"])
        ok = at + more + width - 1 <= n  # another row may share the doc_id
        np.add.at(edge, at[ok], 1)
        np.add.at(edge, (at + more + width - 1)[ok], -1)
    return np.cumsum(edge[:-1]) > 0


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_bytes, removed array<struct<start,end>>, kept binary) for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    both = docs.join(repeated(docs, width).hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "found", "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t, s, whole in zip(b.column(0), b.column(1), b.column(2), b.column(3)):
                data = raw(t.as_py())
                found = s.as_py()
                if whole.as_py() and len(data) >= width:
                    cut = [(0, len(data))]
                elif found:
                    cut = runs(covered(found, width, len(data)))
                else:
                    cut = []
                edges = [0, *(x for r in cut for x in r), len(data)]
                out.append((i.as_py(), len(data), [{"start": x, "end": y} for x, y in cut], b"".join([data[x:y] for x, y in zip(edges[::2], edges[1::2])])))
            types = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "n_bytes", "removed", "kept"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
