"""Operator 10, SimHash near-duplicates by multi-index hashing.

``fingerprints`` gives each text its 64-bit SimHash of word shingles; ``links`` finds all fingerprints that differ in at
most 3 bits: of two 32-bit segments at least one differs in at most one bit, so each fingerprint probes, in the table of
each segment, the Hamming ball of radius 1 (33 keys), and complete distances decide. Only distinct fingerprints are
indexed, so copies cost nothing; each link is emitted once.

``near_copies`` finds, for the pipeline, what connects all pairs of texts whose sets of five-word shingles have a Jaccard similarity of
0.8 or more, by prefixes of the shingles in the order of their hashes; the sets themselves decide. ``groups`` joins both.

Null or wordless texts have the fingerprint zero and link like any other. Rows with a null doc_id get a fingerprint and
no component. A doc_id that repeats is one node of ``near_duplicates``; in ``groups`` its rows are told apart by a hash of their
texts. Very long texts count whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import GROUP, components, give_back, linked, saved, sifted, tune

SHINGLE = 3
COPY_SHINGLE = 5
SEED = 42
SEGMENT = 32
BALL = 1
BLOCK = 1 << 16
ODD = 8


def shingles(text: str | None, shingle: int) -> list[bytes]:
    """The word shingles of a text; its words as one where they are fewer; none of a wordless text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < shingle:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer."""
    grams = shingles(text, shingle)
    if not grams:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), BLOCK):
        part = grams[at : at + BLOCK]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), "<u8", len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row, fp long: the fingerprint's 64 bits); row is a hash of the text."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t.as_py(), shingle) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "row", "fp"])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text").mapInArrow(run, "doc_id long, row long, fp long")


def links(reps: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (a, b) of the ids of reps (id, fp; distinct fingerprints) at no more than radius (3 at most) differing bits."""
    low = F.lit((1 << SEGMENT) - 1)
    halves = [F.shiftrightunsigned("fp", SEGMENT), F.col("fp").bitwiseAND(low)]
    keyed = [F.shiftleft(F.lit(s).cast("long"), SEGMENT).bitwiseOR(h) for s, h in enumerate(halves)]
    ball = [0, *(1 << i for i in range(SEGMENT))]
    table = reps.select(F.col("id").alias("a"), F.col("fp").alias("fa"), F.explode(F.array(*keyed)).alias("key"))
    flips = F.array(*(F.lit(m).cast("long") for m in ball))
    probes = reps.select(F.col("id").alias("b"), F.col("fp").alias("fb"), F.explode(F.array(*keyed)).alias("k"))
    probes = probes.select("b", "fb", F.explode(F.transform(flips, lambda m: F.col("k").bitwiseXOR(m))).alias("key"))
    differ = F.col("fa").bitwiseXOR(F.col("fb"))
    first = F.bit_count(F.shiftrightunsigned(differ, SEGMENT)) > BALL
    near = (F.col("fa") < F.col("fb")) & (F.bit_count(differ) <= radius)
    # reps' file is small, but there are 66 probes a row: chosen by the file's size, a broadcast would bring them all to the driver
    return table.alias("t").join(probes.hint("merge").alias("p"), (F.col("t.key") == F.col("p.key")) & near & F.when(F.shiftrightunsigned("t.key", SEGMENT) == 0, F.lit(True)).otherwise(first)).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, row) for every row of docs (doc_id, text)."""
    marked = saved(fingerprints(docs, shingle), "simhash")
    reps = saved(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-reps")
    found = components(links(reps, radius), "simhash-links")
    classes = reps.join(found, reps.id == found.node, "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    out = marked.join(classes, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), "row")


def sets(docs: DataFrame, shingle: int = COPY_SHINGLE) -> DataFrame:
    """(doc_id, row, size, ha, hb, keys, odd, wide) of the texts that have words: the number of their distinct shingles, 128 bits that stand
    for the set, the smallest hashes of shingles that two sets of Jaccard similarity 0.8 or more can't both lack, and as bits of ODD
    longs, and of as many bits as the set has members or more, the classes of hashes of which the set has an odd number."""
    tune(docs.sparkSession)
    schema = "doc_id long, row long, size int, ha long, hb long, keys array<long>, odd array<long>, wide binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows, sizes, named, keys, odd, wide = [], [], [], ([], []), [], [], []
            for i, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                grams = set(shingles(t.as_py(), shingle))
                if not grams:
                    continue
                h = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(grams)).view(np.int64))
                ids.append(i)
                rows.append(r)
                sizes.append(len(h))
                for k in range(2):
                    named[k].append(xxhash.xxh64_intdigest(h.tobytes(), k))
                keys.append(h[: len(h) - (4 * len(h) + 4) // 5 + 1])
                odd.append(parities(h, 64 * ODD).view("<i8"))
                wide.append(parities(h, max(64 * ODD, 1 << (len(h) - 1).bit_length())).tobytes())
            both = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in named]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(sizes, pa.int32()), *both, pa.array(keys, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64())), pa.array(wide, pa.binary())], ["doc_id", "row", "size", "ha", "hb", "keys", "odd", "wide"])
        give_back()

    return rowed(docs).mapInArrow(run, schema)


def parities(hashes: np.ndarray, classes: int) -> np.ndarray:
    """A bit for each class of hashes (their lowest bits), set if an odd number of them is in it."""
    return np.packbits((np.bincount(hashes & (classes - 1), minlength=classes) & 1).astype(np.uint8), bitorder="little")


def differ(x: bytes, y: bytes) -> int:
    """In how many classes two sets' parities differ; the longer's classes are put together to the shorter's first."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def rowed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text) of the rows of docs that have a doc_id; row is a hash of the text."""
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text")


def near_copies(docs: DataFrame, shingle: int = COPY_SHINGLE, group: int = GROUP) -> DataFrame:
    """Links (a, b) between struct<doc_id,row> of rows of docs (doc_id, text) that connect all texts of Jaccard similarity 0.8 or more.

    Of a pair, the smaller set of n shingles shares one of its n - ceil(8 n / 9) + 1 smallest hashes with the m - ceil(0.8 m) + 1
    smallest of the other. Equal sets are indexed once; each of their texts links to the first. Hashes that only one set has are left
    out before any join. Sets that differ in more than a ninth of their sizes' sum are no pair; each class of which one of them alone
    has an odd number is such a difference: the join's condition counts 512 classes, a second pass over the pairs as many as a set has
    members. The sets themselves decide. Wordless texts have no link here.
    """
    held = saved(sets(docs, shingle), "copy-sets")
    id_ = F.struct("doc_id", "row").alias("id")
    reps = held.groupBy("ha", "hb").agg(F.min(id_).alias("id"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("odd").alias("odd"), F.count("*").alias("weight"))
    same = held.select("ha", "hb", id_).join(reps.select("ha", "hb", F.col("id").alias("a")), ["ha", "hb"]).where("a <> id").select("a", F.col("id").alias("b"))

    named = reps.select(F.col("id.row").alias("ref"), "id", "weight", *(F.get("odd", F.lit(i)).alias(f"odd{i}") for i in range(ODD)))
    keyed = reps.select(F.col("id.row").alias("ref"), "size", F.posexplode("keys").alias("at", "key"))
    keyed = keyed.withColumn("own", F.expr("at < size - (8 * size + 8) div 9 + 1"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("some")).where("n > 1 and some").select("key", "n")
    rows = sifted(keyed, "key", shared).join(shared, "key").join(named, "ref")
    least, most = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    room = F.least("at_a", "at_b") + F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))  # most that the sets can share
    apart = reduce(lambda p, q: p + q, (F.bit_count(F.col(f"odd{i}_a").bitwiseXOR(F.col(f"odd{i}_b"))) for i in range(ODD)))
    alike = (5 * least >= 4 * most) & (9 * room >= 4 * (least + most)) & (9 * apart <= least + most)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = set(shingles(x.as_py(), shingle)), set(shingles(y.as_py(), shingle))
                good.append(9 * len(x & y) >= 4 * (len(x) + len(y)))
            yield b.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [9 * differ(x, y) <= m + n for m, n, x, y in zip(*(b.column(k).to_pylist() for k in range(2, 6)))]
            yield b.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = saved(pairs.distinct(), f"{name}-asked", "lz4_raw")
        asked = pairs.select(F.col("a").alias("row")).union(pairs.select("b"))
        known = sifted(held.select("row", "size", "wide"), "row", asked).dropDuplicates(["row"])
        left, right = (known.withColumnsRenamed({"row": x, "size": f"size_{x}", "wide": f"wide_{x}"}) for x in "ab")
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "size_a", "size_b", "wide_a", "wide_b")
        pairs = saved(both.mapInArrow(near, "a long, b long"), f"{name}-close", "lz4_raw")
        asked = pairs.select(F.col("a").alias("row")).union(pairs.select("b"))
        texts = sifted(rowed(docs), "row", asked).groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
        texts = saved(texts.select("row", F.struct("doc_id", "row").alias("id"), "text"), f"{name}-texts")
        left, right = (texts.withColumnsRenamed({"row": x, "id": f"id_{x}", "text": f"text_{x}"}) for x in "ab")
        both = pairs.join(left, "a").join(right, "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "text_a", "text_b")
        return saved(both.mapInArrow(check, "a struct<doc_id:long,row:long>, b struct<doc_id:long,row:long>"), name)

    return linked(rows, ("size", "at", *(f"odd{i}" for i in range(ODD))), alike, verified, "copies", group, "lz4_raw").union(same)


def groups(docs: DataFrame) -> DataFrame:
    """(node, component) struct<doc_id,row> of the rows of docs that fingerprints within 3 bits or near copies connect with others."""
    marked = saved(fingerprints(docs.where("doc_id is not null")), "simhash")
    reps = saved(marked.groupBy("fp").agg(F.min(F.struct("doc_id", "row")).alias("id")), "simhash-reps")
    same = marked.join(reps.select("fp", F.col("id").alias("a")), "fp").select("a", F.struct("doc_id", "row").alias("b")).where("a <> b")
    return components(links(reps).union(same).union(near_copies(docs)), "simhash-groups")
