"""Operator 7, mixing sources to target weights by subset-sum budget fitting.

Sources, ordered by code point with null last, weigh 1, 2, 3, repeating, and share all words; a target stops at three
times its source's words, the excess is shared again by weight until none is above. A source takes every document
target // words times; for the rest of its target, documents are counted by exact length, most of the budget is filled in
proportion and then by the longest lengths, and what remains is met by a bounded-knapsack subset sum. If that misses,
further copies, up to three of a document, and at last fewer of some, are let into the sum. Which documents of a length
are taken once more follows a seeded hash, so reruns agree.

A hot (source, length) pair is dealt over 256 hash buckets; only bucket counts meet. The driver sees one row a source.
Null texts have no words and take nothing. Documents with equal doc_id, source and size tie: their order in the bucket is
arbitrary, but which of them is taken makes no difference to the counts. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.llm.common import saved, tune

SEED = 7
REPEATS = 3
WEIGHTS = (1, 2, 3)
BUDGET = 1 << 14


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of each text."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len((t.as_py() or "").encode("utf-8", "surrogatepass").split()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "size"])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInArrow(run, "doc_id long, source string, size long")


def targets(totals: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> dict[str | None, Fraction]:
    """Exact target of each source. totals: words of each source."""
    order = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    open_ = {s: Fraction(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    limit = {s: Fraction(repeats * n) for s, n in order}
    left, out = Fraction(sum(n for _, n in order)), {}
    while open_:
        share = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * share > limit[s]]
        if not full:
            out |= {s: w * share for s, w in open_.items()}
            break
        for s in full:
            out[s] = limit[s]
            left -= limit[s]
            del open_[s]
    return out


def fit(counts: dict[int, int], budget: int, reach: int = BUDGET) -> dict[int, int]:
    """How many of each length to take so that their sum comes as near to budget, from below, as the lengths allow.

    In proportion first, then longest first down to about reach, then an exact subset sum of what is left.
    """
    total = sum(n * c for n, c in counts.items())
    if budget >= total:
        return dict(counts)
    taken = {n: c * budget // total if n else 0 for n, c in counts.items()}
    left = budget - sum(n * c for n, c in taken.items())
    for n in sorted(counts, reverse=True):
        if n and left > reach:
            more = min(counts[n] - taken[n], (left - reach) // n)
            taken[n] += more
            left -= more * n
    mask = (1 << (left + 1)) - 1
    steps, can = [], 1
    for n in sorted(counts):
        free, piece = min(counts[n] - taken[n], left // n if n else 0), 1
        while free > 0:  # bounded counts as powers of two
            k = min(piece, free)
            steps.append((n, k, can))
            can |= (can << (n * k)) & mask
            free -= k
            piece *= 2
    best = can.bit_length() - 1
    for n, k, before in reversed(steps):
        if not before >> best & 1:
            taken[n] += k
            best -= n * k
    return taken


def quotas(counts: dict[int, int], target: int, repeats: int = REPEATS) -> dict[int, int]:
    """How many copies to take, in all, of the documents of each length: repeats of each at most."""
    total = sum(n * c for n, c in counts.items())
    if not total:
        return dict.fromkeys(counts, 0)
    base, rest = divmod(min(target, repeats * total), total)
    best, least = {}, None
    for low, most in ((base, base + 1), (base, repeats), (0, repeats)):
        more = fit({n: c * (min(most, repeats) - low) for n, c in counts.items()}, rest + (base - low) * total)
        got = {n: low * c + more[n] if n else 0 for n, c in counts.items()}
        missed = target - sum(n * q for n, q in got.items())
        if least is None or missed < least:
            best, least = got, missed
        if not least:
            break
    return best


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs (doc_id, source, text)."""
    spark = docs.sparkSession
    key = F.xxhash64(F.lit(seed), "doc_id")
    rows = saved(sizes(docs).withColumn("rank_key", key).withColumn("part", F.shiftrightunsigned("rank_key", 56).cast("int")), "mixing")
    counts = saved(rows.groupBy("source", "size", "part").agg(F.count("*").alias("n")), "mixing-counts")
    totals = [(r[0], r[1]) for r in counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n"))).collect()]
    goal = targets(totals)
    plan = spark.createDataFrame([(s, n, float(goal[s]), int(goal[s])) for s, n in totals], "ps string, source_size long, target double, whole long")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        got = quotas(dict(zip(pdf["size"].tolist(), pdf["n"].tolist())), int(pdf["whole"].iloc[0]))
        return pd.DataFrame({"qs": pdf["source"], "qz": pdf["size"], "quota": pdf["size"].map(got), "all": pdf["n"]})

    lengths = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    chosen = lengths.join(F.broadcast(plan), lengths.source.eqNullSafe(F.col("ps"))).groupBy("source").applyInPandas(choose, "qs string, qz long, quota long, all long")
    chosen = chosen.select("qs", "qz", F.expr("quota div all").alias("level"), (F.col("quota") % F.col("all")).alias("rest"))
    # of the documents of a length, those in the first hash buckets take one more; one bucket does in part
    span = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = counts.withColumn("before", F.coalesce(F.sum("n").over(span), F.lit(0)))
    held = held.join(chosen, held.source.eqNullSafe(F.col("qs")) & (held["size"] == F.col("qz")))
    held = held.select(F.col("source").alias("hs"), F.col("size").alias("hz"), F.col("part").alias("hp"), F.least("n", F.greatest(F.col("rest") - F.col("before"), F.lit(0))).alias("extra"), "n", "level")
    out = rows.join(held, rows.source.eqNullSafe(F.col("hs")) & (rows["size"] == F.col("hz")) & (rows["part"] == F.col("hp")))
    cut = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    order = Window.partitionBy("source", "size", "part").orderBy("rank_key", "doc_id")
    some = out.where(cut).withColumn("more", (F.row_number().over(order) <= F.col("extra")).cast("long"))
    both = out.where(~cut).withColumn("more", (F.col("extra") > 0).cast("long")).unionByName(some)
    both = both.select("doc_id", "source", "size", "level", "more").join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("ps")))
    return both.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("level") + F.col("more"))).alias("taken"))
