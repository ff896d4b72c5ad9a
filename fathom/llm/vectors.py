"""Operator 1, embedding near-duplicates by randomised-rotation binary codes with stored correction factors.

Every valid vector is normalised and turned by a random rotation; its code is the signs, its correction factor the cosine
between vector and code. For a pair, c = <code(x), y> estimates <x, y> without bias as c / factor(x). Since x is made of
its code and a rest at right angles to it, <x, y> lies within cos(acos(c) -+ acos(factor)): that interval is certain, and
only pairs whose interval reaches the threshold are computed exactly, in double precision, from the given components.

Equal vectors meet first, as one row with a count. Distinct ones are assigned to the nearest of a bounded number of
pivots and cut into blocks; two blocks meet unless the triangle inequality of angles keeps all their pairs apart; the executors plan that. Where
data have no clusters, all blocks meet and the work is quadratic in the distinct vectors; it is never lossy. A task holds
two blocks, counts links, and emits a row a vector: its links there and the smallest vec_id it connects to there.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of different
dimensions. Rows sharing a vec_id are one vertex, whatever their vectors: they have its links together, to each other vec_id once, and
none with each other; for vec_ids with several vectors the pairs of these vectors, and of no others, are written out. Rows with a null
vec_id have no component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import components, saved, tune

THRESHOLD = 0.9
SEED = 11
BLOCK = 4096
MAX_PIVOTS = 1024
SLACK = 1e-3  # angles in radians: more than rounding can move them
STEP = 512
PAIRS = 1 << 14


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the turned vectors, and the correction factor of each."""
    y = unit @ turn.T
    return np.packbits(y > 0, axis=1), np.abs(y).sum(axis=1) / np.sqrt(y.shape[1])


def angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1.0, 1.0))


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (each the smallest index of its set) after joining the sets of a and b, pair by pair."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        parent = np.arange(len(labels))
        np.minimum.at(parent, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        labels = parent[labels]


def exact_pairs(left: dict, right: dict | None, dim: int, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Link counts (weighed by copies) and component labels of the vectors of left, then right; right None: within left. And the linked
    ids of which one is marked as several."""
    own = right is None
    right = left if own else right
    n = len(left["id"])
    total = n if own else n + len(right["id"])
    counts, labels, told = np.zeros(total, np.int64), np.arange(total), []
    signs = (2.0 * np.unpackbits(right["code"], axis=1, count=dim).astype(np.float32) - 1) / np.sqrt(dim, dtype=np.float32)
    turned = (left["unit"] @ rotation(dim).T).astype(np.float32)
    reach = angle(right["factor"]) + np.arccos(threshold) + SLACK
    least = np.where(reach < np.pi, np.cos(np.minimum(reach, np.pi)), -2).astype(np.float32)
    for at in range(0, n, STEP):
        rows = slice(at, min(n, at + STEP))
        maybe = turned[rows] @ signs.T >= least  # the interval of these pairs reaches the threshold
        if own:
            maybe &= np.arange(n)[None, :] > np.arange(n)[rows, None]
        i, j = np.nonzero(maybe)
        i += at
        parts = [slice(k, k + PAIRS) for k in range(0, len(i), PAIRS)]
        sure = [np.einsum("ij,ij->i", left["unit"][i[p]], right["unit"][j[p]]) >= threshold for p in parts]
        if not parts or not (sure := np.concatenate(sure)).any():
            continue
        i, j = i[sure], j[sure]
        counts[:n] += np.bincount(i, right["copies"][j], n).astype(np.int64)
        shift = 0 if own else n
        counts += np.bincount(j + shift, left["copies"][i], total).astype(np.int64)
        labels = joined(labels, i, j + shift)
        if (some := left["several"][i] | right["several"][j]).any():
            told.append((left["id"][i[some]], right["id"][j[some]]))
    return counts, labels, told


def assigned(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, copies, several, dim, vector binary of float64 units, code, factor, cell, far): each vector's code and nearest pivot."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            sizes = np.array([len(v) for v in b.column(3)])
            for dim in np.unique(sizes).tolist():
                pick = np.flatnonzero(sizes == dim)
                x = np.array([b.column(3)[k].as_py() for k in pick.tolist()], np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                turn = turns[dim] if dim in turns else turns.setdefault(dim, rotation(dim))
                code, factor = codes(x, turn)
                if dim == shared.value.shape[1] and len(shared.value):
                    cos = x @ shared.value.T
                    cell = cos.argmax(axis=1)
                    far = angle(cos[np.arange(len(x)), cell])
                else:
                    cell, far = np.full(len(x), -1), np.full(len(x), np.pi)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(pa.array(pick)) for c in range(3)), pa.array([dim] * len(x), pa.int32()), pa.array([r.tobytes() for r in x]), pa.array([r.tobytes() for r in code]), pa.array(factor), pa.array(cell, pa.int32()), pa.array(far)],
                    ["id", "copies", "several", "dim", "unit", "code", "factor", "cell", "far"],
                )

    return vectors.mapInArrow(run, "id long, copies long, several boolean, dim int, unit binary, code binary, factor double, cell int, far double")


def meetings(spark: SparkSession, dims: np.ndarray, cells: np.ndarray, fars: np.ndarray, pivots: np.ndarray, threshold: float) -> DataFrame:
    """(x, y): the pairs of blocks, x <= y, that can hold a link; planned by the executors. Of each block its dimension, cell and largest angle."""
    reach = np.arccos(threshold) + SLACK
    apart = angle(pivots @ pivots.T) if len(pivots) else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast((dims, cells, fars, apart))  # 20 bytes for each block of vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, c, f, between = shared.value
        for b in batches:
            for x in b.column(0).to_pylist():
                ys = np.arange(x, len(d))
                far = (c[x] >= 0) & (c[ys] >= 0) & (between[c[x], c[ys]] - f[x] - f[ys] > reach)
                ys = ys[(d[ys] == d[x]) & ~far]
                for at in range(0, len(ys), 1 << 16):
                    part = ys[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), x, np.int32)), pa.array(part.astype(np.int32))], ["x", "y"])

    return spark.range(0, len(dims)).mapInArrow(run, "x int, y int")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    tune(spark)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = saved(rows.withColumn("v", F.when(F.coalesce(finite, F.lit(False)), F.col("v"))), "vectors")
    owned = rows.where("v is not null and vec_id is not null")
    several = owned.groupBy("vec_id").agg(*(f(h).alias(f"{c}{i}") for i, h in enumerate((F.xxhash64("v"), F.xxhash64(F.lit(1), "v"))) for c, f in (("low", F.min), ("high", F.max))))
    several = saved(several.where("low0 <> high0 or low1 <> high1").select(F.col("vec_id").alias("many")), "vectors-several")
    marked = owned.join(several, owned.vec_id == several.many, "left")
    single = F.when(F.col("many").isNull(), F.col("vec_id"))
    distinct = marked.groupBy("v").agg(F.min("vec_id").alias("first"), F.count_distinct(single).alias("copies"), F.max(F.col("many").isNotNull()).alias("several"))
    distinct = saved(distinct.select(F.monotonically_increasing_id().alias("id"), "first", "copies", "several", "v"), "vectors-distinct")
    n = distinct.count()
    k = min(MAX_PIVOTS, -(-n // block))
    some = [r[0] for r in distinct.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").select("v").limit(4 * k).collect()]  # 4096 rows at most
    dim = max((len(v) for v in some), key=[len(v) for v in some].count, default=1)
    pivots = np.array([v for v in some if len(v) == dim][:k], np.float64).reshape(-1, dim)
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    coded = saved(assigned(distinct.select("id", "copies", "several", "v"), pivots), "vectors-coded")
    per_cell = coded.groupBy("dim", "cell").agg(F.count("*").alias("n"))
    parts = per_cell.select("dim", "cell", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    cut = coded.join(F.broadcast(parts), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    sizes = cut.groupBy("dim", "cell", "part").agg(F.max("far").alias("far")).orderBy("dim", "cell", "part").collect()  # a row a block
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    names = spark.createDataFrame([(r.dim, r.cell, r.part, x) for x, r in enumerate(sizes)], "dim int, cell int, part int, block int")
    plan = meetings(spark, *(np.array([r[c] for r in sizes]) for c in ("dim", "cell", "far")), pivots, threshold)
    both = F.when(F.col("x") == F.col("y"), F.array(F.col("x"))).otherwise(F.array("x", "y"))
    tasks = plan.select("x", "y", F.posexplode(both).alias("side", "block"))
    dealt = cut.join(names, ["dim", "cell", "part"]).join(tasks, "block").select("x", "y", "side", "id", "copies", "several", "dim", "unit", "code", "factor")

    def meet(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        halves = []
        for s in (0, 1):
            t = table.filter(pa.array(side == s))
            if t.num_rows:
                d = t.column("dim")[0].as_py()
                raw = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(t.num_rows, -1)  # noqa: B023, E731
                halves.append({"id": t.column("id").to_numpy(), "copies": t.column("copies").to_numpy(), "several": t.column("several").to_numpy(zero_copy_only=False), "unit": raw("unit", np.float64), "code": raw("code", np.uint8), "factor": t.column("factor").to_numpy()})
        counts, labels, told = exact_pairs(halves[0], halves[1] if len(halves) > 1 else None, d, threshold)
        ids = np.concatenate([h["id"] for h in halves])
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, labels, ids)
        some = (counts > 0) | (low[labels] != ids)
        a, b = (np.concatenate([t[k] for t in told]) if told else np.zeros(0, np.int64) for k in (0, 1))
        none = lambda n: pa.nulls(n, pa.int64())
        out = pa.table({"id": ids[some], "n": counts[some], "low": low[labels][some], "other": none(int(some.sum()))})
        return pa.concat_tables([out, pa.table({"id": a, "n": none(len(a)), "low": none(len(a)), "other": b})])

    met = saved(dealt.groupBy("x", "y").applyInArrow(meet, "id long, n long, low long, other long"), "vectors-met")
    owners = saved(rows.join(several, rows.vec_id == several.many).where("v is not null").join(distinct.select("id", F.col("v").alias("kv")), F.col("v") == F.col("kv")).select("many", "id").distinct(), "vectors-owners")
    together = owners.join(owners.groupBy("many").agg(F.min("id").alias("low")), "many").select(F.col("id").alias("a"), F.col("low").alias("b"))
    found = components(met.where("low is not null").select(F.col("id").alias("a"), F.col("low").alias("b")).union(together), "vectors-links")
    named = distinct.select("id", "first").join(found, F.col("id") == F.col("node"))
    roots = named.groupBy("component").agg(F.min("first").alias("root"))
    linked = met.where("n is not null").groupBy("id").agg(F.sum("n").alias("n"))

    # for vec_ids of several vectors: what their vectors link to, each vector with itself
    pairs = met.where("other is not null").select(F.col("id").alias("v"), F.col("other").alias("w"))
    pairs = pairs.union(pairs.select("w", "v")).union(distinct.where("several").select("id", "id")).distinct()
    others = pairs.join(owners.select(F.col("id").alias("w"), "many"), "w").groupBy("v").agg(F.count_distinct("many").alias("m")).select(F.col("v").alias("id"), "m")
    reached = owners.join(pairs, owners.id == pairs.v).select("many", "w").distinct()
    singles = reached.join(distinct.select(F.col("id").alias("w"), "copies"), "w").groupBy("many").agg(F.sum("copies").alias("s"))
    met_by = reached.join(owners.select(F.col("id").alias("w"), F.col("many").alias("them")), "w").groupBy("many").agg(F.count_distinct("them").alias("t"))
    of_many = singles.join(met_by, "many").select("many", (F.col("s") + F.col("t") - 1).alias("n_many"))

    known = distinct.select("id", "first", "copies", "v").join(linked, "id", "left").join(found, F.col("id") == F.col("node"), "left").join(roots, "component", "left").join(others, "id", "left")
    known = known.select(F.col("v").alias("kv"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), F.coalesce("root", "first").alias("root"))
    own_root = owners.select("many", "id").join(distinct.select("id", "first"), "id").join(found, F.col("id") == F.col("node"), "left").join(roots, "component", "left")
    own_root = own_root.groupBy("many").agg(F.min(F.coalesce("root", "first")).alias("r")).join(of_many, "many")
    out = rows.join(known, rows.v == F.col("kv"), "left").join(own_root, rows.vec_id == own_root.many, "left")
    out = out.withColumn("component_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("r", "root", "vec_id")))
    n_links = F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_many", "n_links", F.lit(0))).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
