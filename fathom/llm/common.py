"""Helpers that the operators of this subpackage share.

Conventions that hold for all of them:

* Working tables go, as Parquet, to the shared folder that ``spark.checkpoint.dir`` names; only where it is unset
  (tests) a folder of the driver's temp directory is used. No operator uses a machine-local folder on a cluster.
* Only the named columns of an input are read; extra columns and clashing names do no harm.
* Arrow batches are bounded in rows and bytes, so a worker's memory doesn't depend on the table.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 2000
ARROW_BYTES = 8 << 20
FILTER_ROWS = 1 << 18
BUCKET_BYTES = 4 << 20
GROUP = 32


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def give_back() -> None:
    """Returns freed memory to the system: a worker lives through several stages, beside a JVM that needs the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder for working tables: the session's ``spark.checkpoint.dir``, or a temp folder where that is unset and all run in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    if not where:
        where = tempfile.mkdtemp(prefix="fathom-")
        atexit.register(shutil.rmtree, where, True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors. codec: lz4_raw for tables of hashes, which
    don't shrink, takes no memory outside the heap."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/fathom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def unused(df: DataFrame, name: str) -> str:
    """name, or that name with underscores behind it, so that df has no such column."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def bucket_bits(docs: DataFrame) -> int:
    """Bits of a number of buckets, by the size of docs' texts, so that a bucket holds what some BUCKET_BYTES of text give."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8, min(24, (size // BUCKET_BYTES).bit_length()))



def sifted(df: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose column name (long) may be in the column of that name of ids: a bit filter of at most ``FILTER_ROWS`` rows,
    one long each, is broadcast. It loses no row that is in ids; the more ids there are, the more others it lets through."""
    word = F.expr(f"pmod(xxhash64({name}), {64 * FILTER_ROWS}) div 64")
    place = F.expr(f"cast(pmod(xxhash64({name}), 64) as int)")
    bits = ids.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("_bits"))
    held = F.call_function("shiftright", F.col("_bits"), place).bitwiseAND(1) == 1
    return df.join(F.broadcast(bits), word == F.col("_word")).where(held).drop("_word", "_bits")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of links (a long, b long): (node, component), component = smallest node reachable.

    Alternating large-star and small-star steps on an edge table, each round written to the shared folder; the driver
    sees only whether a round is still needed. A hub costs an aggregation with map-side combine and a join that adaptive
    execution can split. Rows with a null end and self-links are ignored; no links give an empty table.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = saved(edges.where("a is not null and b is not null and a <> b").distinct(), name)
    while not settled(edges):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.union(low).distinct(), name)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def settled(edges: DataFrame) -> bool:
    """True if every edge leads from a node with no other edge to a node that none leads from: then components are stars."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out = 1 and into = 1").isEmpty()


def linked(rows: DataFrame, attributes: tuple[str, ...], alike: Column, verified: Callable[[DataFrame, str], DataFrame], name: str, group: int = GROUP, codec: str = "zstd") -> DataFrame:
    """Links (a, b) between ids that connect all linked members of the same key, without a row for each pair of a large group.

    rows: (key, ref long, id, own, n, weight, attributes): member ref, named id, has key with n members in all; two members can be
    linked if one of them owns the key. alike: what linked members share, over the columns <attribute>_a and _b. verified gives the
    links among pairs (a, b) of refs. Members of keys of at most ``group`` are compared with each other; of larger ones with the
    heaviest owner only, and then, where that leaves a key in several components, those of different components.
    """
    rows = saved(rows.select("key", "ref", "id", "own", "n", "weight", *attributes), f"{name}-members", codec)
    sides = lambda df, x, *columns: df.select("key", *(F.col(c).alias(f"{c}_{x}") for c in columns))
    pair = (F.least("ref_a", "ref_b").alias("a"), F.greatest("ref_a", "ref_b").alias("b"))

    def meeting(some: DataFrame, condition: Column | None = None) -> DataFrame:
        columns = [c for c in some.columns if c != "key"]
        left, right = sides(some.where("own"), "a", *columns), sides(some, "b", *columns)
        once = F.when(F.col("own_b"), F.col("ref_a") < F.col("ref_b")).otherwise(F.col("ref_a") != F.col("ref_b"))
        return left.join(right, (left.key == right.key) & once & alike & (F.lit(True) if condition is None else condition)).select(*pair)

    small, large = rows.where(F.col("n") <= group), rows.where(F.col("n") > group)
    heart = large.where("own").groupBy("key").agg(F.max_by(F.struct("ref", *attributes), F.struct("weight", "ref")).alias("c"))
    heart = heart.select("key", *(F.col(f"c.{c}").alias(f"{c}_a") for c in ("ref", *attributes)))
    spokes = sides(large, "b", "ref", *attributes).join(heart, "key").where((F.col("ref_a") != F.col("ref_b")) & alike).select(*pair)
    found = verified(meeting(small.select("key", "ref", "own", *attributes)).union(spokes), name)
    if large.isEmpty():
        return found
    near = components(found, f"{name}-groups")
    large = large.join(near, large.id == near.node, "left").select("key", "ref", "own", *attributes, F.coalesce("component", "id").alias("part"))
    large = saved(large, f"{name}-parts", codec)
    mixed = large.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("key")
    return found.union(verified(meeting(large.join(mixed, "key", "left_semi"), F.col("part_a") != F.col("part_b")), f"{name}-rest"))
