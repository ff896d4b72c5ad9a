"""Operator 12, a trie of conversation prefixes from a global sort.

* A turn is the SHA-256 of its role and text (null ones are empty), with the text's size; texts themselves are never shuffled.
  A conversation is the array of its turns' digests, ordered by turn (null first), then role, then digest.
* Conversations are range-sorted by (array, conv_id) over as many partitions as their turns ask for; the conv_id splits groups of
  equal conversations, however large. A task goes through its partition once: the longest common prefix with the conversation
  before closes the nodes below it on a stack of open nodes and opens the new ones. A node whose interval lies within the
  partition is done when it closes. Those on the path of the partition's first or last conversation may go on in
  the neighbours: they are written as open nodes.
* Open nodes of ``FAN`` neighbouring partitions are put in order and swept in the same way by one task, which leaves the open nodes
  of its own ends, and so on until one task has the rest. A task sees at most the two outer paths of each of ``FAN`` summaries.
* Rows whose parent is an open node get the parent's conv_id by a join on (partition, node), so that the root's many children
  are spread. The hash of a node's own conversations is made where the node is done; of an open node, chunks of joined ids are
  streamed in order through one hash, which is sequential by its nature.

Rows with a null conv_id belong to no conversation and are left out. Repeated rows are turns of their own. A conversation without
turns ends at the root. An empty table gives no node. One conversation's digests must fit in a row (some 40 bytes a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.llm.common import saved, tune

FAN = 32
TASK_TURNS = 1 << 20
CHUNK = 2000
OUT_ROWS = 4000
NO_ENDS = hashlib.sha256(b"").hexdigest()

ROW = pa.schema(
    [("kind", pa.string()), ("part", pa.int32()), ("side", pa.int32()), ("depth", pa.int64()), ("digest", pa.binary()), ("n_bytes", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()),
     ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("chunk", pa.int64()), ("ends", pa.string())]
)
ROW_DDL = (
    "kind string, part int, side int, depth long, digest binary, n_bytes long, key binary, parent_key binary, conv_id long, parent_conv_id long,"
    " n_convs long, n_children long, n_leaves long, saved_tokens long, chunk long, ends string"
)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns as structs (turn, role, digest, n_bytes), in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = conversations.where("conv_id is not null").select("conv_id", family("conv_id").alias("family"), turn.alias("t"))
    return rows.repartition("family").groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def family(conv_id: str) -> Column:
    return F.col(conv_id) - F.col(conv_id) % 5


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, digests, sizes): the first h turns of the conversation at the head of the family, then its own turns after its first h."""
    own, h = turns(conversations), F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    head = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("turns", 1, 8))).over(Window.partitionBy("family"))
    got = own.select("conv_id", "turns", h.cast("int").alias("h"), F.coalesce(head, F.slice("turns", 1, 0)).alias("head"))
    both = F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    return got.select("conv_id", both.alias("turns")).select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.n_bytes").alias("sizes"))


@dataclass(slots=True)
class Node:
    """A node under way: what its own conversations and its finished children have given so far."""

    digest: bytes
    n_bytes: int
    first: bool  #: it is on the path of the first conversation, so it may have begun before
    key: bytes | None = None  #: a hash of the digests that lead to it, for nodes that may go beyond the partition
    conv_id: int | None = None
    n_convs: int = 0
    n_children: int = 0
    n_leaves: int = 0
    saved: int = 0
    ids: list[int] = field(default_factory=list)  #: of its own conversations, ascending
    waiting: list[dict] = field(default_factory=list)  #: rows of finished children, which lack this node's conv_id

    def add(self, conv_id: int | None, n_convs: int, n_children: int, n_leaves: int, saved_tokens: int) -> None:
        if conv_id is not None and (self.conv_id is None or conv_id < self.conv_id):
            self.conv_id = conv_id
        self.n_convs += n_convs
        self.n_children += n_children
        self.n_leaves += n_leaves
        self.saved += saved_tokens

    def so_far(self) -> dict:
        return {"conv_id": self.conv_id, "n_convs": self.n_convs, "n_children": self.n_children, "n_leaves": self.n_leaves, "saved_tokens": self.saved}


class Sweep:
    """A stack of open nodes over sorted paths. ``whole``: nothing comes before or after these paths, so that every node is done here."""

    def __init__(self, part: int, whole: bool = False) -> None:
        self.part, self.whole, self.stack, self.rows = part, whole, [], []
        self.first = True

    def close(self, depth: int) -> None:
        """Leaves the nodes from depth on."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            if node.first and not self.whole:
                self.open_row(node, len(self.stack), 0)
            else:
                self.finish(node, self.stack[-1] if self.stack else None, len(self.stack))

    def finish(self, node: Node, above: Node | None, depth: int) -> None:
        """A node that is done is folded into the one above."""
        node.n_leaves = node.n_leaves if node.n_children else 1
        node.saved += (node.n_convs - 1) * node.n_bytes
        self.node_row(node, above, {"kind": "node", "depth": depth, **node.so_far()})
        if above is not None:
            above.add(node.conv_id, node.n_convs, 1, node.n_leaves, node.saved)

    def node_row(self, node: Node, above: Node | None, row: dict) -> None:
        raise NotImplementedError

    def open_row(self, node: Node, depth: int, side: int) -> None:
        self.rows.append({"kind": "open", "part": self.part, "side": side, "depth": depth, "digest": node.digest, "n_bytes": node.n_bytes, "key": node.key, **node.so_far()})

    def end(self) -> None:
        """The nodes of the last path stay open, unless nothing comes behind."""
        if self.whole:
            self.close(0)
        while self.stack:
            node = self.stack.pop()
            self.open_row(node, len(self.stack), 0 if node.first else 1)

    def batches(self, least: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            rows, self.rows = self.rows, []
            yield pa.RecordBatch.from_pylist(rows, schema=ROW)


class Conversations(Sweep):
    """The sweep over a partition's conversations."""

    def take(self, conv_id: int, digests: list[bytes], sizes: list[int]) -> None:
        if not self.stack:
            self.stack.append(Node(b"", 0, True, key_of(b"", b"")))
        common, most = 0, min(len(digests), len(self.stack) - 1)
        while common < most and self.stack[common + 1].digest == digests[common]:
            common += 1
        self.close(common + 1)
        for digest, n_bytes in zip(digests[common:], sizes[common:], strict=True):
            self.stack.append(Node(digest, n_bytes, self.first, key_of(self.stack[-1].key, digest) if self.first else None))
        self.first = False
        self.stack[-1].add(conv_id, 1, 0, 0, 0)
        self.stack[-1].ids.append(conv_id)

    def node_row(self, node: Node, above: Node | None, row: dict) -> None:
        self.rows += [{**below, "parent_conv_id": node.conv_id} for below in node.waiting]
        row["ends"] = hashlib.sha256(",".join(map(str, node.ids)).encode()).hexdigest() if node.ids else NO_ENDS
        if above.first:
            self.rows.append({**row, "part": self.part, "parent_key": above.key})
        else:
            above.waiting.append(row)

    def open_row(self, node: Node, depth: int, side: int) -> None:
        self.rows += [{**below, "part": self.part, "parent_key": node.key} for below in node.waiting]
        for chunk, at in enumerate(range(0, len(node.ids), CHUNK)):
            self.rows.append({"kind": "ends", "part": self.part, "key": node.key, "chunk": chunk, "ends": ",".join(map(str, node.ids[at : at + CHUNK]))})
        super().open_row(node, depth, side)

    def end(self) -> None:
        for above, node in zip(self.stack, self.stack[1:], strict=False):
            node.key = node.key or key_of(above.key, node.digest)
        super().end()


class Summaries(Sweep):
    """The sweep over the open nodes that neighbouring partitions left: of each the first path, then what the last path has beside it."""

    def take(self, path: list[dict]) -> None:
        same = 0
        if path[0]["depth"] == 0:
            while same < min(len(path), len(self.stack)) and self.stack[same].digest == path[same]["digest"]:
                same += 1
        self.close(path[0]["depth"] + same)
        self.stack += [Node(row["digest"], row["n_bytes"], self.first, row["key"]) for row in path[same:]]
        self.first = False
        for row in path:
            self.stack[row["depth"]].add(*(row[c] for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")))

    def node_row(self, node: Node, above: Node | None, row: dict) -> None:
        self.rows.append({**row, "key": node.key, "parent_key": above.key if above else None})


def key_of(above: bytes, digest: bytes) -> bytes:
    return hashlib.sha256(above + digest).digest()


def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a partition."""
    sweep = Conversations(TaskContext.get().partitionId())
    for batch in batches:
        for conv_id, digests, sizes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digests", "sizes")), strict=True):
            sweep.take(conv_id, digests, sizes)
            yield from sweep.batches()
    sweep.end()
    yield from sweep.batches(1)


def stitched(whole: bool) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    """The function of a task over ``FAN`` neighbouring summaries."""

    def run(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sweep = Summaries(group[0].as_py(), whole)
        rows = table.sort_by([("part", "ascending"), ("side", "ascending"), ("depth", "ascending")]).to_pylist()
        for _, path in groupby(rows, key=itemgetter("part", "side")):
            sweep.take(list(path))
        sweep.end()
        return pa.Table.from_pylist(sweep.rows, schema=ROW)

    return run


def prefix_trie(conversations: DataFrame, task_turns: int = TASK_TURNS, fan: int = FAN) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node; see the module."""
    spark = conversations.sparkSession
    tune(spark)
    whole = saved(rebuilt(conversations.select("conv_id", "turn", "role", "text")), "trie-turns")
    size = whole.agg(F.sum(F.size("digests") + F.lit(1))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // task_turns))
    ordered = whole.repartitionByRange(ranges, "digests", "conv_id").sortWithinPartitions("digests", "conv_id")
    leaf = saved(ordered.mapInArrow(swept, ROW_DDL), "trie-leaves")

    rows, done = leaf.where("kind = 'open'"), []
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        level = saved(rows.groupBy(F.expr(f"cast(part div {fan} as int)").alias("group")).applyInArrow(stitched(parts <= fan), ROW_DDL), "trie-level")
        done.append(level.where("kind = 'node'"))
        if parts <= fan:
            return named(leaf, reduce(DataFrame.union, done))
        rows, parts = level.where("kind = 'open'"), -(-parts // fan)


def named(leaf: DataFrame, done: DataFrame) -> DataFrame:
    """All nodes with their parents' conv_ids; those that were open with the hashes of their conversations."""
    counts = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    names = done.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("name"))
    slots = leaf.where("kind = 'open'").select("part", F.col("key").alias("parent_key")).join(names, "parent_key")
    nodes = leaf.where("kind = 'node'")
    within = nodes.where("parent_key is null").select("conv_id", "depth", "parent_conv_id", *counts, F.col("ends").alias("ends_sha256"))
    below = nodes.where("parent_key is not null").join(slots, ["part", "parent_key"]).select("conv_id", "depth", F.col("name").alias("parent_conv_id"), *counts, F.col("ends").alias("ends_sha256"))
    chunks = leaf.where("kind = 'ends'").select("key", "part", "chunk", "ends").repartition("key").sortWithinPartitions("key", "part", "chunk")
    own = done.select("key", "parent_key", "conv_id", "depth", *counts).join(names, "parent_key", "left").join(chunks.mapInArrow(streamed, "key binary, ends_sha256 string"), "key", "left")
    own = own.select("conv_id", "depth", F.col("name").alias("parent_conv_id"), *counts, F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    return within.union(below).union(own)


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each key over its chunks, which come in order."""
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    at, sha, out = None, None, []
    for batch in batches:
        for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if key != at:
                if at is not None:
                    out.append({"key": at, "ends_sha256": sha.hexdigest()})
                at, sha = key, hashlib.sha256(ends.encode())
            else:
                sha.update(b"," + ends.encode())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if at is not None:
        yield pa.RecordBatch.from_pylist([{"key": at, "ends_sha256": sha.hexdigest()}], schema=schema)
