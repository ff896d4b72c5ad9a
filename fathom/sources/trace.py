"""Hash-chained logs: each event of a key holds the digest of the one before it.

``chain`` writes them in one pass over rows sorted within their partition, holding one digest a key; ``verify`` needs no order of
execution, since every row is checked against its own content and its predecessor's digest. Null payloads count as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START = "0" * 64


def event_digest(key: str, sequence: int, payload: str, previous: str) -> str:
    return hashlib.sha256(f"{key}\n{sequence}\n{payload}\n{previous}".encode()).hexdigest()


def chain(rows: DataFrame) -> DataFrame:
    """rows (key, at, id, payload) as (key, sequence, id, payload, payload_sha256, previous_sha256, event_sha256), by at and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sequence, previous = None, 0, START
        for b in batches:
            out = []
            for k, i, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if k != key:
                    key, sequence, previous = k, 0, START
                sequence += 1
                digest = hashlib.sha256((payload or "").encode()).hexdigest()
                own = event_digest(k, sequence, digest, previous)
                out.append((k, sequence, i, payload, digest, previous, own))
                previous = own
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, types)], names)

    names = ["key", "sequence", "id", "payload", "payload_sha256", "previous_sha256", "event_sha256"]
    schema = "key string, sequence long, id long, payload string, payload_sha256 string, previous_sha256 string, event_sha256 string"
    text = rows.where("key is not null").select(F.col("key").cast("string"), "at", F.col("id").cast("long"), "payload")
    return text.repartition("key").sortWithinPartitions("key", "at", "id").select("key", "id", "payload").mapInArrow(run, schema)


def verify(events: DataFrame) -> DataFrame:
    """events with status: ok, payload_modified, event_modified or chain_broken (its predecessor is missing, or another)."""
    before = F.lag("event_sha256").over(Window.partitionBy("key").orderBy("sequence"))
    numbered = F.coalesce(F.lag("sequence").over(Window.partitionBy("key").orderBy("sequence")), F.lit(0)) + 1
    seen = F.sha2(F.concat_ws("\n", "key", F.col("sequence").cast("string"), "payload_sha256", "previous_sha256"), 256)
    status = (
        F.when(F.sha2(F.coalesce("payload", F.lit("")), 256) != F.col("payload_sha256"), "payload_modified")
        .when(seen != F.col("event_sha256"), "event_modified")
        .when((F.col("previous_sha256") != F.coalesce(F.col("_before"), F.lit(START))) | (F.col("sequence") != F.col("_number")), "chain_broken")
        .otherwise("ok")
    )
    return events.withColumns({"_before": before, "_number": numbered}).withColumn("status", status).drop("_before", "_number")
