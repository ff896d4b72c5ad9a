"""A stored postings index of a collection, dealt by document, and text vectors beside it.

``build`` reads the texts once for words and writes these tables:

* lists(doc_id, lang, n, total, terms, held): a row a document, bucketed by doc_id, with its words in an array, beside them held, array of
  struct<term, tf, size> with the words' hashes; n rows of the collection with total words. A document's postings lie in one row, so scores
  are summed without a shuffle, and a common word is spread over all buckets like the documents that have it.
* postings(doc_id, lang, term, tf, size): a view of the same, a row a word.
* terms(term, df, axis, sign): in how many documents a word stands, and the axis of the text vector it counts towards.
* vectors(doc_id, lang, vector), made only when a dense search asks for it: a unit vector of AXES components for each document with words, bucketed like the postings: words
  weigh (1 + ln tf) ln(1 + n / df) and are dealt to axes by a hash, with a sign.

``of`` keeps an index for each state of a collection (files, sizes, times of change) in the session, so that all queries share one.
Null texts count as documents without words. Rows that share doc_id and lang are one document with the words of all.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import dialect

AXES = 64
BUCKET_BYTES = 64 << 20

#: Of a word, by its MD5: axis and sign, as SQL for Spark and for the oracle.
AXIS = ("cast(conv(substr(md5(term), 1, 2), 16, 10) as int) % 64", "cast('0x' || substr(md5(term), 1, 2) as int) % 64")
SIGN = "case when substr(md5(term), 3, 1) < '8' then 1 else -1 end"


@dataclass(frozen=True)
class Index:
    """Names of the tables of an index, and of the collection: documents, mean number of words."""

    lists: str
    postings: str
    terms: str
    whole: str
    buckets: int
    vectors: str | None = None

    def views(self, spark: SparkSession) -> None:
        """Makes the index readable as idx_lists, idx_postings, idx_terms, idx_whole and, if it has vectors, idx_vectors."""
        for name in ("lists", "postings", "terms", "whole", *(["vectors"] if self.vectors else [])):
            spark.table(getattr(self, name)).createOrReplaceTempView(f"idx_{name}")

    def dense(self, spark: SparkSession) -> Index:
        """The index with vectors."""
        if self.vectors:
            return self
        rows = spark.sql(vectors_of(self.postings, self.terms, self.whole, "doc_id, lang"))
        return replace(self, vectors=written(rows, "vectors", self.buckets, "doc_id"))


def folder(spark: SparkSession) -> str:
    """Where indexes lie: the folder that ``spark.checkpoint.dir`` names, or a temp folder where all runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    if not where:
        where = tempfile.mkdtemp(prefix="fathom-")
        atexit.register(shutil.rmtree, where, True)
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/fathom"


def written(df: DataFrame, name: str, buckets: int | None = None, *order: str) -> str:
    spark, table = df.sparkSession, f"fathom_{name}_{uuid.uuid4().hex}"
    out = df.write.option("path", f"{folder(spark)}/{table}").option("compression", "zstd")
    (out.bucketBy(buckets, "doc_id").sortBy(*(order or ("doc_id",))) if buckets else out).saveAsTable(table)
    return table


def dealt(documents: DataFrame) -> int:
    """The number of buckets for documents (text)."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def build(documents: DataFrame) -> Index:
    """Indexes documents (doc_id, lang, text)."""
    spark = documents.sparkSession
    buckets = dealt(documents)
    words = documents.select("doc_id", "lang", F.expr(dialect("<FOLDED:coalesce(text, '')>", 0)).alias("words"))
    lists = written(counted(words.withColumn("size", F.size("words")), buckets), "postings", buckets)
    rows = spark.table(lists)
    postings = f"fathom_rows_{uuid.uuid4().hex}"
    rows.selectExpr("doc_id", "lang", "inline(arrays_zip(terms, held))").selectExpr("doc_id", "lang", "terms as term", "held.tf", "held.size").createOrReplaceGlobalTempView(postings)
    whole = written(rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).selectExpr("n", "try_divide(cast(total as double), n) as mean"), "whole")  # one row
    terms = written(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).selectExpr("term", "df", f"{AXIS[0]} as axis", f"{SIGN} as sign"), "terms")
    return Index(lists, f"global_temp.{postings}", terms, whole, buckets)


def counted(rows: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, lang, n, total, terms, held), as the table lists, of rows (doc_id, lang, words, size): words with repeats, size as their number counts.

    Rows of one doc_id and lang meet in one of as many partitions as buckets, where a batch of them is counted at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts")
            flat = parts.flatten()
            words, sizes = pc.split_pattern(flat.field("words"), " "), flat.field("size").to_numpy().astype(np.int64)
            held = np.diff(parts.offsets.to_numpy())
            of = np.repeat(np.arange(len(batch)), held)  # the row of each part
            lengths = np.diff(words.offsets.to_numpy())
            terms = words.flatten()
            some = pc.binary_length(terms).to_numpy(zero_copy_only=False) > 0  # no words, joined, are one empty part
            coded = terms.dictionary_encode()
            n = max(1, len(coded.dictionary))
            key, weighs = (np.repeat(of, lengths) * n + coded.indices.to_numpy())[some], np.repeat(sizes, lengths)[some]
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            size = np.maximum.reduceat(weighs[order], starts) if len(starts) else starts
            ends = np.searchsorted(key[starts], np.arange(len(batch) + 1) * n).astype(np.int32)
            lists = [coded.dictionary.take(pa.array(key[starts] % n)).cast(pa.string()), pa.array(np.diff(starts, append=len(key)), pa.int64()), pa.array(size, pa.int64())]
            total = np.zeros(len(batch), np.int64)
            np.add.at(total, of, sizes)
            out = [pa.ListArray.from_arrays(pa.array(ends), x) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(held, pa.int64()), pa.array(total), *out], ["doc_id", "lang", "n", "total", "terms", "tfs", "sizes"])

    met = rows.select(F.col("doc_id").cast("long"), "lang", F.array_join("words", " ").alias("words"), "size").repartition(buckets, "doc_id").groupBy("doc_id", "lang").agg(F.collect_list(F.struct("words", "size")).alias("parts"))
    got = met.mapInArrow(run, "doc_id long, lang string, n long, total long, terms array<string>, tfs array<long>, sizes array<long>")
    return got.select("doc_id", "lang", "n", "total", "terms", F.expr("transform(terms, (t, i) -> struct(xxhash64(t) as term, tfs[i] as tf, sizes[i] as size)) as held"))


def vectors_of(rows: str, terms: str, whole: str, key: str) -> str:
    """Spark SQL for (key, vector) of the rows (key, term, tf)."""
    return f"""select {key}, transform(v, x -> x / norm) as vector from (select {key}, inline(transform(array(v), v -> struct(v, sqrt(aggregate(v, 0D, (s, x) -> s + x * x)) as norm))) from
        (select {key}, transform(sequence(0, {AXES - 1}), i -> coalesce(m[i], 0D)) as v from (select {key}, map_from_entries(collect_list(struct(axis, rate))) as m from
        (select {key}, axis, sum(sign * (1 + ln(tf)) * ln(1 + n / df)) as rate from {rows} p join {terms} t on p.term = t.term cross join {whole} w group by {key}, axis) x group by {key}) y) z) u where norm > 0"""


_KEPT: dict[tuple, Index] = {}


def of(spark: SparkSession, documents: DataFrame, dense: bool = False) -> Index:
    """The index of a collection read from files; built when these files are first seen by the session, with vectors when they are first asked for."""
    seen = documents.select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").alias("at")).distinct()
    state = seen.agg(F.count("*"), F.sum(F.xxhash64("file_path", "file_size", "at").cast("decimal(38,0)"))).first()
    key = (spark.sparkContext.applicationId, *state)
    if key not in _KEPT:
        _KEPT[key] = build(documents)
    if dense:
        _KEPT[key] = _KEPT[key].dense(spark)
    return _KEPT[key]
