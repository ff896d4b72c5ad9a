"""The service's reading calls, as functions from DataFrames to DataFrames. None collects; each is one plan.

Tables: documents(doc_id, text, lang, source), questions(item_id, text), cells(sheet, row_at, col_at, value), events(event_id, user_id, ...),
folders(id, parent_id, name).
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import dialect
from fathom.operators import prose, retrieval
from fathom.sources import postings


def over(sql: str, **tables: DataFrame) -> DataFrame:
    """sql in the shared dialect with table names standing for the given DataFrames."""
    spark = next(iter(tables.values())).sparkSession
    text = dialect(dialect(sql, 0), 0)
    for name, df in tables.items():
        view = f"{name}_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        text = re.sub(rf"\b(from|join) {name}\b", rf"\1 {view}", text)
    return spark.sql(text)


def scoped(documents: DataFrame, languages: list[str] | None = None, folders: list[str] | None = None, doc_ids: DataFrame | None = None) -> DataFrame:
    """Documents within a scope. None doesn't restrict; an empty list or table leaves nothing."""
    out = documents
    if languages is not None:
        out = out.where(F.col("lang").isin(languages))
    if folders is not None:
        inside = F.lit(False)
        for folder in folders:
            inside = inside | (F.col("source") == folder) | F.col("source").startswith(folder.rstrip("/") + "/")
        out = out.where(inside)
    return out if doc_ids is None else out.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")


def missing(requested: DataFrame, documents: DataFrame, indexed: DataFrame) -> DataFrame:
    """(doc_id, reason) of requested documents that can't be searched: unknown, or known and not_indexed."""
    known = documents.select("doc_id", F.lit(True).alias("_known")).distinct()
    left = requested.select("doc_id").distinct().join(indexed.select("doc_id").distinct(), "doc_id", "left_anti")
    return left.join(known, "doc_id", "left").select("doc_id", F.when(F.col("_known"), "not_indexed").otherwise("unknown").alias("reason"))


def search(questions: DataFrame, documents: DataFrame, limit: int = 6, index: postings.Index | None = None) -> DataFrame:
    """(item_id, doc_id, score, place): the hybrid search of all questions at once. Restrict documents with ``scoped`` first:
    nothing outside the scope is ranked, or counts in a statistic. index: of these documents, from ``postings.build``, if it is kept."""
    (index or postings.build(documents.select("doc_id", "lang", "text"))).views(documents.sparkSession)
    sql = retrieval.INDEXED + retrieval.HYBRID.replace("place <= 6", f"place <= {int(limit)}")
    return over(sql, benchmark=questions, documents=documents)


def context(questions: DataFrame, documents: DataFrame, index: postings.Index | None = None) -> DataFrame:
    """(item_id, doc_id, used): passages that fit the token budget, in order."""
    (index or postings.build(documents.select("doc_id", "lang", "text"))).views(documents.sparkSession)
    return over(retrieval.INDEXED + retrieval.PACK[0], benchmark=questions, documents=documents)


def query(questions: DataFrame, documents: DataFrame, index: postings.Index | None = None) -> DataFrame:
    """questions (item_id, text) with what each asks for (kind, quantities, operation, bound, role, unit, subjects, conditions, failure) and hits,
    array<struct<place, doc_id, score, used>>: the search's documents in order, and the tokens that the context has taken with each that fits."""
    index = index or postings.build(documents.select("doc_id", "lang", "text"))
    hits = search(questions, documents, index=index).join(context(questions, documents, index), ["item_id", "doc_id"], "left")
    held = hits.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("place", "doc_id", "score", "used"))).alias("hits"))
    return prose.contract(questions).join(held, "item_id", "left")


def citation(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """citations (doc_id, start_at, end_at, digest) with quote and status: ok; missing, if no document has the id; out_of_range, if the span
    doesn't lie in the text; changed, if the quote's SHA-256 isn't digest."""
    texts = documents.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"), F.lit(True).alias("_known"))
    both = citations.join(texts, F.col("doc_id") == F.col("_doc"), "left")
    inside = (F.col("start_at") >= 0) & (F.col("start_at") < F.col("end_at")) & (F.col("end_at") <= F.length("_text"))
    quote = F.when(inside, F.expr("substring(_text, cast(start_at + 1 as int), cast(end_at - start_at as int))"))
    told = both.withColumn("quote", quote)
    status = F.when(F.col("_known").isNull(), "missing").when(F.col("quote").isNull(), "out_of_range").when(F.sha2("quote", 256) == F.col("digest"), "ok").otherwise("changed")
    return told.withColumn("status", status).select(*citations.columns, "quote", "status")


def readiness(index: postings.Index, documents: DataFrame) -> DataFrame:
    """One row (n_documents, n_counted, n_indexed, n_unindexed, ready): whether the index counts as many documents as there are, and has
    postings of each that has words."""
    spark = documents.sparkSession
    words = documents.where(F.col("text").rlike("[\\p{L}\\p{N}]")).select("doc_id").distinct()
    have = spark.table(index.postings).select("doc_id").distinct()
    counts = [documents.agg(F.count("*").alias("n_documents")), spark.table(index.whole).select(F.col("n").alias("n_counted")), have.agg(F.count("*").alias("n_indexed")), words.join(have, "doc_id", "left_anti").agg(F.count("*").alias("n_unindexed"))]
    row = counts[0]
    for other in counts[1:]:
        row = row.crossJoin(other)  # rows of one
    return row.withColumn("ready", (F.col("n_documents") == F.col("n_counted")) & (F.col("n_unindexed") == 0))


def outline(documents: DataFrame) -> DataFrame:
    """(doc_id, section, n_blocks, n_chars) of every section."""
    from fathom.operators import corpus

    return over(corpus.QUERIES["scope_section"], documents=documents)


def sheet_cells(cells: DataFrame, sheet: str, rows: tuple[int, int], cols: tuple[int, int], most: int = 10_000) -> DataFrame:
    """Cells of a window, refused where it holds more than ``most`` positions."""
    if (rows[1] - rows[0] + 1) * (cols[1] - cols[0] + 1) > most:
        raise ValueError(f"the window holds more than {most} positions")
    return cells.where((F.col("sheet") == sheet) & F.col("row_at").between(*rows) & F.col("col_at").between(*cols))


def events_since(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events of each user after its cursor (user_id, event_id); users without a cursor give all."""
    c = cursors.groupBy("user_id").agg(F.max("event_id").alias("_at"))
    return events.join(c, "user_id", "left").where(F.col("_at").isNull() | (F.col("event_id") > F.col("_at"))).drop("_at")


def page_before(events: DataFrame, anchor: tuple | None, size: int) -> DataFrame:
    """The newest ``size`` events before anchor (ts, event_id), newest first, and one more that says whether a page follows."""
    out = events
    if anchor is not None:
        ts, at = F.lit(anchor[0]), F.lit(anchor[1])
        out = out.where((F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("event_id") < at)))
    return out.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(size + 1)


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of each key the last row by order; the order must end in a unique column."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
