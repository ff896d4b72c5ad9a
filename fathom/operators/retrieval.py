"""Retrieval: BM25, dense cosine, exact identifiers first, reciprocal-rank fusion, de-duplication and the final cap.

Spark reads the stored postings of ``fathom.sources.postings``: the questions' words, with their weights, meet the postings of each
document where they lie, and only what may be among the first of a question is shuffled. The oracle computes all from the texts.

All passages of ``benchmark`` are questions; a question is the disjunction of its words, repeats counted again
(of its first 64 words only in the queries marked ``head``).
BM25: k1 1.2, b 0.75, idf 1e-6 where it isn't positive, statistics of the whole corpus; fusion: 1 / (60 + rank).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.functions import dialect, flagged, flags
from fathom.sources import postings, register, table

ASKED = """with docs as (select doc_id, lang, <FOLDED:coalesce(text, '')> as words from documents),
    asked as (select item_id, term, count(*) as times from (select item_id, <EX>(words) as term from (select item_id, <FOLDED:text> as words from benchmark) q) x group by item_id, term),
    postings as (select p.doc_id, p.lang, p.term, max(p.size) as size, count(*) as tf from (select doc_id, lang, <SIZE>(words) as size, <EX>(words) as term from docs) p
        left semi join (select distinct term from asked) w on p.term = w.term group by p.doc_id, p.lang, p.term)"""

WEIGHT = "a.times * i.idf * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.size / i.mean))"

BM25 = (
    ASKED
    + f""",
    whole as (select count(*) as n, avg(<SIZE>(words)) as mean from docs),
    idf as (select term, max(w.mean) as mean, case when max(w.n) > 2 * count(*) then ln((max(w.n) - count(*) + 0.5) / (count(*) + 0.5)) else 0.000001 end as idf from postings cross join whole w group by term),
    scored as (select a.item_id, p.doc_id, round(sum({WEIGHT}), 6) as score, count(*) as n from asked a join postings p on a.term = p.term join idf i on i.term = p.term group by a.item_id, p.doc_id),
    lexical as (select * from (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as place from scored) x where place <= 24)"""
)

#: The questions' words with their weights, from the stored postings.
ASKS = "with asked as (select item_id, term, count(*) as times from (select item_id, explode(words) as term from (select item_id, <FOLDED:text> as words from benchmark) q) x group by item_id, term)"
WEIGHTED = ASKS + """,
    weighted as (select a.item_id, a.term, w.mean, a.times * case when w.n > 2 * t.df then ln((w.n - t.df + 0.5) / (t.df + 0.5)) else 0.000001 end as rate from asked a join idx_terms t on a.term = t.term cross join idx_whole w)"""

#: All scores, each where its document's postings lie.
INDEXED = (
    WEIGHTED
    + """,
    scored as (select q.item_id, p.doc_id, round(sum(q.rate * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.size / q.mean))), 6) as score, count(*) as n from idx_postings p join weighted q on p.term = q.term group by q.item_id, p.doc_id),
    lexical as (select * from (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as place from scored) x where place <= 24)"""
)

#: The same scores, as far as they may be among the first of a question (``best``).
FIRST = (
    WEIGHTED
    + """,
    scored as (select distinct item_id, doc_id, score, n from idx_best),
    lexical as (select * from (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as place from scored) x where place <= 24)"""
)


def headed(sql: str, head: bool = True) -> str:
    """sql with questions of their first 64 words."""
    return sql.replace("(words) as term from (select item_id", "(<HEAD:words|64>) as term from (select item_id") if head else sql


def rated(spark: SparkSession, sf_dir: str, sql: str, dense: bool = False, head: bool = False) -> None:
    """Makes the tables that sql names, the index and the best scores of the questions readable; with vectors, of documents that have one."""
    register(spark, sf_dir, sql)
    postings.of(spark, table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), dense).views(spark)
    held = spark.table("idx_lists")
    if dense:
        held = held.join(spark.table("idx_vectors").select("doc_id"), "doc_id", "left_semi")
    weighted = spark.table(postings.written(spark.sql(dialect(headed(WEIGHTED, head), 0) + " select * from weighted"), "weighted"))
    found = best(listed(held), weighted.withColumn("term", F.expr(TERM)))
    spark.table(postings.written(found, "best")).createOrReplaceTempView("idx_best")


def indexed(sql: str, head: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """A query text that reads the stored postings of documents, beside other tables."""
    own = dialect(dialect(headed(FIRST, head) + sql, 0), 0)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rated(spark, sf_dir, own, head=head)
        return spark.sql(own)

    return run


def both(sql: str, oracle: str | None = None, head: bool = False) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """What follows the scores, over the stored postings and, as oracle, over the texts."""
    return indexed(sql, head), headed(BM25, head) + (oracle or sql)


#: Both lanes, by score and by the number of shared words, from one pass over the scores.
FUSED = """,
    lanes as (select item_id, doc_id, place from (select *, row_number() over (partition by item_id, lane order by rate desc, doc_id) as place from
        (select s.item_id, s.doc_id, l.lane, case when l.lane = 1 then s.score else cast(s.n as double) end as rate from scored s cross join (values (1), (2)) l(lane)) y) x where place <= 24),
    fused as (select item_id, doc_id, round(sum(cast(1 as double) / (60 + cast(place as double))), 6) as score from lanes group by item_id, doc_id)"""

#: Containment of a passage in a document, as words. Spark: documents' runs of eight words meet the passage's first eight (or first
#: word, if it is shorter), then the whole is compared; the oracle compares all. Only runs whose first two words are flagged are written out.
BEGINS = 1 << 14
CONTAINED = (
    f""", passages as (select item_id, array_join(words, ' ') as joined, case when size(words) >= 8 then array_join(slice(words, 1, 8), ' ') else words[0] end as probe
            from (select item_id, regexp_extract_all(lower(text), r'[\\p{{L}}\\p{{N}}]+', 0) as words from benchmark) b where size(words) > 0),
        begins as ({flags("select case when size(words) >= 8 then xxhash64(words[0], words[1]) else xxhash64(words[0]) end as h from (select regexp_extract_all(lower(text), r'[\\p{L}\\p{N}]+', 0) as words from benchmark) b where size(words) > 0", BEGINS)}),
        plain as (select doc_id, regexp_extract_all(lower(text), r'[\\p{{L}}\\p{{N}}]+', 0) as words from documents),
        runs as (select /*+ broadcast(f) */ doc_id, explode(concat(filter(words, w -> {flagged("xxhash64(w)", BEGINS)}), case when size(words) >= 8 then
            transform(filter(sequence(1, size(words) - 7), i -> {flagged("xxhash64(words[i - 1], words[i])", BEGINS)}), i -> array_join(slice(words, i, 8), ' ')) else array() end)) as probe from plain cross join begins f),
        held as (select distinct doc_id, probe from (select /*+ broadcast(p) */ r.* from runs r left semi join passages p on p.probe = r.probe) x),
        meets as (select p.item_id, r.doc_id, p.joined from passages p join held r on p.probe = r.probe),
        expected as (select m.item_id, d.doc_id from meets m join plain d on m.doc_id = d.doc_id where locate(concat(' ', m.joined, ' '), concat(' ', array_join(d.words, ' '), ' ')) > 0)""",
    """, expected as (select b.item_id, d.doc_id from (select item_id, array_to_string(<WORDS:text>, ' ') as joined from benchmark) b
        join (select doc_id, array_to_string(<WORDS:text>, ' ') as joined from documents) d on length(b.joined) > 0 and contains(' ' || d.joined || ' ', ' ' || b.joined || ' '))""",
)
RECALL = """ select count(*) as n_expected, count(l.doc_id) as n_found, round(count(l.doc_id) / cast(count(*) as double), 6) as recall
    from expected e left join lexical l on l.item_id = e.item_id and l.doc_id = e.doc_id"""
MRR = """, found as (select e.item_id, min(l.place) as place from expected e join lexical l on l.item_id = e.item_id and l.doc_id = e.doc_id and l.place <= 10 group by e.item_id)
    select count(*) as n, count(f.place) as n_found, round(sum(coalesce(1 / cast(f.place as double), 0)) / count(*), 6) as mrr from benchmark b left join found f on f.item_id = b.item_id"""

#: Context packing: passages in order of fusion, one token for four characters and one more; a passage that overflows is skipped.
#: Spark folds over a question's at most 24 candidates; the oracle walks them with a recursive query.
BUDGET = 2560
OFFERED = """, offered as (select item_id, f.doc_id, row_number() over (partition by item_id order by f.score desc, f.doc_id) as place, <DIV:length(d.text)|4> + 1 as tokens
    from fused f join documents d on d.doc_id = f.doc_id)"""
PACK = (
    FUSED + OFFERED + f""", folded as (select item_id, aggregate(array_sort(collect_list(struct(place, doc_id, tokens))), named_struct('used', 0L, 'kept', cast(array() as array<struct<doc_id: bigint, used: bigint>>)),
        (s, x) -> case when s.used + x.tokens <= {BUDGET} then named_struct('used', cast(s.used + x.tokens as bigint), 'kept', concat(s.kept, array(named_struct('doc_id', x.doc_id, 'used', cast(s.used + x.tokens as bigint))))) else s end) as r
        from offered where place <= 24 group by item_id) select item_id, k.doc_id, k.used from (select item_id, explode(r.kept) as k from folded) x""",
    BM25.replace("with docs", "with recursive docs", 1) + FUSED + OFFERED + f""", walk(item_id, place, doc_id, took, used) as (select item_id, place, doc_id, tokens <= {BUDGET}, cast(case when tokens <= {BUDGET} then tokens else 0 end as bigint) from offered where place = 1
        union all select o.item_id, o.place, o.doc_id, w.used + o.tokens <= {BUDGET}, cast(case when w.used + o.tokens <= {BUDGET} then w.used + o.tokens else w.used end as bigint)
        from walk w join offered o on o.item_id = w.item_id and o.place = w.place + 1 where o.place <= 24) select item_id, doc_id, used from walk where took""",
)

#: Text vectors in SQL: of documents and of questions, over the same axes, from texts alone.
ORACLE_VECTORS = f""",
    kept as (select doc_id, lang, term, count(*) as tf from (select doc_id, lang, unnest(words) as term from docs) x group by doc_id, lang, term), known as (select term, count(*) as df from kept group by term),
    rated as (select 0 as side, doc_id as id, lang, k.term, tf, df from kept k join known n on k.term = n.term union all select 1, item_id, '', a.term, times, df from asked a join known n on a.term = n.term),
    summed as (select side, id, lang, {postings.AXIS[1]} as axis, sum(({postings.SIGN}) * (1 + ln(tf)) * ln(1 + w.n / cast(df as double))) as rate from rated cross join whole w group by all),
    filled as (select k.side, k.id, k.lang, list(coalesce(r.rate, 0.0) order by a.axis) as v from (select distinct side, id, lang from summed) k cross join (select unnest(range({postings.AXES})) as axis) a
        left join summed r on r.side = k.side and r.id = k.id and r.lang = k.lang and r.axis = a.axis group by all),
    unit as (select side, id, lang, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from filled where list_dot_product(v, v) > 0),
    near as (select q.id as item_id, d.id as doc_id, d.lang, round(list_dot_product(q.v, d.v), 6) as score from unit q join unit d on q.side = 1 and d.side = 0)"""


def best(lists: DataFrame, weighted: DataFrame, k: int = 24, scoped: bool = False, docs: int = 1024, questions: int = 256) -> DataFrame:
    """(item_id, doc_id, lang, score, n): of each question and language of documents at least the k documents of the largest BM25 score, to
    six digits, and the k with the most of its words (n), ties to the smaller doc_id; each once, with more beside them.

    lists: (doc_id, langs array, held array of (term long, tf, size)), a row a document; weighted: (item_id, term long, rate, mean), and lang
    if scoped: then these weights are for that language's documents only. Exact: blocks of documents are multiplied, as matrices over the
    words of a block of questions, with these, and each task keeps k rows for a question and language; there are no rows for pairs.
    """
    if not scoped:
        weighted = weighted.withColumn("lang", F.lit(None).cast("string"))
    known = sieve(weighted)  # of fixed size; the other words' postings go no further
    asked = weighted.groupBy("lang", F.expr(f"item_id div {questions}").alias("block")).agg(F.collect_list(F.struct("item_id", "term", "rate", "mean")).alias("asked"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), docs):
                part = batch.slice(at, docs)
                held = part.column(2)
                counts, flat = np.diff(held.offsets.to_numpy()), held.flatten()
                own = known[flat.field(0).to_numpy(zero_copy_only=False) & (SIEVE - 1)]
                values = [flat.field(i).to_numpy(zero_copy_only=False)[own] for i in range(3)]
                yield pa.RecordBatch.from_pydict({"ids": [part.column(0).to_numpy().tobytes()], "langs": [part.column(1).to_pylist()], "rows": [np.repeat(np.arange(len(part)), counts)[own].tobytes()],
                    "terms": [values[0].astype("<i8").tobytes()], "tfs": [values[1].astype("<f8").tobytes()], "sizes": [values[2].astype("<f8").tobytes()]}, packed_schema)

    packed_schema = pa.schema([("ids", pa.binary()), ("langs", pa.list_(pa.list_(pa.string()))), *((c, pa.binary()) for c in ("rows", "terms", "tfs", "sizes"))])

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, dict] = {}  # (scope, block, lang) -> item -> rows (doc_id, score, n)
        read: dict[tuple, tuple] = {}

        def matrices(row: pa.RecordBatch, name: tuple) -> tuple:
            if name not in read:
                flat = row.column("asked").flatten()
                item, term, rate, mean = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                items, at = np.unique(item, return_inverse=True)
                words, word = np.unique(term, return_inverse=True)
                rates, has = np.zeros((len(words), len(items))), np.zeros((len(words), len(items)), np.float32)
                rates[word, at], has[word, at] = rate, 1
                read[name] = items, words, rates, has, mean[0]
            return read[name]

        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                ids, rows, terms = (np.frombuffer(row.column(c)[0].as_py(), np.int64) for c in ("ids", "rows", "terms"))
                tfs, sizes = (np.frombuffer(row.column(c)[0].as_py(), np.float64) for c in ("tfs", "sizes"))
                scope = row.column("lang")[0].as_py()
                block = row.column("block")[0].as_py()
                items, words, rates, has, mean = matrices(row, (scope, block))
                place = np.minimum(np.searchsorted(words, terms), len(words) - 1)
                own = words[place] == terms
                left, there = np.zeros((len(ids), len(words))), np.zeros((len(ids), len(words)), np.float32)
                np.add.at(left, (rows[own], place[own]), tfs[own] * 2.2 / (tfs[own] + 1.2 * (0.25 + 0.75 * sizes[own] / mean)))
                np.add.at(there, (rows[own], place[own]), 1)
                score, n = np.round(left @ rates, 6), there @ has
                langs = row.column("langs")[0].as_py()
                for lang in {x for of in langs for x in of or [None]}:
                    if scoped and lang != scope:
                        continue
                    these = np.array([lang in (of or [None]) for of in langs])
                    old = kept.setdefault((scope, block, lang), {})
                    for j, item in enumerate(items.tolist()):
                        mine = np.flatnonzero(these & (n[:, j] > 0))
                        if item in old:
                            least = old[item][3]
                            mine = mine[(score[mine, j] >= least[0]) | (n[mine, j] >= least[1])]
                        if not len(mine):
                            continue
                        all_ = [ids[mine], score[mine, j], n[mine, j]]
                        if item in old:
                            all_ = [np.concatenate(x) for x in zip(old[item], all_)]
                        tops = [np.lexsort((all_[0], -all_[c]))[:k] for c in (1, 2)]
                        chosen = np.unique(np.concatenate(tops))
                        least = [all_[c][t[-1]] if len(t) == k else -np.inf for c, t in zip((1, 2), tops)]
                        old[item] = *(x[chosen] for x in all_), least
        for (_, _, lang), found in kept.items():
            for item, (doc, score, n, _) in found.items():
                yield pa.RecordBatch.from_pydict({"item_id": np.full(len(doc), item), "doc_id": doc, "lang": pa.array([lang] * len(doc), pa.string()), "score": score, "n": n.astype(np.int64)})

    packs = lists.select("doc_id", "langs", "held").mapInArrow(packed, "ids binary, langs array<array<string>>, rows binary, terms binary, tfs binary, sizes binary")
    return packs.crossJoin(F.broadcast(asked)).mapInArrow(multiplied, "item_id long, doc_id long, lang string, score double, n long")


TERM = "xxhash64(term)"
SIEVE = 1 << 20


def listed(lists: DataFrame, *by: str) -> DataFrame:
    """Lists of postings (doc_id, lang, held) as a row a document (and by), without a shuffle if they are dealt by doc_id."""
    return lists.groupBy("doc_id", *by).agg(F.collect_set("lang").alias("langs"), F.flatten(F.collect_list("held")).alias("held"))


def sieve(terms: DataFrame) -> np.ndarray:
    """SIEVE flags, set where one of the terms (long) ends in so many bits."""
    words = terms.groupBy(F.expr(f"pmod(term, {SIEVE}) div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(term, 64) as int)))").alias("bits")).collect()
    out = np.zeros(SIEVE // 64, np.int64)
    for at, bits in words:
        out[at] = bits
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def nearest(questions: DataFrame, vectors: DataFrame, k: int = 24, block: int = 1024, apart: bool = False) -> DataFrame:
    """(item_id, doc_id, score, place): of each question (item_id, vector) the k vectors (doc_id, vector) of the largest inner product, to
    six digits, ties to the smaller doc_id; apart: none is its own. The questions' blocks are broadcast. Exact: blocks of questions are multiplied with blocks of vectors, and a block pair gives k
    rows a question at most; there are as many block pairs as (questions / block) * (vectors / block). Restrict vectors to a scope first."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            for at in range(0, len(batch), block):
                ids = batch.column(0).to_numpy()[at : at + block]
                yield pa.RecordBatch.from_pydict({"ids": [ids.tobytes()], "values": [flat.reshape(len(batch), -1)[at : at + block].tobytes()]})

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                items, docs = (np.frombuffer(row[c], dtype=np.int64) for c in ("q_ids", "ids"))
                left, right = (np.frombuffer(row[c], dtype=np.float64).reshape(n, -1) for c, n in (("q_values", len(items)), ("values", len(docs))))
                score = np.round(left @ right.T, 6)
                if apart:
                    score[items[:, None] == docs] = -np.inf
                least = -np.partition(-score, k - 1, axis=1)[:, k - 1] if len(docs) > k else np.full(len(items), -np.inf)
                at, to = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                order = np.lexsort((docs[to], -score[at, to], at))
                at, to = at[order], to[order]
                nth = np.arange(len(at)) - np.searchsorted(at, at)
                at, to = at[nth < k], to[nth < k]
                yield pa.RecordBatch.from_pydict({"item_id": items[at], "doc_id": docs[to], "score": score[at, to]})

    schema = "ids binary, values binary"
    asked = questions.select("item_id", "vector").mapInArrow(packed, schema).withColumnsRenamed({"ids": "q_ids", "values": "q_values"})
    found = vectors.select("doc_id", "vector").mapInArrow(packed, schema).crossJoin(F.broadcast(asked)).mapInArrow(multiplied, "item_id long, doc_id long, score double")
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def dense_views(spark: SparkSession, sf_dir: str, scope: str, head: bool = False) -> None:
    """The documents' and questions' vectors of the index as dense(item_id, doc_id, score, place), within a scope (SQL over doc_id and lang)."""
    own = dialect(headed(FIRST, head), 0)
    rated(spark, sf_dir, own, dense=True, head=head)
    asked = spark.sql(own + postings.vectors_of("(select item_id, term, times as tf from asked)", "idx_terms", "idx_whole", "item_id").replace("select item_id,", " select item_id,", 1))
    nearest(asked, spark.table("idx_vectors").where(scope)).createOrReplaceTempView("dense")


def hybrid(scope: str, tail: str, head: bool = False) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """BM25 and vectors within a scope, fused by rank: the filter comes before both lanes are cut. Statistics are the collection's."""
    lanes = """,
        within as (select * from (select s.item_id, s.doc_id, row_number() over (partition by s.item_id order by s.score desc, s.doc_id) as place from {scored} where {scope}) x where place <= 24),
        lanes as (select item_id, doc_id, place, 1 as lexical, 0 as dense from within union all select item_id, doc_id, place, 0, 1 from {dense} d where place <= 24),
        fused as (select item_id, doc_id, round(sum(cast(1 as double) / (60 + cast(place as double))), 6) as score, max(lexical) as lexical, max(dense) as dense from lanes group by item_id, doc_id)"""
    own = dialect(headed(FIRST, head), 0) + lanes.format(scored="(select s.*, p.lang from scored s join (select doc_id, lang from idx_vectors) p on p.doc_id = s.doc_id) s", scope=scope, dense="dense") + tail

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        dense_views(spark, sf_dir, scope, head)
        return spark.sql(own)

    found = f"(select item_id, doc_id, row_number() over (partition by item_id order by score desc, doc_id) as place from near where {scope})"
    return run, headed(BM25, head) + ORACLE_VECTORS + lanes.format(scored="(select s.*, p.lang from scored s join (select id as doc_id, lang from unit where side = 0) p on p.doc_id = s.doc_id) s", scope=scope, dense=found) + tail


TOP = " select item_id, doc_id, score, lexical, dense, place from (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from fused) x where place <= 6"

HYBRID = FUSED + " select item_id, doc_id, score, place from (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from fused) x where place <= 6"

#: A second search for what the first six documents of a question lack: at most six of its words that none of them has, the rarest first;
#: the best three other documents by these words alone. {terms}: (item_id, term, rate, df); {held}: (doc_id, term); {weight}: of a posting.
COMPLEMENT = """,
    first as (select item_id, doc_id, place from (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from fused) x where place <= 6),
    had as (select distinct f.item_id, p.term from first f join {held} p on p.doc_id = f.doc_id),
    gaps as (select * from (select t.*, row_number() over (partition by t.item_id order by t.df, t.term) as nth from {terms} t left anti join had h on h.item_id = t.item_id and h.term = t.term) x where nth <= 6),
    offers as (select g.item_id, p.doc_id, round(sum({weight}), 6) as score, count(*) as n_terms from {held} p join gaps g on g.term = p.term group by g.item_id, p.doc_id)
    select item_id, doc_id, score, n_terms, place from (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from offers) x where place <= 3"""
HAD = "select distinct f.item_id, p.term from first f join held p on p.doc_id = f.doc_id"
#: Of the words of the first documents only the question's own.
HAD_OWN = "select f.item_id, explode(array_intersect(q.terms, p.terms)) as term from first f join (select item_id, collect_set(term) as terms from asked group by item_id) q on q.item_id = f.item_id join idx_lists p on p.doc_id = f.doc_id"


def complementary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second search over the stored postings, as one more set of weighted words."""
    first, _, _ = (FUSED + COMPLEMENT.format(terms="(select w.*, t.df from weighted w join idx_terms t on t.term = w.term)", held="held", weight="0")).rpartition(",\n    offers as")
    own = dialect(headed(FIRST), 0) + first.replace(HAD, HAD_OWN)
    rated(spark, sf_dir, own, head=True)
    gaps = spark.table(postings.written(spark.sql(own + " select item_id, term, rate, mean from gaps"), "gaps"))
    offers = best(listed(spark.table("idx_lists")), gaps.withColumn("term", F.expr(TERM)), 3)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return offers.select("item_id", "doc_id", "score", F.col("n").alias("n_terms")).distinct().withColumn("place", F.row_number().over(order)).where("place <= 3")


COMPLEMENTARY = (
    complementary,
    headed(BM25) + FUSED + COMPLEMENT.format(
        terms="(select a.item_id, a.term, a.times * i.idf as rate, i.mean, i.df from asked a join (select i.*, c.df from idf i join (select term, count(*) as df from postings group by term) c on c.term = i.term) i on i.term = a.term)",
        held="postings", weight="g.rate * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.size / g.mean))",
    ),
)

def scoped_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 within each language, with its own statistics."""
    sql = dialect(ASKS + """, whole as (select d.lang, d.n, try_divide(cast(coalesce(t.total, 0) as double), d.n) as mean from (select lang, count(*) as n from documents group by lang) d left join (select lang, sum(total) as total from idx_lists group by lang) t on t.lang = d.lang),
        counts as (select p.lang, p.term, count(*) as df from idx_postings p left semi join asked a on a.term = p.term group by p.lang, p.term)
        select a.item_id, c.lang, a.term, w.mean, a.times * case when w.n > 2 * c.df then ln((w.n - c.df + 0.5) / (c.df + 0.5)) else 0.000001 end as rate from asked a join counts c on c.term = a.term join whole w on w.lang = c.lang""", 0)
    register(spark, sf_dir, sql)
    postings.of(spark, table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).views(spark)
    weighted = spark.table(postings.written(spark.sql(sql), "scoped"))
    found = best(listed(spark.table("idx_lists").where("lang is not null"), "lang"), weighted.withColumn("term", F.expr(TERM)), 6, scoped=True)
    order = Window.partitionBy("lang", "item_id").orderBy(F.col("score").desc(), "doc_id")
    return found.select("lang", "item_id", "doc_id", "score").withColumn("place", F.row_number().over(order)).where("place <= 6")


def weighted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over titles and bodies, words of a title twice. A document's words are counted where they lie."""
    words = dialect(headed(ASKS), 0)
    register(spark, sf_dir, words)
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", *(F.expr(dialect(f"<FOLDED:{part}>", 0)).alias(name) for name, part in (("title", "substr(text, 1, 40)"), ("body", "substr(text, 41)"))))
    asked = spark.sql(words + " select distinct term from asked")
    buckets = postings.dealt(docs.sparkSession.read.parquet(f"{sf_dir}/documents.parquet"))
    flat = docs.select("doc_id", F.lit("").alias("lang"), F.concat("title", "title", "body").alias("words"), (F.size("title") + F.size("body")).alias("size"))
    held = spark.table(postings.written(postings.counted(flat, buckets), "columns", buckets))
    spark.table(postings.written(held.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).selectExpr("n", "try_divide(cast(total as double), n) as mean"), "whole")).createOrReplaceTempView("columns_whole")
    held.select(F.explode("terms").alias("term")).join(F.broadcast(asked), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")).createOrReplaceTempView("columns_terms")
    weighted = spark.table(postings.written(spark.sql(dialect(headed(WEIGHTED).replace("idx_", "columns_"), 0) + " select * from weighted"), "weighted"))
    found = best(listed(held), weighted.withColumn("term", F.expr(TERM)))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return found.select("item_id", "doc_id", "score").distinct().withColumn("place", F.row_number().over(order)).where("place <= 24")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors of every one whose id is divisible by 50; what can't be multiplied has no score and comes last."""
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("doc_id"), F.expr("cast(embedding as array<double>)").alias("vector"))
    held = held.withColumn("size", F.when(F.coalesce(F.exists("vector", lambda x: x.isNull()), F.lit(True)), -1).otherwise(F.size("vector")))
    asked = held.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "item_id")
    sizes = [r["size"] for r in held.where("size > 0").groupBy("size").count().orderBy(F.col("count").desc()).limit(1).collect()] or [1]
    same = F.col("size") == sizes[0]
    near = nearest(asked.where(same), held.where(same), 10, apart=True).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("vec_id"), "score")
    others = held.where("doc_id is not null").withColumn("nth", F.dense_rank().over(Window.partitionBy(same).orderBy("doc_id"))).where("nth <= 11").select(F.col("doc_id").alias("vec_id"), same.alias("fits"))
    rest = asked.select(F.col("item_id").alias("query_id"), same.alias("fit")).crossJoin(F.broadcast(others)).where("query_id <> vec_id and not (fit and fits)").select("query_id", "vec_id", F.lit(None).cast("double").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.union(rest).withColumn("place", F.row_number().over(order)).where("place <= 10")


QUERIES = {
    "bm25_topk": both(" select item_id, doc_id, score, place from lexical"),
    "bm25_scoped_corpus": (scoped_corpus, ASKED
    + f""", whole as (select lang, count(*) as n, avg(<SIZE>(words)) as mean from docs group by lang),
        idf as (select p.lang, term, max(w.mean) as mean, case when max(w.n) > 2 * count(*) then ln((max(w.n) - count(*) + 0.5) / (count(*) + 0.5)) else 0.000001 end as idf from postings p join whole w on p.lang = w.lang group by p.lang, term),
        scored as (select p.lang, a.item_id, p.doc_id, round(sum({WEIGHT}), 6) as score from asked a join postings p on a.term = p.term join idf i on i.term = p.term and i.lang = p.lang group by p.lang, a.item_id, p.doc_id)
        select lang, item_id, doc_id, score, place from (select *, row_number() over (partition by lang, item_id order by score desc, doc_id) as place from scored) x where place <= 6"""),
    "bm25_weighted_columns": (weighted_columns, """with docs as (select doc_id, <FOLDED:substr(text, 1, 40)> as title, <FOLDED:substr(text, 41)> as body from documents where text is not null),
        asked as (select item_id, term, count(*) as times from (select item_id, <EX>(<HEAD:words|64>) as term from (select item_id, <FOLDED:text> as words from benchmark) q) x group by item_id, term),
        whole as (select count(*) as n, avg(<SIZE>(title) + <SIZE>(body)) as mean from docs),
        postings as (select p.doc_id, p.term, max(p.size) as size, sum(p.weight) as tf from (select doc_id, <SIZE>(title) + <SIZE>(body) as size, <EX>(title) as term, 2 as weight from docs
            union all select doc_id, <SIZE>(title) + <SIZE>(body), <EX>(body), 1 from docs) p left semi join (select distinct term from asked) w on p.term = w.term group by p.doc_id, p.term),
        idf as (select term, max(w.mean) as mean, case when max(w.n) > 2 * count(*) then ln((max(w.n) - count(*) + 0.5) / (count(*) + 0.5)) else 0.000001 end as idf from postings cross join whole w group by term)
        select item_id, doc_id, score, place from (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from
        (select a.item_id, p.doc_id, round(sum("""
    + WEIGHT
    + """), 6) as score from asked a join postings p on a.term = p.term join idf i on i.term = p.term group by a.item_id, p.doc_id) y) x where place <= 24"""),
    "rrf_fusion": both(FUSED + " select item_id, doc_id, score from fused"),
    "q_hybrid_search": hybrid("true", TOP.replace("lexical, dense, ", "")),
    "complementary_search": COMPLEMENTARY,
    "hybrid_dense": hybrid("true", TOP, head=True),
    "hybrid_dense_scoped": hybrid("lang in ('en', 'de')", TOP),
    "final_dedup_cap": both(FUSED + """ select item_id, doc_id, score, place from (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from
        (select f.*, row_number() over (partition by f.item_id, d.digest order by f.score desc, f.doc_id) as copy from fused f join (select doc_id, <SHA> as digest from documents) d on d.doc_id = f.doc_id) x where copy = 1) y where place <= 6""", head=True),
    "mrr_at_10": both(CONTAINED[0] + MRR, CONTAINED[1] + MRR),
    "recall_at_k": both(CONTAINED[0] + RECALL, CONTAINED[1] + RECALL),
    "context_pack": (indexed(PACK[0], head=True), headed(PACK[1])),
    "comparison_round_robin": (
        indexed(""", sized as (select place, item_id div 1024 as bin, count(*) as n from lexical where place <= 3 group by place, item_id div 1024),
            starts as (select place, bin, sum(n) over (order by place, bin) - n as before from sized)
            select l.doc_id, l.item_id, l.place, s.before + row_number() over (partition by l.place, l.item_id div 1024 order by l.item_id, l.doc_id) as turn
            from lexical l join starts s on s.place = l.place and s.bin = l.item_id div 1024"""),
        BM25 + " select doc_id, item_id, place, row_number() over (order by place, item_id, doc_id) as turn from lexical where place <= 3",
    ),
    "scope_isolation": both(""" select l.item_id, count(*) as kept_after, min(o.n) as kept_before from (select s.item_id, d.lang, s.place from lexical s join documents d on d.doc_id = s.doc_id where d.lang = 'en') l
        join (select item_id, least(count(*), 24) as n from scored s join documents d on d.doc_id = s.doc_id where d.lang = 'en' group by item_id) o on o.item_id = l.item_id group by l.item_id"""),
    "dense_topk": (dense_topk, """select query_id, vec_id, score, place from (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from
        (select a.vec_id as query_id, b.vec_id, round(<DOT>, 6) as score from (select vec_id, <VEC> as v from embeddings where vec_id % 50 = 0) a
        join (select vec_id, <VEC> as v from embeddings) b on a.vec_id <> b.vec_id) x) y where place <= 10"""),
}
