"""Evidence and its proof: rows that cover a question, what governs a block, where an excerpt stands, what supports a claim.

Each operator works on all questions at once and never gathers a document or a question in one task.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.functions import dialect, flagged, flags
from fathom.functions.arrow import FORMS
from fathom.functions.words import STOPWORDS
from fathom.operators import prose, retrieval
from fathom.sources import postings, table

MOST_ROWS = 12
CHUNK = 10_000
SEED = 5
FUZZY = 0.8
BEGINS = 1 << 17


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{postings.folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def term_keys(text: str) -> Column:
    """array: the first five letters of the words of three or more that carry content."""
    words = F.expr(dialect(f"<FOLDED:coalesce({text}, '')>", 0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS)), lambda w: F.substring(w, 1, 5)))


def cover(matches: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """(question, row, step, gain) of a greedy cover of each question's terms by rows: matches (question, row, term), each once.

    The rows with the most terms come first, all that tie; then, again and again, those with the most terms that are still uncovered,
    and of these those with the most terms in all, all that tie. A question that would take more than ``most`` rows gets none. A round is one
    aggregation over what is still uncovered, for all questions; a round adds a row, so there are at most ``most`` rounds.
    """
    scores = matches.groupBy("question", "row").agg(F.count("*").alias("score"))
    left = kept(matches.join(scores, ["question", "row"]), "cover-left")
    taken = kept(left.select("question", "row", F.lit(0).alias("step"), F.lit(0).cast("long").alias("gain")).limit(0), "cover-taken")
    for step in range(1, most + 2):
        gains = left.groupBy("question", "row").agg(F.count("*").alias("gain"), F.first("score").alias("score"))
        best = gains.groupBy("question").agg(F.max(F.struct("gain", "score")).alias("best"))
        tied = gains.join(best, "question").where("struct(gain, score) = best").select("question", "row", F.lit(step).alias("step"), "gain")
        taken = kept(taken.union(tied), "cover-taken")
        over = taken.groupBy("question").count().where(F.col("count") > most).select("question")
        covered = left.join(taken.where(F.col("step") == step).select("question", "row"), ["question", "row"], "left_semi").select("question", "term").distinct()
        left = kept(left.join(covered, ["question", "term"], "left_anti").join(over, "question", "left_anti"), "cover-left")
        if left.isEmpty():
            break
    return taken.join(taken.groupBy("question").count().where(F.col("count") > most).select("question"), "question", "left_anti")


def focused_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the lines of the first six documents of each benchmark passage, those that cover the passage's terms."""
    first = retrieval.QUERIES["q_hybrid_search"][0](spark, sf_dir).select("item_id", "doc_id")
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.explode(term_keys("text")).alias("term"))
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text").join(first, "doc_id")
    lines = docs.select("item_id", "doc_id", F.expr("posexplode(split(text, '\\n')) as (pos, line)"))
    terms = lines.select("item_id", F.struct("doc_id", "pos").alias("row"), F.explode(term_keys("line")).alias("term")).join(asked, ["item_id", "term"]).distinct()
    got = cover(terms.withColumnRenamed("item_id", "question"))
    return got.select(F.col("question").alias("item_id"), "row.doc_id", F.col("row.pos").cast("long").alias("pos"), F.col("step").cast("long").alias("step"), "gain")


def last_before(rows: DataFrame, scope: str, order: str, what: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """rows with column name: the last value of what (not null) at or before the row, by order (long, from 0) within its scope.

    An as-of join that a scope of any length survives: within chunks of ``chunk`` places by a window, then the last value of each chunk is
    carried over the chunks, of which there are ``chunk`` times fewer, and joined to the rows that have none in their own."""
    marked = rows.withColumns({"_what": what, "_chunk": F.floor(F.col(order) / chunk)})
    own = F.last("_what", True).over(Window.partitionBy(scope, "_chunk").orderBy(order))
    ends = marked.groupBy(scope, "_chunk").agg(F.max_by("_what", F.when(F.col("_what").isNotNull(), F.col(order))).alias("_end"))
    carried = ends.select(scope, "_chunk", F.last("_end", True).over(Window.partitionBy(scope).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    both = marked.withColumn("_own", own).join(carried.where("_carried is not null"), [scope, "_chunk"], "left")
    return both.select(*rows.columns, F.coalesce("_own", "_carried").alias(name))


#: A line that names what follows: short, not blank, without a mark at its end. A line that states a condition for what follows.
HEADING = "length(trim(line)) between 1 and 60 and not trim(line) rlike '[.!?,;:|]$'"
CONDITION = "line rlike '^(Released under|Licensed|Copyright|Version|This work)'"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, pos, line): lines of documents, and titles and paragraphs of pages in order."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("scope"), F.expr("posexplode(split(text, '\\n')) as (pos, line)"))
    parts = r"regexp_extract_all(html, '(?s)<(?:h1|p)>(.*?)(?:</p>|</h1>|(?=<p>))', 1)"
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("scope"), F.expr(f"posexplode({parts}) as (pos, line)"))
    return docs.union(pages).withColumn("pos", F.col("pos").cast("long"))


def subject_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block with the heading and the condition that govern it: the last ones at or before it in its document or page."""
    bound = last_before(blocks(spark, sf_dir), "scope", "pos", F.expr(f"if({HEADING}, pos, null)"), "heading")
    return last_before(bound, "scope", "pos", F.expr(f"if({CONDITION}, pos, null)"), "condition").select("scope", "pos", "heading", "condition")


SUBJECT_BINDING = r"""with lines as (select 'd' || doc_id as scope, generate_subscripts(ls, 1) - 1 as pos, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null) x
        union all select 'p' || page_id, generate_subscripts(ls, 1) - 1, unnest(ls) from (select page_id, regexp_extract_all(replace(html, '<p>', chr(1) || '<p>'), '(?s)<(?:h1|p)>([^' || chr(1) || ']*?)(?:</p>|</h1>|' || chr(1) || ')', 1) as ls from pages) y),
    marked as (select *, case when length(trim(line)) between 1 and 60 and not regexp_matches(trim(line), '[.!?,;:|]$') then pos end as h, case when regexp_matches(line, '^(Released under|Licensed|Copyright|Version|This work)') then pos end as c from lines)
    select scope, pos, max(h) over w as heading, max(c) over w as condition from marked window w as (partition by scope order by pos)"""


def words_of(text: str) -> Column:
    return F.expr(dialect(f"<WORDS:coalesce({text}, '')>", 0))


def shingled(rows: DataFrame, key: str, n: int = SEED) -> DataFrame:
    """(key, at, seed) of rows (key, words): the runs of n words, with their places."""
    runs = F.expr(f"transform(if(size(words) < {n}, array(), sequence(1, size(words) - {n - 1})), i -> struct(i - 1 as at, xxhash64(array_join(slice(words, i, {n}), ' ')) as seed))")
    return rows.select(key, F.explode(runs).alias("s")).select(key, F.col("s.at").cast("long").alias("at"), "s.seed")


def located(excerpts: DataFrame, docs: DataFrame, n: int = SEED, least: float = FUZZY) -> DataFrame:
    """(item_id, doc_id, start_word, end_word, distance, similarity, status): where documents (doc_id, text) have an excerpt (item_id, text).

    Seed and extend: runs of n words that both have vote for a diagonal, the place in the document less that in the excerpt; the diagonals of a
    document within a quarter of the excerpt's length are one candidate, and the words from its first to its last seed, with what the
    excerpt has before and behind, are compared with the excerpt by edit distance of letters. EXACT: no edit; FUZZY: 1 - distance / length
    is at least ``least``. The best place of each document counts, ties to the earliest. An excerpt that differs in every run of n words isn't found.
    """
    left = excerpts.select("item_id", words_of("text").alias("words")).where("size(words) > 0")
    right = docs.where("text is not null").select("doc_id", F.monotonically_increasing_id().alias("row"), words_of("text").alias("words"))
    seeds = shingled(left, "item_id", n)
    found = shingled(right.select(F.struct("doc_id", "row").alias("place"), "words"), "place", n).join(seeds.select("seed").distinct(), "seed", "left_semi")
    hits = found.join(seeds.select("item_id", "seed", F.col("at").alias("own")), "seed").select("item_id", "place", (F.col("at") - F.col("own")).alias("diagonal"), "own")
    sized = hits.join(left.select("item_id", F.size("words").alias("size")), "item_id")
    band = sized.groupBy("item_id", "place", F.floor(F.col("diagonal") / F.greatest(F.lit(1), F.floor(F.col("size") / 4))).alias("band"), "size").agg(F.count("*").alias("votes"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    # neighbouring bands may share a place: each band looks as far as the excerpt's length allows
    best = band.groupBy("item_id", "place", "size").agg(F.max(F.struct("votes", F.negative("low").alias("early"), "high")).alias("b"))
    spots = best.select("item_id", "place.doc_id", "place.row", "size", F.greatest(F.lit(0), -F.col("b.early")).alias("start"), (F.col("b.high") + F.col("size")).alias("end"))
    texts = spots.join(right.select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), F.col("words").alias("theirs")), (F.col("row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    both = texts.join(left, "item_id").select("item_id", "doc_id", F.col("start").cast("long").alias("start_word"), F.least("end", F.size("theirs").cast("long")).alias("end_word"), F.array_join("words", " ").alias("own"), "theirs")
    seen = both.withColumn("window", F.expr("array_join(slice(theirs, cast(start_word as int) + 1, cast(end_word - start_word as int)), ' ')"))
    near = seen.withColumn("distance", F.levenshtein("own", "window").cast("long")).withColumn("similarity", F.round(1 - F.col("distance") / F.greatest(F.length("own"), F.length("window")), 6))
    told = near.where(F.col("similarity") >= least).withColumn("status", F.when(F.col("distance") == 0, "EXACT").otherwise("FUZZY"))
    one = Window.partitionBy("item_id", "doc_id").orderBy("distance", "start_word", "end_word")
    return told.withColumn("_n", F.row_number().over(one)).where("_n = 1").select("item_id", "doc_id", "start_word", "end_word", "distance", "similarity", "status")


#: Every tenth word of an excerpt is another one.
EDITED = "array_join(transform(words, (w, i) -> if(i % 10 = 6, 'zz', w)), ' ')"


def excerpt_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as it stands, and with each tenth word replaced (ids from 1,000,000 on), in all documents."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text", words_of("text").alias("words"))
    both = items.select("item_id", "text").union(items.select(F.col("item_id") + 1_000_000, F.expr(EDITED)))
    return located(both, table(spark, sf_dir, "documents").select("doc_id", "text"))


def support_ledger(claims: DataFrame, sources: DataFrame, n: int = SEED) -> DataFrame:
    """(item_id, place, n_words, doc_id, covered, n_spans, status): each claim (item_id, place, text) with the source (doc_id, text) that
    covers most of its words by literal runs of n words or more (a shorter claim: by the whole), ties to the smaller doc_id.

    Runs that claim and source share are intervals of the claim; intervals that touch are one span. supported: every word is covered;
    partial: some are; unsupported: no source has a run of it.
    """
    said = claims.select(F.struct("item_id", "place").alias("claim"), words_of("text").alias("words")).where("size(words) > 0")
    size = F.least(F.lit(n), F.size("words"))
    runs = said.select("claim", F.size("words").alias("n_words"), size.alias("k"), F.expr(f"posexplode(transform(sequence(1, size(words) - least({n}, size(words)) + 1), i -> array_join(slice(words, i, least({n}, size(words))), ' '))) as (at, run)"))
    held = sources.where("text is not null").select("doc_id", words_of("text").alias("words"))
    lengths = F.expr(f"filter(sequence(1, {n}), k -> k <= size(words))")
    asked = runs.select("k").distinct()  # n lengths at most
    # a source's run is written out only if its first two words, or its one, begin a claim's run of that length
    known = f"claim_runs_{uuid.uuid4().hex}"
    runs.selectExpr("k", "split(run, ' ') as w").selectExpr("if(k = 1, xxhash64(k, w[0]), xxhash64(k, w[0], w[1])) as h").createOrReplaceTempView(known)
    begins = claims.sparkSession.sql(flags(f"select h from {known}", BEGINS))
    begun = flagged("if(k = 1, xxhash64(k, words[i - 1]), xxhash64(k, words[i - 1], get(words, i)))", BEGINS)
    theirs = held.select("doc_id", "words", F.explode(lengths).alias("k")).join(asked, "k", "left_semi").crossJoin(F.broadcast(begins))
    theirs = theirs.select("doc_id", F.expr(f"explode(transform(filter(sequence(1, size(words) - k + 1), i -> {begun}), i -> array_join(slice(words, i, k), ' ')))").alias("run"))
    pairs = theirs.join(runs.select("run").distinct(), "run", "left_semi").distinct().join(runs, "run")
    spans = pairs.groupBy("claim", "doc_id", "n_words", "k").agg(F.sort_array(F.collect_set("at")).alias("at"))
    covered = F.expr("aggregate(at, named_struct('end', 0, 'n', 0, 'spans', 0), (s, x) -> named_struct('end', x + k, 'n', s.n + x + k - greatest(s.end, x), 'spans', s.spans + if(x > s.end or s.spans = 0, 1, 0)))")
    told = spans.select("claim", "doc_id", covered.alias("c")).groupBy("claim").agg(F.max(F.struct(F.col("c.n").alias("n"), F.negative("doc_id").alias("d"), F.col("c.spans").alias("spans"))).alias("b"))
    full = said.select("claim", F.size("words").alias("n_words")).join(told, "claim", "left")
    status = F.when(F.col("b").isNull(), "unsupported").when(F.col("b.n") == F.col("n_words"), "supported").otherwise("partial")
    return full.select("claim.item_id", "claim.place", F.col("n_words").cast("long").alias("n_words"), (-F.col("b.d")).alias("doc_id"), F.coalesce("b.n", F.lit(0)).cast("long").alias("covered"), F.coalesce("b.spans", F.lit(0)).cast("long").alias("n_spans"), status.alias("status"))


def claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every benchmark passage as claims, with all documents as sources."""
    claims = prose.sentences(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")).select(F.col("doc_id").alias("item_id"), "place", F.col("sentence").alias("text"))
    return support_ledger(claims, table(spark, sf_dir, "documents").select("doc_id", "text"))


CLAIM_SUPPORT = (
    prose.SENTENCES.replace("documents", "benchmark").replace("doc_id", "item_id").replace("sha256(s) as digest", "s").replace("with cut", "with cut", 1).rpartition("select item_id, row_number()")[0]
    + r""", claims as (select item_id, row_number() over (partition by item_id order by pos) - 1 as place, <WORDS:s> as words from placed where s <> ''),
    said as (select *, least(5, len(words)) as k from claims where len(words) > 0), sources as (select doc_id, ' ' || array_to_string(<WORDS:text>, ' ') || ' ' as flat from documents where text is not null),
    runs as (select item_id, place, unnest(range(0, len(words) - k + 1)) as i, words, k from said), texts as (select item_id, place, i, k, array_to_string(words[i + 1 : i + k], ' ') as run from runs),
    hits as (select t.item_id, t.place, s.doc_id, t.i, t.k from texts t join sources s on contains(s.flat, ' ' || t.run || ' ')),
    wide as (select distinct item_id, place, doc_id, unnest(range(i, i + k)) as w from hits),
    counted as (select item_id, place, doc_id, count(*) as n, count(*) filter (w <> before + 1 or before is null) as spans from (select *, lag(w) over (partition by item_id, place, doc_id order by w) as before from wide) x group by all),
    best as (select * from (select *, row_number() over (partition by item_id, place order by n desc, doc_id) as r from counted) y where r = 1)
    select s.item_id, s.place, len(s.words) as n_words, b.doc_id, coalesce(b.n, 0) as covered, coalesce(b.spans, 0) as n_spans, case when b.n is null then 'unsupported' when b.n = len(s.words) then 'supported' else 'partial' end as status
    from said s left join best b on b.item_id = s.item_id and b.place = s.place"""
)

#: Words that tie a sentence to the one before.
CONTINUES = "^(It|This|That|These|Those|However|But|Unless|Except|Otherwise|And|Elle|Il|Ce|Cette|Ces|Toutefois|Mais|Sauf|Et|Es|Dies|Aber|Und|Pero|Y|Este|Esta)[ ,]"


def proof_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence that stands for itself, as far as the sentences that depend on it reach."""
    said = prose.sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    alone = (~F.col("sentence").rlike(CONTINUES)) | (F.col("place") == 0)
    group = F.sum(alone.cast("long")).over(Window.partitionBy("row").orderBy("place"))
    got = said.withColumn("g", group).groupBy("doc_id", "row", "g").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"), F.count("*").alias("n_sentences"))
    return got.select("doc_id", "start_at", "end_at", "n_sentences")


PROOF_ENVELOPE = (
    prose.SENTENCES.replace("sha256(s) as digest", "s").replace("select doc_id, row_number()", ", said as (select doc_id, row_number()", 1)
    + rf""")
    select doc_id, min(start_at) as start_at, max(end_at) as end_at, count(*) as n_sentences from (select *, sum((place = 0 or not regexp_matches(s, '{CONTINUES}'))::int) over (partition by doc_id order by place) as g from said) x group by doc_id, g"""
)

QUOTAS = {"identifier": 20, "out_of_scope": 10, "no_answer": 10, "passage": 40}
CODE = "|".join(r"(?<!\w[-_/])" + form for form in FORMS)


def drawn(key: str, seed: int) -> Column:
    """The place of a row in a draw: a hash of its key and the seed, so that reruns agree whatever the partitions."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)


def question_set(docs: DataFrame, seed: int = 20260930, quotas: dict[str, int] | None = None) -> DataFrame:
    """(category, place, question, scope, expected, split): questions for an evaluation, drawn from documents (doc_id, text).

    identifier: codes of four characters or more with a letter and a digit that stand in one document only, asked there. out_of_scope: the
    same codes, asked in another document. no_answer: codes with one digit changed that no document has, asked of all; that none has them is
    an anti-join with all codes. passage: sentences of eight words or more that stand in one document only. Each category is
    filled up to its quota in the order of a seeded hash, with other codes for each. split: documents are held out by a hash, half of them.
    """
    quotas = QUOTAS if quotas is None else quotas
    # codes without a digit are neither asked nor stand for one that is
    codes = docs.where(F.col("text").rlike(prose.DIGIT)).select("doc_id", F.explode(F.expr(f"array_distinct(transform(regexp_extract_all(text, {prose.quoted(CODE)}, 0), x -> upper(x)))")).alias("code"))
    known = codes.groupBy("code").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"))
    single = known.where("doc_id = last and length(code) >= 4 and code rlike '[A-Z]' and code rlike '[0-9]'").select("code", "doc_id")

    # codes are dealt to the categories by their hash
    share = single.withColumn("category", F.expr("element_at(array('identifier', 'out_of_scope', 'no_answer'), cast(pmod(xxhash64(code), 3) + 1 as int))"))
    digit = F.expr("length(code) - length(regexp_extract(code, '([0-9])[^0-9]*$', 0)) + 1")
    step = lambda i: F.expr(f"overlay(code placing cast((cast(substring(code, at, 1) as int) + {i}) % 10 as string) from at for 1)")
    turned = share.where("category = 'no_answer'").withColumn("at", digit).select("code", "doc_id", F.posexplode(F.array(*(step(i) for i in range(1, 10)))).alias("step", "other"))
    absent = turned.join(known.select(F.col("code").alias("other")), "other", "left_anti").groupBy("code").agg(F.min_by(F.struct("other", "doc_id"), "step").alias("o"))
    ids = docs.groupBy().agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    elsewhere = share.where("category = 'out_of_scope'").crossJoin(ids).where("low < high").withColumn("scope", F.expr("if(doc_id = high, low, high)"))
    said = prose.sentences(docs).select("doc_id", F.col("sentence").alias("code")).where("size(split(code, ' ')) >= 8")
    alone = said.groupBy("code").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")).where("doc_id = last")
    scope = lambda c: F.col(c).cast("string")
    pools = {
        "identifier": share.where("category = 'identifier'").select("code", "doc_id", scope("doc_id").alias("scope"), F.col("doc_id").alias("expected")),
        "out_of_scope": elsewhere.select("code", "doc_id", scope("scope").alias("scope"), F.lit(None).cast("long").alias("expected")),
        "no_answer": absent.select(F.col("o.other").alias("code"), "o.doc_id", F.lit("library").alias("scope"), F.lit(None).cast("long").alias("expected")),
        "passage": alone.select("code", "doc_id", F.lit("library").alias("scope"), F.col("doc_id").alias("expected")),
    }
    # each task keeps the first ones of its rows, so no category is sorted whole
    first = lambda c, rows: rows.select(F.lit(c).alias("category"), "*", drawn("code", seed).alias("draw")).orderBy("draw", "code").limit(quotas.get(c, 0))
    pool = reduce(DataFrame.union, (first(c, rows) for c, rows in pools.items()))
    chosen = pool.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy("draw", "code")))
    held = F.when(F.substring(F.sha2(scope("doc_id"), 256), 1, 1) < "8", "holdout").otherwise("development")
    return chosen.select("category", F.col("place").cast("long").alias("place"), F.col("code").alias("question"), "scope", "expected", held.alias("split"))


def question_set_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation set of all documents."""
    return question_set(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "focused_rows": (focused_rows, None),
    "subject_binding": (subject_binding, SUBJECT_BINDING),
    "excerpt_locate": (excerpt_locate, None),
    "claim_support": (claim_support, CLAIM_SUPPORT),
    "question_set_build": (question_set_build, None),
    "proof_envelope": (proof_envelope, PROOF_ENVELOPE),
}
