"""Blocks, sections, chunks, cells, revisions and pages of the corpus.

A block is a line of a text. A block that holds at most 60 characters and doesn't end in a full stop is a heading; other
blocks inherit the last heading before them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import arrow
from fathom.sources import table

SECTIONS = """with blocks as (<BLOCKS>),
    marked as (select doc_id, pos, line, length(line) between 1 and 60 and line not like '%.' as heading from blocks),
    sections as (select doc_id, pos, line, heading, <LASTSET:case when heading then pos end> over (partition by doc_id order by pos rows between unbounded preceding and current row) as section from marked)"""


#: Boxes in whole units and cents, ten units wide and a hundred high; equal ones are a class.
BOXES = "with boxes as (select p_partkey as id, p_brand, cast(p_size as bigint) as x, cast(round(p_retailprice * 100) as bigint) as y from part)"
WIDE, HIGH = 10, 10000


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of every text in normal form with their first place; a text without any gives no row."""
    found = arrow.bounded(table(spark, sf_dir, "documents")).select("doc_id", F.explode(arrow.identifiers("text")).alias("i"))
    return found.groupBy("doc_id", F.col("i.code").alias("code")).agg(F.count("*").alias("n"), F.min("i.start").alias("first_start"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every text by the packing rule, with offsets in the text and a digest."""
    docs = arrow.bounded(table(spark, sf_dir, "documents")).where("text is not null")
    got = docs.select("doc_id", "text", F.posexplode(arrow.chunks("text")).alias("chunk", "c"))
    part = F.expr("substring(text, c.start + 1, c.end - c.start)")
    return got.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.sha2(part, 256).alias("digest"))


#: Letters of a column: digits of a number to base 26 without a zero; 14 of them hold any long.
LETTERS = "aggregate(sequence(1, 14), named_struct('n', cast({} as bigint), 's', ''), (a, i) -> if(a.n > 0, named_struct('n', (a.n - 1) div 26, 's', concat(chr(65 + (a.n - 1) % 26), a.s)), a), a -> a.s)"

QUERIES = {
    "scope_section": SECTIONS + " select doc_id, section, count(*) as n_blocks, cast(sum(length(line)) as bigint) as n_chars from sections where section is not null group by doc_id, section",
    "section_stitch": SECTIONS + " select doc_id, pos, section, heading, case when heading and line = lag(line) over (partition by doc_id order by pos) then true else false end as repeated_header from sections",
    "ordered_distinct": "with blocks as (<BLOCKS>) select doc_id, first_pos, row_number() over (partition by doc_id order by first_pos) as place, digest from (select doc_id, <HASH:line> as digest, min(pos) as first_pos from blocks group by doc_id, line) x",
    "block_offsets": "with blocks as (<BLOCKS>) select doc_id, pos, cast(sum(length(line) + 1) over (partition by doc_id order by pos rows unbounded preceding) - length(line) - 1 as bigint) as start_at, length(line) as n_chars from blocks",
    "sentence_spans": (
        r"""select doc_id, count(*) as n_sentences, max(length(s)) as longest from (select doc_id, trim(s) as s from documents lateral view explode(split(text, r'\n+|(?<=[.!?])\s+(?=[A-ZÀ-Þ])')) t as s) x where s <> '' group by doc_id""",
        r"""select doc_id, count(*) as n_sentences, max(length(s)) as longest from (select doc_id, trim(unnest(string_split_regex(regexp_replace(text, '([.!?])\s+([A-ZÀ-Þ])', E'\\1\n\\2', 'g'), '\n+'))) as s from documents) x where s <> '' group by doc_id""",
    ),
    "markdown_strip": (
        r"""select page_id, length(plain) as n_chars, sha2(plain, 256) as digest from (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, r'(?s)<!--.*?-->', ' '), r'(?s)<(script|style)[^>]*>.*?</(script|style)>', ' '), r'(?s)<[^>]*>', ' ')) as plain from pages) x""",
        r"""select page_id, length(plain) as n_chars, sha256(plain) as digest from (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')) as plain from pages) x""",
    ),
    "page_class": """select doc_id, n_chars, case when n_chars = 0 then 'blank' when letters / cast(n_chars as double) < 0.5 then 'degraded' when n_chars < 80 then 'mixed' else 'native' end as class,
        case when n_chars = 0 then null else round(letters / cast(n_chars as double), 6) end as coverage
        from (select doc_id, length(text) as n_chars, length(text) - length(regexp_replace(text, '[a-zA-Z0-9]', ''<GLOBAL>)) as letters from documents where text is not null) x""",
    "partial_scope": "select d.source, d.lang, count(*) as n, count(l.doc_id) as n_ready, case when count(l.doc_id) = 0 then 'not_indexed' when count(l.doc_id) < count(*) then 'partial' else 'ready' end as state from documents d left join labels l on l.doc_id = d.doc_id group by d.source, d.lang",
    "dense_coverage": "select d.lang, count(*) as n_documents, count(v.vec_id) as n_points, case when count(v.vec_id) = count(*) then 'complete' when count(v.vec_id) = 0 then 'unverifiable' else 'dense_migration_incomplete' end as state from documents d left join embeddings v on v.vec_id = d.doc_id group by d.lang",
    "extraction_progress": "select l_orderkey, count(distinct l_linenumber) as covered, max(l_linenumber) as pages, round(count(distinct l_linenumber) / cast(max(l_linenumber) as double), 6) as progress from lineitem group by l_orderkey",
    "small_range_bundle": (
        f"select l_orderkey, concat_ws('; ', transform(array_sort(collect_list(struct(l_linenumber, l_partkey))), x -> concat({LETTERS.format('x.l_linenumber')}, cast(x.l_partkey as string)))) as cells from (select distinct l_orderkey, l_linenumber, l_partkey from lineitem) d group by l_orderkey",
        "with recursive letters(n, rest, name) as (select n, n, '' from (select distinct l_linenumber as n from lineitem) t union all select n, (rest - 1) // 26, chr(65 + cast((rest - 1) % 26 as int)) || name from letters where rest > 0) select l_orderkey, string_agg(name || cast(l_partkey as varchar), '; ' order by l_linenumber, l_partkey) as cells from (select distinct l_orderkey, l_linenumber, l_partkey from lineitem) d join letters on n = l_linenumber and rest = 0 group by l_orderkey",
    ),
    "cell_address": (
        f"""select p_partkey, address, aggregate(split(regexp_extract(address, '^([A-Z]+)', 1), ''), 0L, (s, c) -> case when c = '' then s else s * 26 + ascii(c) - 64 end) as col, cast(regexp_extract(address, '([0-9]+)$', 1) as bigint) as row_at from (
            select p_partkey, concat({LETTERS.format('p_partkey')}, cast(p_size as string)) as address from part) x""",
        """with recursive letters(p_partkey, rest, name) as (select p_partkey, p_partkey, '' from part union all select p_partkey, (rest - 1) // 26, chr(65 + cast((rest - 1) % 26 as int)) || name from letters where rest > 0)
            select p.p_partkey, name || cast(p_size as varchar) as address, p.p_partkey as col, cast(p_size as bigint) as row_at from part p join letters l on l.p_partkey = p.p_partkey and l.rest = 0""",
    ),
    "cell_dates": (
        "select p_partkey, case when p_partkey = 60 then null when p_partkey < 60 then date_add(date'1899-12-31', cast(p_partkey as int)) else date_add(date'1899-12-30', cast(p_partkey as int)) end as day_1900, date_add(date'1904-01-01', cast(p_partkey as int)) as day_1904 from part",
        "select p_partkey, case when p_partkey = 60 then null when p_partkey < 60 then date '1899-12-31' + cast(p_partkey as integer) else date '1899-12-30' + cast(p_partkey as integer) end as day_1900, date '1904-01-01' + cast(p_partkey as integer) as day_1904 from part",
    ),
    "stable_ids": (
        "select doc_id, lower(concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab', 1 + cast(conv(substr(h, 17, 1), 16, 10) as int) % 4, 1), substr(h, 18, 3), '-', substr(h, 21, 12))) as id from (select doc_id, sha1(concat(unhex('6ba7b8119dad11d180b400c04fd430c8'), encode(sha2(text, 256), 'UTF-8'))) as h from documents where text is not null) x",
        None,
    ),
    "hash_recovery": """with lines as (select doc_id, pos, length(line) as n, <HASH:line> as digest from (<BLOCKS>) b where line <> ''), known as (select distinct n, digest from lines x left semi join labels l on l.doc_id = x.doc_id)
        select x.doc_id, x.pos from lines x join known k on x.n = k.n and x.digest = k.digest left anti join labels l on l.doc_id = x.doc_id""",
    # Of each box, its class (the smallest id of an equal box), how many other boxes of its brand it overlaps, and the sum of what it
    # shares with them. Each class counts at every x that it reaches; along y, running sums at three places of a class give all.
    "box_overlap": (
        BOXES + f""", classes as (select p_brand, x, y, min(id) as class_id, count(*) as n from boxes group by p_brand, x, y),
            known as (select * from classes where p_brand is not null and x is not null and y is not null),
            points as (select p_brand, explode(sequence(x - {WIDE - 1}, x + {WIDE - 1})) as at, y as place, 1 as turn, cast(null as bigint) as class_id, y, x, n from known
                union all select p_brand, x, y + step, case when step > 0 then 0 else 2 end, class_id, y, x, 0 from known lateral view explode(array(-{HIGH}, 0, {HIGH})) s as step),
            summed as (select class_id, place - y as step, y, sum(n) over w as n, sum(n * ({WIDE} - abs(at - x))) over w as wide, sum(n * ({WIDE} - abs(at - x)) * y) over w as moved
                from points window w as (partition by p_brand, at order by place, turn rows unbounded preceding)),
            ends as (select class_id, max(y) as y, max(case when step < 0 then n end) as n1, max(case when step > 0 then n end) as n3, max(case when step < 0 then wide end) as w1, max(case when step = 0 then wide end) as w2,
                max(case when step > 0 then wide end) as w3, max(case when step < 0 then moved end) as m1, max(case when step = 0 then moved end) as m2, max(case when step > 0 then moved end) as m3 from summed where class_id is not null group by class_id)
            select b.id, c.class_id, coalesce(e.n3 - e.n1 - 1, 0) as n_links, coalesce(round((({HIGH} - e.y) * (w2 - w1) + m2 - m1 + ({HIGH} + e.y) * (w3 - w2) - m3 + m2 - {WIDE * HIGH}) / cast({WIDE * HIGH} as double), 6), cast(0 as double)) as overlap
            from boxes b join classes c on b.p_brand <=> c.p_brand and b.x <=> c.x and b.y <=> c.y left join ends e on e.class_id = c.class_id""",
        BOXES + f""" select a.id, a.class_id, count(b.id) as n_links, coalesce(round(sum(({WIDE} - abs(a.x - b.x)) * ({HIGH} - abs(a.y - b.y))) / {WIDE * HIGH}.0, 6), 0.0)::double as overlap
            from (select *, min(id) over (partition by p_brand, x, y) as class_id from boxes) a left join boxes b on a.p_brand = b.p_brand and a.id <> b.id and abs(a.x - b.x) < {WIDE} and abs(a.y - b.y) < {HIGH} group by a.id, a.class_id""",
    ),
    "span_coverage": """with held as (select o_custkey as doc, o_orderkey as id, <DAY:o_orderdate> as low, <DAY:o_orderdate> + 120 as high from orders where o_orderstatus <> 'O'),
        islands as (select doc, island, min(low) as low, max(high) as high from (select doc, low, high, sum(new) over (partition by doc order by low, id rows unbounded preceding) as island from
            (select doc, id, low, high, case when low <= max(high) over (partition by doc order by low, id rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from held) x) y group by doc, island),
        wanted as (select o_custkey as doc, o_orderkey as id, <DAY:o_orderdate> as low, <DAY:o_orderdate> + 60 as high from orders where o_orderstatus = 'O')
        select w.doc, w.id, count(i.doc) > 0 as covered from wanted w left join islands i on i.doc = w.doc and i.low <= w.low and w.high <= i.high group by w.doc, w.id""",
    "chunk_publish_check": "select d.source, count(*) as n_rows, count(distinct d.doc_id) as n_ids, count(v.vec_id) as n_points, count(*) = count(distinct d.doc_id) and count(*) = count(v.vec_id) as publishable from documents d left join embeddings v on v.vec_id = d.doc_id group by d.source",
    "cleanup_unpinned": "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) e left anti join (select distinct o_orderkey from orders where o_orderstatus = 'F') p on e.event_id = p.o_orderkey where r > 2",
    "import_reuse": "select coalesce(a.doc_id, b.doc_id) as doc_id, case when a.digest is null then 'added' when b.digest is null then 'removed' when a.digest = b.digest then 'reused' else 'changed' end as state from (select doc_id, <SHA> as digest from documents where lang <> 'es') a full outer join (select doc_id, case when source like '%1%' then upper(<SHA>) else <SHA> end as digest from documents where lang <> 'de') b on a.doc_id = b.doc_id",
    "identifiers_extract": (identifiers, None),
    "chunk_plan": (chunks, None),
}
