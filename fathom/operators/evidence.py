"""Spans, tables, readers, queues and caches. Each Spark text has an oracle of another form.

Where the tables have no such thing, a column stands for it, as the comments say; rules and limits are the stated ones.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import dialect
from fathom.sources import table

LINES = "select doc_id, pos, start_at, start_at + length(line) as end_at, line from (select doc_id, pos, line, cast(sum(length(line) + 1) over (partition by doc_id order by pos rows unbounded preceding) - length(line) - 1 as bigint) as start_at from (<BLOCKS>) b) l"

#: The reader's page, the last of a query's deltas that stay, the most combinations, cells and characters of a projection.
PAGE, DELTAS, MOST_PAIRS, MOST_CELLS, MOST_CHARS, PARENT = 50, 512, 256, 1000, 200_000, 900

#: Documents whose counts of shared words one task holds at a time.
COUNTED = 2000


def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a passage of the benchmark and a document that share ten words or more. The passages' words are broadcast; documents are
    dealt once, so many to a task, and their words, one row each, are counted where they lie."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    documents = documents.repartition(documents.count() // COUNTED + 1, "doc_id")
    words = dialect("array_distinct(<WORDS:text>)", 0)
    items = table(spark, sf_dir, "benchmark").selectExpr("item_id", f"{words} as words").selectExpr("item_id", "size(words) as size", "explode(words) as term")
    known = F.broadcast(items.select("term").distinct())
    asked = documents.selectExpr("doc_id", f"explode({words}) as term").join(known, "term", "left_semi").distinct()
    both = asked.join(F.broadcast(items), "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"), F.max("size").alias("size"))
    return both.where("shared >= 10").select("item_id", "doc_id", "shared", F.expr("round(shared / size, 3)").alias("ratio"))


QUERIES = {
    # Selected: the second quarter of each text. A line's part in it, cut out of the line here and out of the whole text there.
    "span_clipping": (
        f"""select doc_id, pos, low, high, sha2(substring(line, cast(low - start_at + 1 as int), cast(high - low as int)), 256) as digest from (select l.*, greatest(l.start_at, s.low) as low, least(l.end_at, s.high) as high
            from ({LINES}) l join (select doc_id as id, length(text) div 4 as low, length(text) div 2 as high from documents) s on s.id = l.doc_id) x where low < high""",
        f"""select l.doc_id, l.pos, case when l.start_at > length(d.text) // 4 then l.start_at else length(d.text) // 4 end as low, case when l.end_at < length(d.text) // 2 then l.end_at else length(d.text) // 2 end as high,
            sha256(substr(d.text, cast(low + 1 as bigint), cast(high - low as bigint))) as digest from ({LINES}) l join documents d on d.doc_id = l.doc_id where l.start_at < length(d.text) // 2 and l.end_at > length(d.text) // 4 and low < high""",
    ),
    # A line stands for a chunk, its text for the parent; tokens are a quarter of the characters and three.
    "parent_expansion": (
        f"select b.doc_id, b.pos, case when p.tokens <= {PARENT} then 'parent' else 'chunk' end as shown, case when p.tokens <= {PARENT} then p.n else length(b.line) end as n_chars from (<BLOCKS>) b join (select doc_id as id, length(text) as n, length(text) div 4 + 3 as tokens from documents) p on p.id = b.doc_id",
        f"select b.doc_id, b.pos, 'parent' as shown, length(d.text) as n_chars from (<BLOCKS>) b join documents d on d.doc_id = b.doc_id where length(d.text) < {4 * (PARENT - 2)} union all select b.doc_id, b.pos, 'chunk', length(b.line) from (<BLOCKS>) b join documents d on d.doc_id = b.doc_id where length(d.text) >= {4 * (PARENT - 2)}",
    ),
    # Events stand for readings of a page: users for documents, types for methods; views are native text and need no warning.
    "ocr_warnings": (
        "select user_id, array_join(array_sort(collect_set(event_type)), ',') as methods, array_join(transform(array_sort(collect_set(event_id)), x -> cast(x as string)), ',') as sources from events where event_type <> 'view' group by user_id",
        "select m.user_id, m.methods, s.sources from (select user_id, string_agg(event_type, ',' order by event_type) as methods from (select distinct user_id, event_type from events where event_type <> 'view') a group by user_id) m join (select user_id, string_agg(cast(event_id as varchar), ',' order by event_id) as sources from (select distinct user_id, event_id from events where event_type <> 'view') b group by user_id) s on s.user_id = m.user_id",
    ),
    # Orders stand for tables on pages of ten orders; a table goes on if headers and columns are the last one's and its page is the same or the next.
    # Tables are dealt by ranges of keys; the last keys of a range are looked at in the next one too, as no page reaches further.
    "table_continuation": (
        """with t as (select l_orderkey, l_orderkey div 10 as page, min(concat(l_returnflag, l_linestatus)) as header, count(*) as n_columns from lineitem group by l_orderkey),
            dealt as (select *, l_orderkey - pmod(l_orderkey, 10000) as span, true as own from t union all select *, l_orderkey - pmod(l_orderkey, 10000) + 10000, false from t where pmod(l_orderkey, 10000) >= 9900)
            select l_orderkey, header, n_columns, continued from (select *, coalesce(header = lag(header) over w and n_columns = lag(n_columns) over w and page - lag(page) over w <= 1, false) as continued
            from dealt window w as (partition by span order by l_orderkey)) x where own""",
        """with t as (select l_orderkey, l_orderkey // 10 as page, min(l_returnflag || l_linestatus) as header, count(*) as n_columns, row_number() over (order by l_orderkey) as r from lineitem group by l_orderkey)
            select a.l_orderkey, a.header, a.n_columns, b.r is not null as continued from t a left join t b on b.r = a.r - 1 and b.header = a.header and b.n_columns = a.n_columns and a.page - b.page in (0, 1)""",
    ),
    # Parts stand for tokens at (x, y); a new line begins where y falls by more than the tolerance behind the token before.
    "token_lines": (
        """select p_brand, p_partkey, cast(sum(new) over (partition by p_brand order by y, x, p_partkey rows unbounded preceding) as bigint) as line from (select *, case when y - lag(y) over (partition by p_brand order by y, x, p_partkey) <= 4 then 0 else 1 end as new
            from (select p_brand, p_partkey, p_partkey * 131 % 997 as y, p_partkey * 17 % 613 as x from part) t) u""",
        """with t as (select p_brand, p_partkey, p_partkey * 131 % 997 as y, p_partkey * 17 % 613 as x from part), n as (select *, row_number() over (partition by p_brand order by y, x, p_partkey) as r from t),
            breaks as (select b.p_brand, b.r from n b left join n a on a.p_brand = b.p_brand and a.r = b.r - 1 where a.r is null or b.y - a.y > 4) select n.p_brand, n.p_partkey, count(*) as line from n join breaks k on k.p_brand = n.p_brand and k.r <= n.r group by n.p_brand, n.p_partkey""",
    ),
    # Order lines stand for cells that span one to three rows; a row sees the cells that span it.
    "rowspan_inheritance": (
        "select l_orderkey, row_at, count(*) as n_active, array_join(array_sort(collect_set(cast(l_partkey as string))), ',') as cells from (select l_orderkey, l_partkey, explode(sequence(l_linenumber, cast(l_linenumber + cast(l_quantity as int) % 3 as int))) as row_at from lineitem) x group by l_orderkey, row_at",
        "with cells as (select l_orderkey, l_partkey, l_linenumber as top, l_linenumber + cast(l_quantity as int) % 3 as bottom from lineitem), seen as (select distinct l_orderkey, top + k as row_at from cells join (values (0), (1), (2)) v(k) on top + k <= bottom) select s.l_orderkey, s.row_at, count(*) as n_active, string_agg(distinct cast(c.l_partkey as varchar), ',' order by cast(c.l_partkey as varchar)) as cells from seen s join cells c on c.l_orderkey = s.l_orderkey and s.row_at between c.top and c.bottom group by s.l_orderkey, s.row_at",
    ),
    # Views stand for deltas: of each user the newest stay, and everything else.
    "event_retention": (
        f"select user_id, count(*) as kept from (select user_id, event_type, row_number() over (partition by user_id, event_type order by event_id desc) as r from events) x where event_type <> 'view' or r <= {DELTAS} group by user_id",
        f"select user_id, sum(case when event_type = 'view' then least(n, {DELTAS}) else n end)::bigint as kept from (select user_id, event_type, count(*) as n from events group by user_id, event_type) x group by user_id",
    ),
    # Open orders stand for queued jobs: of each priority the oldest comes first.
    "job_queue": (
        "select o_orderpriority, x.o_orderkey as next_job, n from (select o_orderpriority, min(struct(o_orderdate, o_orderkey)) as x, count(*) as n from orders where o_orderstatus = 'O' group by o_orderpriority) q",
        "select o_orderpriority, o_orderkey as next_job, n from (select *, row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) as r, count(*) over (partition by o_orderpriority) as n from orders where o_orderstatus = 'O') q where r = 1",
    ),
    # Parts asked for by orders, and their neighbours: unknown, deleted (size 1), not indexed (size 2), or there.
    "missing_documents": (
        "select w.id, case when p.p_partkey is null then 'unknown' when p.p_size = 1 then 'deleted' else 'not_indexed' end as status from (select distinct l_partkey + 7 as id from lineitem) w left join part p on p.p_partkey = w.id where p.p_partkey is null or p.p_size <= 2",
        "with w as (select distinct l_partkey + 7 as id from lineitem) select id, 'unknown' as status from w where not exists (select 1 from part where p_partkey = id) union all select id, 'deleted' from w where id in (select p_partkey from part where p_size = 1) union all select id, 'not_indexed' from w where id in (select p_partkey from part where p_size < 1 or p_size = 2)",
    ),
    # Pages of a source's documents: rows, and the cursor of the next page, null at the end.
    "paged_reader": (
        f"select source, page, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id, case when max(place) < max(total) then max(place) end as next_cursor from (select source, doc_id, row_number() over (partition by source order by doc_id) as place, count(*) over (partition by source) as total, (row_number() over (partition by source order by doc_id) - 1) div {PAGE} as page from documents) x group by source, page",
        f"with n as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as place from documents), pages as (select source, place // {PAGE} as page, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from n group by source, place // {PAGE}) select p.*, case when q.page is not null then q.page * {PAGE} end as next_cursor from pages p left join pages q on q.source is not distinct from p.source and q.page = p.page + 1",
    ),
    "mapping_facts": (
        r"select doc_id, m.`0` as name, m.`1` as value, count(*) as n from (select doc_id, explode(arrays_zip(regexp_extract_all(text, r'([A-Za-z_]+)=([A-Za-z0-9]+)', 1), regexp_extract_all(text, r'([A-Za-z_]+)=([A-Za-z0-9]+)', 2))) as m from documents) x group by doc_id, m.`0`, m.`1`",
        "select doc_id, split_part(m, '=', 1) as name, split_part(m, '=', 2) as value, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z_]+=[A-Za-z0-9]+')) as m from documents) x group by doc_id, name, value",
    ),
    "lexical_overlap": (
        lexical_overlap,
        """select item_id, doc_id, len(list_intersect(q, w)) as shared, round(len(list_intersect(q, w)) / cast(len(q) as double), 3) as ratio from (select item_id, list_distinct(<WORDS:text>) as q from benchmark) b, (select doc_id, list_distinct(<WORDS:text>) as w from documents) d where len(list_intersect(q, w)) >= 10""",
    ),
    # Vectors stand for a cache under their number: texts whose number has none are computed, once for equal texts.
    "cached_embeddings": (
        "select lang, count(*) as n, count(v.vec_id) as n_hits, count(distinct case when v.vec_id is null then <SHA> end) as n_computed from documents d left join embeddings v on v.vec_id = d.doc_id group by lang",
        "with hits as (select doc_id from documents intersect select vec_id from embeddings) select lang, count(*) as n, sum(case when doc_id in (select doc_id from hits) then 1 else 0 end)::bigint as n_hits, (select count(*) from (select distinct text from documents x where x.lang is not distinct from d.lang and x.text is not null and x.doc_id not in (select doc_id from hits)) y) as n_computed from documents d group by lang",
    ),
    # Users stand for jobs: the state of the last event; after an error the wait doubles with each one in a row.
    "job_states": (
        """select user_id, max_by(event_type, struct(ts, event_id)) as state, cast(sum(case when r > last_good then 1 else 0 end) as bigint) as failures, least(cast(300 as double), case when sum(case when r > last_good then 1 else 0 end) = 0 then 0 else power(2, sum(case when r > last_good then 1 else 0 end) - 1) end) as delay
            from (select *, coalesce(max(case when event_type <> 'error' then r end) over (partition by user_id), 0) as last_good from (select *, row_number() over (partition by user_id order by ts, event_id) as r from events) e) x group by user_id""",
        """with n as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as back from events), good as (select user_id, min(back) as g from n where event_type <> 'error' group by user_id),
            tail as (select n.user_id, count(*) as k from n left join good on good.user_id = n.user_id where n.back < coalesce(g, 1e18) group by n.user_id)
            select n.user_id, n.event_type as state, coalesce(k, 0) as failures, case when coalesce(k, 0) = 0 then 0.0 else least(300.0, pow(2.0, k - 1)) end as delay from n left join tail on tail.user_id = n.user_id where back = 1""",
    ),
    # Brands stand for questions: their sizes, types and parts are multiplied only where the product stays small.
    "obligation_guard": (
        f"select p_brand, n_parts * n_sizes * n_types as work, case when n_parts * n_sizes * n_types > {MOST_PAIRS} then 'refused' else 'ok' end as status from (select p_brand, count(*) as n_parts, count(distinct p_size) as n_sizes, count(distinct p_type) as n_types from part group by p_brand) x",
        f"with a as (select p_brand, count(*) as n from part group by p_brand), b as (select p_brand, count(*) as n from (select distinct p_brand, p_size from part) x group by p_brand), c as (select p_brand, count(*) as n from (select distinct p_brand, p_type from part) y group by p_brand) select a.p_brand, a.n * b.n * c.n as work, case when a.n * b.n * c.n <= {MOST_PAIRS} then 'ok' else 'refused' end as status from a join b on a.p_brand = b.p_brand join c on c.p_brand = a.p_brand",
    ),
    # A supplier's order lines stand for cells of a selection, in order, while cells and characters last.
    "projection_limits": (
        f"select l_suppkey, count(*) as n_cells, cast(sum(case when place <= {MOST_CELLS} and chars <= {MOST_CHARS} then 1 else 0 end) as bigint) as n_shown, max(place) > {MOST_CELLS} or max(chars) > {MOST_CHARS} as truncated from (select l_suppkey, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) as place, sum(length(cast(l_partkey as string)) + 1) over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey rows unbounded preceding) as chars from lineitem) x group by l_suppkey",
        f"with c as (select l_suppkey, list(length(cast(l_partkey as varchar)) + 1 order by l_orderkey, l_linenumber, l_partkey) as sizes from lineitem group by l_suppkey) select l_suppkey, len(sizes) as n_cells, len(list_filter(range(1, least(len(sizes), {MOST_CELLS}) + 1), lambda k: list_sum(sizes[1:k]) <= {MOST_CHARS})) as n_shown, len(sizes) > {MOST_CELLS} or list_sum(sizes) > {MOST_CHARS} as truncated from c",
    ),
}
