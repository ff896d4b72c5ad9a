"""Scope algebra and joins: every query is restricted before anything is ranked."""

QUERIES = {
    "scope_library": "select count(*) as n_documents, count(distinct source) as n_sources, cast(sum(n_chars) as bigint) as n_chars from documents",
    "scope_folder_recursive": """with recursive tree(kind, id, parent, depth) as (
        select 'region', cast(r_regionkey as bigint), cast(null as bigint), 0 from region
        union all select 'nation', cast(n_nationkey as bigint), t.id, 1 from nation join tree t on t.kind = 'region' and n_regionkey = t.id)
        select t.parent as regionkey, count(*) as n_customers, round(sum(c_acctbal), 2) as acctbal
        from tree t join customer c on t.kind = 'nation' and c.c_nationkey = t.id group by t.parent""",
    "scope_documents_missing": "select d.doc_id from documents d left anti join labels l on d.doc_id = l.doc_id",
    "scope_pages_window": "select conv_id, turn, role from (select conv_id, turn, role, dense_rank() over (partition by conv_id order by turn) as page from conversations) x where page between 2 and 3",
    "scope_cell_range": "select l_orderkey, l_linenumber, l_quantity, l_extendedprice from lineitem where l_orderkey between 100 and 2000 and l_linenumber between 2 and 4",
    "scope_multi_rectangle": """select l.l_orderkey, l.l_linenumber, min(r.id) as first_rectangle, count(*) as n_rectangles from lineitem l join
        (values (1, 1, 500, 1, 2), (2, 300, 900, 2, 3), (3, 2000, 4000, 4, 7)) r(id, r1, r2, c1, c2)
        on l.l_orderkey between r.r1 and r.r2 and l.l_linenumber between r.c1 and r.c2 group by l.l_orderkey, l.l_linenumber""",
    "scope_leak_audit": "select d.source, count(*) as n, cast(sum(case when l.doc_id is null then 1 else 0 end) as bigint) as n_outside from documents d left join labels l on d.doc_id = l.doc_id group by d.source",
    "snapshot_latest_revision": "select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) e where r = 1",
    "join_latest_job": "select c.c_custkey, o.o_orderkey, o.o_orderstatus from customer c left join (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) o on o.o_custkey = c.c_custkey and o.r = 1",
    # Spark numbers rows within bins of the order and adds the rows of the bins before; only the bins' counts meet in one task.
    "join_left_nulls_last": (
        """with rated as (select d.doc_id, l.quality, coalesce(-l.quality, 9223372036854775807) as major, d.doc_id div 65536 as bin from documents d left join labels l on d.doc_id = l.doc_id),
            starts as (select major, bin, sum(n) over (order by major, bin) - n as before from (select major, bin, count(*) as n from rated group by major, bin) c)
            select r.doc_id, r.quality, s.before + row_number() over (partition by r.major, r.bin order by r.doc_id) as place from rated r join starts s on s.major = r.major and s.bin = r.bin""",
        "select d.doc_id, l.quality, row_number() over (order by l.quality desc nulls last, d.doc_id) as place from documents d left join labels l on d.doc_id = l.doc_id",
    ),
    "semi_scope": "select doc_id, lang from documents d left semi join (select doc_id from labels where quality = 1) l on d.doc_id = l.doc_id",
    "anti_missing": "select c_custkey from customer left anti join orders on c_custkey = o_custkey",
    "overlap_spans": """select a.o_custkey, a.o_orderkey as left_key, b.o_orderkey as right_key from orders a join orders b
        on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.o_orderdate < b.o_orderdate + interval 30 days and b.o_orderdate < a.o_orderdate + interval 30 days""",
    "rectangle_join": "select r.id, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem join (values (1, 1, 10), (2, 5, 30), (3, 31, 50)) r(id, low, high) on l_quantity between r.low and r.high group by r.id",
    "full_outer_points_vs_chunks": "select coalesce(v.vec_id, d.doc_id) as id, v.vec_id is null as no_vector, d.doc_id is null as no_document from embeddings v full outer join documents d on v.vec_id = d.doc_id",
    "obligation_cross_join": "select o.kind, s.s_nationkey, count(*) as n, cast(sum(case when s.s_acctbal >= o.least then 1 else 0 end) as bigint) as n_met from supplier s cross join (values ('low', 0.0), ('mid', 3000.0), ('high', 8000.0)) o(kind, least) group by o.kind, s.s_nationkey",
    "theta_obligation_match": "select o.kind, count(*) as n from part join (values ('small', 1, 10), ('medium', 11, 30), ('large', 31, 60)) o(kind, low, high) on p_size >= o.low and p_size <= o.high group by o.kind",
    "set_equality_comparison": """select count(*) as n_pairs from (select o_orderpriority, <JOINED:o_orderstatus> as s from orders group by o_orderpriority) a
        join (select o_orderpriority, <JOINED:o_orderstatus> as s from orders group by o_orderpriority) b on a.s = b.s and a.o_orderpriority < b.o_orderpriority""",
}
