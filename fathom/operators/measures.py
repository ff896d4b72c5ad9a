"""Calculations with refusals, evaluation statistics and event logs."""

from fathom.functions import wilson

QUERIES = {
    "wilson_by_group": f"select lang, n, hits, {wilson('hits', 'n', '-')} as low, {wilson('hits', 'n', '+')} as high from (select d.lang, count(*) as n, cast(sum(l.quality) as bigint) as hits from documents d join labels l on d.doc_id = l.doc_id group by d.lang) x",
    "percentile_latency": "select event_type, count(*) as n, round(<PCT:value|0.5>, 6) as p50, round(<PCT:value|0.95>, 6) as p95 from events group by event_type",
    "micro_macro_ratio": "select round(sum(hits) / cast(sum(n) as double), 6) as micro, round(avg(hits / cast(n as double)), 6) as macro from (select d.source, count(*) as n, sum(l.quality) as hits from documents d join labels l on d.doc_id = l.doc_id group by d.source) x",
    "grouping_sets_report": "select lang, quality, count(*) as n from (select d.lang, l.quality from documents d join labels l on d.doc_id = l.doc_id) x group by grouping sets ((lang, quality), (lang), ())",
    "risk_coverage": "select user_id, event_id, place, round(place / cast(n as double), 6) as coverage, round(risk / place, 6) as risk from (select user_id, event_id, count(*) over (partition by user_id) as n, row_number() over (partition by user_id order by value desc, event_id) as place, cast(sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by value desc, event_id rows unbounded preceding) as double) as risk from events) x",
    "repetition_stability": "select user_id, count(distinct event_type) as n_results, count(distinct event_type) = 1 as stable from events group by user_id",
    "conflict_groups": "select digest, count(*) as n, min(quality) as low, max(quality) as high from (select <SHA> as digest, l.quality from documents d join labels l on d.doc_id = l.doc_id) x group by digest having min(quality) <> max(quality)",
    "calc_sum_mean": "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as sum_qty, round(avg(l_extendedprice), 4) as mean_price, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem group by l_returnflag, l_linestatus",
    "calc_ratio_refusal": "select o_custkey, case when total = 0 or n < 2 then null else round(most / total, 6) end as ratio, case when n < 2 then 'insufficient_operands' when total = 0 then 'division_by_zero' else 'ok' end as status from (select o_custkey, count(*) as n, sum(o_totalprice) as total, max(o_totalprice) as most from orders group by o_custkey) x",
    "unit_conversion": "select p_partkey, u.unit, round(p_size * cast(u.factor as double), 6) as metres, case when u.dimension = 'length' then 'ok' else 'dimension_mismatch' end as status from part join (values (0, 'mm', 0.001, 'length'), (1, 'cm', 0.01, 'length'), (2, 'V', 1.0, 'voltage')) u(k, unit, factor, dimension) on p_partkey % 3 = u.k",
    "paired_delta": "select a.user_id, round(avg(a.value) - avg(b.value), 6) as delta from (select user_id, avg(value) as value from events where event_type = 'click' group by user_id) a join (select user_id, avg(value) as value from events where event_type = 'view' group by user_id) b on a.user_id = b.user_id group by a.user_id",
    "split_hygiene": "select a.source as left_source, b.source as right_source, count(*) as shared from (select distinct source, <SHA> as digest from documents) a join (select distinct source, <SHA> as digest from documents) b on a.digest = b.digest and a.source < b.source group by a.source, b.source",
    "event_resume": "select e.event_id, e.user_id, e.event_type from events e join (select user_id, min(event_id) + 10 as cursor_id from events group by user_id) c on e.user_id = c.user_id and e.event_id > c.cursor_id",
    "terminal_state": "select o_custkey, cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) as n_final, min(case when o_orderstatus = 'F' then o_orderdate end) as first_final from orders group by o_custkey",
    "watchdog_gaps": "select user_id, event_id, gap from (select user_id, event_id, <EPOCH> - lag(<EPOCH>) over (partition by user_id order by ts, event_id) as gap from events) x where gap > 3600000000",
    "interval_merge": """select user_id, grp, count(*) as n, min(us) as first_us, max(us) as last_us from (select user_id, us, cast(sum(new) over (partition by user_id order by us, event_id rows unbounded preceding) as bigint) as grp from
        (select user_id, event_id, us, case when us - lag(us) over (partition by user_id order by us, event_id) <= 1800000000 then 0 else 1 end as new from (select user_id, event_id, <EPOCH> as us from events) e) x) y group by user_id, grp""",
}
