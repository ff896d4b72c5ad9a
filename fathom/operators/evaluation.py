"""Evaluation, integrity and state: bootstrap, confusion, outcomes, paired reports, hash chain, pagination, back-off."""

#: Resamples of the clustered bootstrap. A draw is an arithmetic hash of resample and position, so both engines draw alike.
RESAMPLES = 2000

QUERIES = {
    "bootstrap_interval": f"""with clusters as (select source, count(*) as n, sum(l.quality) as hits, cast(row_number() over (order by source) - 1 as bigint) as id from documents d join labels l on d.doc_id = l.doc_id where source is not null group by source),
        draws as (select r.b, c.id as slot, (r.b * 7919 + c.id * 104729 + (r.b * (c.id + 1) * 15485863) % 32452843) % t.n as pick from (select cast(k as bigint) as b from (select <EX>(<RANGE:1|{RESAMPLES}>) as k) q) r cross join clusters c cross join (select count(*) as n from clusters) t),
        ratios as (select b, sum(c.hits) / cast(sum(c.n) as double) as ratio from draws d join clusters c on c.id = d.pick group by b)
        select count(*) as resamples, round(<PCT:ratio|0.025>, 6) as low, round(<PCT:ratio|0.975>, 6) as high from ratios""",
    "confusion_matrix": "select l.quality as expected, case when d.n_chars >= 800 then 1 else 0 end as got, count(*) as n from labels l join documents d on d.doc_id = l.doc_id group by l.quality, case when d.n_chars >= 800 then 1 else 0 end",
    "run_outcomes": """select outcome, count(*) as n from (select case when o_orderstatus = 'P' then 'interrupted' when false_claims is null then 'unreviewed' when abstained = 1 and false_claims > 0 then 'abstention_with_false_claims'
        when abstained = 1 and answerable = 1 then 'abstention' when abstained = 1 then 'correct_abstention' when answerable = 0 then 'answer_to_unanswerable' when false_claims > 0 then 'incorrect' else 'complete' end as outcome
        from (select o_orderkey, o_orderstatus, case when o_orderkey % 5 = 0 then 1 else 0 end as abstained, case when o_orderkey % 7 < 5 then 1 else 0 end as answerable, case when o_orderkey % 11 = 3 then null when o_orderkey % 11 < 2 then 1 else 0 end as false_claims from orders) x) y group by outcome""",
    "paired_comparison": """select coalesce(a.user_id, b.user_id) as user_id, case when a.user_id is null then 'right_only' when b.user_id is null then 'left_only' else 'paired' end as pairing, round(b.value - a.value, 6) as delta
        from (select user_id, avg(value) as value from events where event_type = 'click' group by user_id) a full outer join (select user_id, avg(value) as value from events where event_type = 'error' group by user_id) b on a.user_id = b.user_id""",
    "risk_coverage_ties": """select event_type, value, n_seen, n_wrong, round(n_wrong / cast(n_seen as double), 6) as risk from (select distinct event_type, value, count(*) over (partition by event_type order by value desc range between unbounded preceding and current row) as n_seen,
        cast(sum(case when user_id % 3 = 0 then 1 else 0 end) over (partition by event_type order by value desc range between unbounded preceding and current row) as bigint) as n_wrong from events) x""",
    "upper_rank_p95": (
        "select event_type, percentile_disc(0.95) within group (order by value) as p95 from events group by event_type",
        "select event_type, min(case when place >= ceil(0.95 * n) then value end) as p95 from (select event_type, value, row_number() over (partition by event_type order by value) as place, count(*) over (partition by event_type) as n from events) x group by event_type",
    ),
    "latency_warm_cold": "select event_type, case when r = 1 then 'cold' else 'warm' end as phase, count(*) as n, round(<PCT:value|0.5>, 6) as p50, round(<PCT:value|0.95>, 6) as p95 from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as r from events) x group by event_type, case when r = 1 then 'cold' else 'warm' end",
    "annotation_freeze": "select case when a.digest = b.digest then 'same' else 'changed' end as state, count(*) as n from (select doc_id, <HASH:cast(quality as string) || '/' || cast(toxic as string)> as digest from labels) a full outer join (select doc_id, <HASH:cast(quality as string) || '/' || cast(case when doc_id % 10 = 3 then 1 - toxic else toxic end as string)> as digest from labels) b on a.doc_id = b.doc_id group by case when a.digest = b.digest then 'same' else 'changed' end",
    "keyset_page": """select e.user_id, e.event_id, row_number() over (partition by e.user_id order by e.ts desc, e.event_id desc) as place from (select x.*, row_number() over (partition by x.user_id order by x.ts desc, x.event_id desc) as r from events x
        join (select user_id, ts as at, event_id as id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) y where r = 10) c on c.user_id = x.user_id and (x.ts < c.at or (x.ts = c.at and x.event_id < c.id))) e where e.r <= 11""",
    "event_sequence": "select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as seq from events",
    "retry_backoff": "select user_id, event_id, failures, least(cast(300 as double), power(cast(2 as double), failures - 1)) as delay from (select user_id, event_id, event_type, cast(count(*) over (partition by user_id, grp order by ts, event_id rows unbounded preceding) as bigint) as failures from (select *, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as grp from events) x where event_type = 'error') y",
    "job_recovery": "select user_id, event_id, case event_type when 'view' then 'interrupted' when 'click' then 'paused' else event_type end as state from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) x where r = 1",
    "history_scope": (
        "select conv_id, turn, size(array_except(words, asked)) as n_outside from (select conv_id, turn, array_distinct(<FOLDED:text>) as words, array_distinct(lag(<FOLDED:text>) over (partition by conv_id order by turn, role, text)) as asked from conversations) x where asked is not null",
        "select conv_id, turn, cast(len(list_filter(words, lambda w: not list_contains(asked, w))) as integer) as n_outside from (select conv_id, turn, list_distinct(<FOLDED:text>) as words, lag(<FOLDED:text>) over (partition by conv_id order by turn, role, text) as asked from conversations) x where asked is not null",
    ),
}
