"""Quantities, relations, obligations, claims and citations.

The tables hold no measured values, so sentences are made of ``part`` (one a part, in four forms) and answers of ``lineitem``
(one an order: its lines are the sources S1, S2, ...); both are then read as text.
"""

from fathom.functions.words import alias_rows, role_rows, unit_rows

FACTS = """with facts as (select p_partkey as doc_id, p_brand, 'P-' || cast(p_partkey as string) as code, 'Supply voltage of P-' || cast(p_partkey as string) || case p_partkey % 4
    when 0 then ' in operating conditions is between ' || cast(p_size as string) || ' V and ' || cast(p_size + 5 as string) || ' V'
    when 1 then ' during the test is ' || cast(p_size as string) || ' ± 2 V' when 2 then ' in typical use is up to ' || cast(p_size as string) || ' V'
    else ' in operating conditions is not ' || cast(p_size as string) || ' V' end || '.' as text from part)"""

#: One relation a sentence: an interval if one is written (between; symmetric), else the single measure.
RELATIONS = FACTS + """,
    found as (select doc_id, p_brand, code, text, nullif(regexp_extract(text, 'between ([0-9]+) V and ([0-9]+) V', 1), '') as b1, nullif(regexp_extract(text, 'between ([0-9]+) V and ([0-9]+) V', 2), '') as b2,
        nullif(regexp_extract(text, '([0-9]+) ± ([0-9]+) V', 1), '') as s1, nullif(regexp_extract(text, '([0-9]+) ± ([0-9]+) V', 2), '') as s2, nullif(regexp_extract(text, ' ([0-9]+) V', 1), '') as one from facts),
    relations as (select doc_id, p_brand, code, case when b1 is not null or s1 is not null then 'interval' else 'value' end as kind,
        case when b1 is not null then cast(b1 as bigint) when s1 is not null then cast(s1 as bigint) - cast(s2 as bigint) else cast(one as bigint) end as low,
        case when b1 is not null then cast(b2 as bigint) when s1 is not null then cast(s1 as bigint) + cast(s2 as bigint) else cast(one as bigint) end as high,
        case when position('operating' in text) > 0 then 'operating' when position('test' in text) > 0 then 'test' when position('typical' in text) > 0 then 'typical' end as role,
        case when position(' is not ' in text) > 0 then 'negated' else 'asserted' end as status,
        case when position('up to ' in text) > 0 then 'numeric_relation_not_exact' end as issue from found)"""

WANTED = "(values ('voltage', 'operating', 10, 45), ('voltage', 'test', 1, 60), ('voltage', cast(null as string), 20, 30)) o(quantity, role, least_low, most_high)"
MET = f"""{RELATIONS}, obligations as (select p_brand, o.role, o.least_low, o.most_high from (select distinct p_brand from part) b cross join {WANTED}),
    met as (select o.p_brand, o.role, o.least_low, count(r.doc_id) as n_support, sum(case when r.issue is not null or r.status <> 'asserted' then 1 else 0 end) as n_rejected from obligations o left join relations r
        on r.p_brand = o.p_brand and (o.role is null or o.role = r.role) and r.low >= o.least_low and r.high <= o.most_high group by o.p_brand, o.role, o.least_low)"""

QUOTED = """select p_partkey, raw, trim(raw) as q from (select p_partkey, case p_partkey % 7 when 0 then cast(p_size as string) || ' mV' when 1 then cast(p_size as string) || ',5 kV' when 2 then cast(p_size as string) || '.125 m'
    when 3 then ' ' || cast(p_size as string) || ' °C ' when 4 then cast(p_size as string) || ' to 60 V' when 5 then cast(p_size as string) || ' parsec' else cast(p_size as string) end as raw from part) x"""
PARSED = f"""with raw as ({QUOTED}), parts as (select p_partkey, raw, regexp_extract(q, '^([+-]?[0-9]+([.,][0-9]+)?) *([^ 0-9.,]*)$', 1) as token, regexp_extract(q, '^([+-]?[0-9]+([.,][0-9]+)?) *([^ 0-9.,]*)$', 3) as unit from raw),
    units(unit, dimension, factor, shift) as (select * from (values {unit_rows()}, ('', 'number', cast(1 as double), cast(0 as double))) v(unit, dimension, factor, shift)),
    read as (select p.p_partkey, p.raw, case when length(p.raw) > 80 then 'numeric_value_limit' when p.token = '' or u.unit is null then 'not_a_single_quantity'
        when regexp_extract(p.token, '^[+-]?[1-9][0-9]*[.,][0-9][0-9][0-9]$', 0) <> '' then 'ambiguous_decimal_separator' else 'ok' end as status, replace(p.token, ',', '.') as token, p.unit, u.dimension, u.factor, u.shift
        from parts p left join units u on u.unit = p.unit)"""

#: Answers: of each order, every line's price with a citation; the citation of line n is S(n % 5 + 1), so some are wrong or unknown.
SAID = """with held as (select l_orderkey as answer, 'S' || cast(l_linenumber as string) as source, cast(cast(round(min(l_extendedprice)) as bigint) as string) as number from lineitem group by l_orderkey, l_linenumber),
    lines as (select l_orderkey as answer, l_linenumber as line, 'Line ' || cast(l_linenumber as string) || ' costs ' || case when l_linenumber % 4 = 3 then '7' else cast(cast(round(min(l_extendedprice)) as bigint) as string) end || case when l_linenumber % 6 = 5 then ''
        when l_linenumber % 6 = 4 then ' (S' || cast(l_linenumber as string) || ')' else ' [S' || cast(case when l_linenumber % 3 = 0 then l_linenumber % 5 + 1 else l_linenumber end as string) || ']' end || '.' as said from lineitem group by l_orderkey, l_linenumber),
    claims as (select answer, line, said, regexp_extract(said, ' costs ([0-9]+)', 1) as number, regexp_extract(said, '[^(A-Z0-9 ](S[0-9]+)', 1) as cited, regexp_extract(said, '[(](S[0-9]+)[)]', 1) as mentioned from lines)"""

ALIASED = f"""{FACTS}, questions(item, text) as (select * from (values (1, 'tension maximale alimentation'), (2, 'plage de temperature'), (3, 'courant de sortie'), (4, 'voltages'), (5, 'P-12')) v(item, text)),
    asked as (select item, <EX>(<FOLDED:text>) as word from questions), groups(grp, word) as (select * from (values {alias_rows()}) v(grp, word)),
    held as (select distinct doc_id, <EX>(<FOLDED:text>) as word from facts), direct as (select /*+ broadcast(a) */ distinct a.item from asked a join held h on h.word = a.word)"""

#: Questions with codes over the sentences: a passage that names the code and shares a term comes first, then one that only names it.
MUST = f"""{FACTS}, questions(item, code, term, role) as (select * from (values (1, 'P-4', 'voltage', 'operating'), (1, 'P-5', 'voltage', 'operating'), (2, 'P-6', 'temperature', 'typical'), (3, 'P-999999999', 'voltage', 'test')) v(item, code, term, role)),
    held as (select doc_id, text, <EX>(regexp_extract_all(text, '(P-[0-9]+)', 1)) as code from facts)"""

QUERIES = {
    "relation_extract": RELATIONS + " select doc_id, code, kind, low, high, role, status, issue from relations",
    "relation_conflicts": RELATIONS + " select p_brand, role, count(*) as n, count(distinct low) as n_values, count(distinct low) > 1 as conflict from relations where status = 'asserted' and issue is null group by p_brand, role",
    "obligation_coverage": MET + " select p_brand, role, least_low, n_support, cast(n_rejected as bigint) as n_rejected, case when n_support = 0 then 'missing' when n_rejected = n_support then 'rejected' else 'covered' end as state from met",
    "assessment_status": MET + """, flags as (select p_brand, sum(case when n_support = 0 then 1 else 0 end) as missing, sum(n_rejected) as rejected from met group by p_brand),
        clash as (select p_brand, count(*) as n from (select p_brand, role from relations where status = 'asserted' and kind = 'interval' group by p_brand, role having count(distinct low) > 9) c group by p_brand)
        select f.p_brand, case when c.n > 0 then 'conflict' when f.missing > 0 then 'partial' when f.rejected > 0 then 'ambiguous' else 'covered' end as status from flags f left join clash c on c.p_brand = f.p_brand""",
    "comparison_states": RELATIONS + """, sides as (select p_brand, role, min(low) as low, max(high) as high from relations where status = 'asserted' group by p_brand, role)
        select a.p_brand as left_brand, b.p_brand as right_brand, a.role as left_role, b.role as right_role, case when a.role is null or b.role is null then 'context_unestablished' when a.role <> b.role then 'context_differs'
        when a.low = b.low and a.high = b.high then 'equal' else 'different' end as state from sides a join sides b on a.p_brand < b.p_brand""",
    "quantity_parse": PARSED + " select p_partkey, status, case when status = 'ok' then cast(token as double) end as value, case when status = 'ok' then unit end as unit from read",
    "quantity_convert": PARSED + " select r.p_partkey, r.dimension, t.unit as target, case when t.dimension <> r.dimension then null else round((cast(r.token as double) * r.factor + r.shift - t.shift) / t.factor, 6) end as value, case when t.dimension <> r.dimension then 'dimension_mismatch' else 'ok' end as state from read r cross join (select * from units where unit in ('V', 'mm', 'K')) t where r.status = 'ok'",
    "calc_mixed_refusals": PARSED + """ select p_brand, count(*) as n, case when sum(case when status <> 'ok' then 1 else 0 end) > 0 then 'operand_refused' when count(distinct dimension) > 1 then 'mixed_dimensions' when min(dimension) = 'temperature' then 'temperature_arithmetic' else 'ok' end as status
        from read r join part p on p.p_partkey = r.p_partkey group by p_brand""",
    "role_vocabulary": f"{FACTS}, vocabulary(role, word) as (select * from (values {role_rows()}) v(role, word)) select f.doc_id, v.role, count(*) as n from (select doc_id, <EX>(<FOLDED:text>) as word from facts) f join vocabulary v on v.word = f.word group by f.doc_id, v.role",
    "alias_fallback": ALIASED + """, wide as (select distinct a.item, g2.word from asked a left anti join direct d on a.item = d.item join groups g on g.word = a.word or g.word = substr(a.word, 1, length(a.word) - 1) join groups g2 on g2.grp = g.grp and g2.word <> a.word)
        select /*+ broadcast(w) */ w.item, h.doc_id, count(*) as n from wide w join held h on h.word = w.word group by w.item, h.doc_id""",
    "exact_identifier_first": MUST + """, hits as (select q.item, h.code, h.doc_id, row_number() over (partition by q.item, h.code order by h.doc_id) as place from questions q join held h on h.code = q.code)
        select item, code, doc_id, row_number() over (partition by item order by place, code, doc_id) as turn from hits where place <= 24""",
    "mandatory_evidence": MUST + """, tried as (select /*+ merge(h) */ q.item, q.code, h.doc_id, case when position(q.term in lower(h.text)) > 0 then 1 when h.doc_id is not null then 2 end as pass from questions q left join held h on h.code = q.code)
        select item, code, doc_id, case pass when 1 then 'covered' when 2 then 'no_answer_evidence' else 'not_covered' end as state from (select *, row_number() over (partition by item, code order by coalesce(pass, 3), doc_id) as r from tried) x where r = 1""",
    "structural_rerank": MUST + """, rated as (select q.item, h.doc_id, case when q.role in ('operating', 'absolute') and (position('test' in h.text) > 0 or position('typical' in h.text) > 0) then 1 else 0 end as clash,
            case when position(q.role in h.text) > 0 then 1 else 0 end as roles, case when position(q.term in lower(h.text)) > 0 then 1 else 0 end as terms from questions q join held h on h.code = q.code)
        select item, doc_id, clash, roles, terms, row_number() over (partition by item order by clash, roles desc, terms desc, doc_id) as place from rated""",
    "citation_check": SAID + """ select c.answer, count(*) as n_claims, count(h.source) as n_cited, cast(sum(case when c.cited <> '' and h.source is null then 1 else 0 end) as bigint) as n_unknown,
        cast(sum(case when c.cited = '' and m.source is not null then 1 else 0 end) as bigint) as n_mentioned from claims c left join held h on h.answer = c.answer and h.source = c.cited left join held m on m.answer = c.answer and m.source = c.mentioned group by c.answer""",
    "value_attribution": SAID + """, holders as (select answer, number, min(source) as holder from held group by answer, number)
        select c.answer, c.line, c.number, c.cited, case when h.source is not null then 'attributed' when o.holder is null then 'value_not_in_context' when c.cited = '' then 'uncited' else 'cited_value_not_in_cited_sources' end as state
        from claims c left join held h on h.answer = c.answer and h.source = c.cited and h.number = c.number left join holders o on o.answer = c.answer and o.number = c.number""",
    "citation_carry": SAID + """ select answer, line, <LASTSET:nullif(cited, '')> over (partition by answer order by line rows between unbounded preceding and current row) as carried from claims""",
}
