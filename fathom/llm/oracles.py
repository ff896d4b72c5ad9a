"""DuckDB SQL for queries of this subpackage that SQL can express on whole tables."""

#: Cosine of all pairs of valid vectors of one dimension, links that reach 0.9, and what they connect.
EMBEDDING_DEDUP = """with recursive given as (select vec_id, embedding::double[] as v from embeddings),
    valid as (select vec_id, list_transform(v, lambda x: x / list_max(list_transform(v, lambda y: abs(y)))) as v from given
        where v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
    unit as (select vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from valid),
    links as (select a.vec_id as a, b.vec_id as b from unit a join unit b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_dot_product(a.v, b.v) >= 0.9),
    reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b)
    select g.vec_id, coalesce(l.n, 0) as n_links, least(g.vec_id, coalesce(r.low, g.vec_id)) as component_id, g.vec_id = least(g.vec_id, coalesce(r.low, g.vec_id)) as kept from given g
    left join (select a, count(distinct b) as n from links group by a) l on l.a = g.vec_id left join (select a, min(b) as low from reach group by a) r on r.a = g.vec_id"""

#: Windows of 20 words as strings; those whose first place is earlier cover what is removed.
SUBSTRING_DEDUP = r"""with words as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
    windows as (select doc_id, unnest(range(1, len(w) - 18)) as s, w from words where len(w) >= 20),
    keyed as (select doc_id, s, array_to_string(w[s : s + 19], ' ') as k from windows),
    late as (select doc_id, s from (select doc_id, s, row_number() over (partition by k order by doc_id, s) as nth from keyed) x where nth > 1),
    edges as (select doc_id, i, sum(d) as d from (select doc_id, s as i, 1 as d from late union all select doc_id, s + 20, -1 from late) e group by doc_id, i),
    placed as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from words),
    judged as (select p.doc_id, p.i, p.word, sum(coalesce(e.d, 0)) over (partition by p.doc_id order by p.i) > 0 as gone from placed p left join edges e on e.doc_id = p.doc_id and e.i = p.i),
    cut as (select doc_id, count(*) filter (gone) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (not gone), '') as kept from judged group by doc_id)
    select w.doc_id, len(w.w) as n_words, coalesce(c.n_removed, 0) as n_removed, sha256(coalesce(c.kept, '')) as kept_sha256 from words w left join cut c on c.doc_id = w.doc_id"""

#: Prefixes of rebuilt conversations as joined digests; a node's subtree is what has it among its own prefixes.
PREFIX_TRIE = """with t as (select conv_id, turn, coalesce(role, '') as r, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as d, strlen(coalesce(text, ''))::bigint as b from conversations where conv_id is not null),
    own as (select conv_id, list({'d': d, 'b': b} order by turn nulls first, r, d) as ts from t group by conv_id),
    hashed as (select *, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ord(c)::bigint)),
        lambda s, c: list_reduce(list_prepend(xor(s, c), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda v, k: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end)) as c from own),
    cut as (select conv_id, ts, xor(c, 4294967295) % 9 as h from hashed),
    rebuilt as (select c.conv_id, list_concat(list_slice(coalesce(b.ts, []), 1, c.h), list_slice(c.ts, c.h + 1, len(c.ts))) as ts from cut c left join own b on b.conv_id = c.conv_id - c.conv_id % 5),
    members as (select conv_id, len(ts) as n, unnest(range(0, len(ts) + 1)) as depth, list_transform(ts, lambda x: x.d) as ds, ts from rebuilt),
    nodes as (select array_to_string(list_slice(ds, 1, depth), ',') as key, min(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(list_slice(ds, 1, depth)) as ds,
        any_value(array_to_string(list_slice(ds, 1, depth - 1), ',')) as above, any_value(coalesce(ts[depth].b, 0)) as b, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth), '')) as ends_sha256 from members group by 1),
    children as (select above, count(*) as n_children from nodes where depth > 0 group by above),
    full_nodes as (select n.*, coalesce(c.n_children, 0) as n_children from nodes n left join children c on c.above = n.key),
    up as (select unnest(list_transform(range(0, depth + 1), lambda k: array_to_string(list_slice(ds, 1, k), ','))) as key, (n_children = 0)::bigint as leaf, (n_convs - 1) * b as saved from full_nodes),
    sums as (select key, sum(leaf)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from up group by key)
    select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256 from full_nodes n join sums s on s.key = n.key left join nodes p on n.depth > 0 and p.key = n.above"""


def _assigned(books: str) -> str:
    """Parts with the nearest entry of books and its squared distance."""
    return f"""(select vec_id, label, p, x, min(struct_pack(d := d, k := k)) as m from (select a.*, b.k,
        list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from parts a join {books} b on b.p = a.p) z group by all)"""


def _moved(books: str) -> str:
    """The next entries: the floor of the mean where an entry is used."""
    floor = "((s - ((s % n) + n) % n) // n)::bigint"
    return f"""(select b.p, b.k, coalesce(u.x, b.x) as x from {books} b left join (select p, k, list({floor} order by i) as x from
        (select p, k, i, sum(v)::bigint as s, count(*)::bigint as n from (select p, m.k as k, unnest(x) as v, generate_subscripts(x, 1) as i from {_assigned(books)}) y group by p, k, i) w group by p, k) u on u.p = b.p and u.k = b.k)"""


#: Two rounds over every part, without equal ones counted together.
VECTOR_CODES = f"""with kept as (select vec_id, label, embedding::double[] as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
    width as (select ceil(max(len(v)) / 16.0)::bigint as w from kept),
    whole as (select vec_id, label, list_resize(list_transform(v, lambda x: floor(256 * x)::bigint), 16 * w, 0) as v, w from kept, width),
    parts as (select vec_id, label, p, list_slice(v, p * w + 1, p * w + w) as x from (select *, unnest(range(0, 16)) as p from whole) z),
    b0 as (select p, k, x from (select p, x, row_number() over (partition by p order by vec_id) - 1 as k from parts) z where k < 64),
    b1 as materialized {_moved("b0")}, b2 as materialized {_moved("b1")},
    coded as (select vec_id, label, string_agg(lower(lpad(to_hex(m.k), 2, '0')), '' order by p) as code, sum(m.d)::bigint as error from {_assigned("b2")} group by vec_id, label)
    select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
    (select sha256(string_agg(array_to_string(x, ','), ',' order by p, k)) from b2) as codebooks_sha256 from coded"""

ORACLES = {"op1_embedding_dedup": EMBEDDING_DEDUP, "op5_substring_dedup": SUBSTRING_DEDUP, "op12_prefix_trie": PREFIX_TRIE, "op13_vector_codes": VECTOR_CODES}
