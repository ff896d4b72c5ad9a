"""Text functions, blocks and hashes."""

from fathom.functions.words import ENGLISH, FRENCH, STOPWORDS, sql_list

QUERIES = {
    "term_frequencies": "select term, count(*) as tf, count(distinct doc_id) as df from (select doc_id, <EX>(<WORDS:text>) as term from documents) x group by term",
    "term_keys": f"select term_key, count(*) as df from (select distinct doc_id, substr(term, 1, 5) as term_key from (select doc_id, <EX>(<FOLDED:text>) as term from documents) x where length(term) >= 3 and term not in ({sql_list(STOPWORDS)})) y group by term_key",
    "language_detect": f"""select doc_id, lang, n_fr, n_en, case when n_fr >= 2 and n_fr > 2 * n_en then 'fr' when n_en >= 2 and n_en > 2 * n_fr then 'en' end as detected from (
        select doc_id, lang, cast(sum(case when term in ({sql_list(FRENCH)}) then 1 else 0 end) as bigint) as n_fr, cast(sum(case when term in ({sql_list(ENGLISH)}) then 1 else 0 end) as bigint) as n_en
        from (select doc_id, lang, <EX>(<FOLDED:text>) as term from documents) x group by doc_id, lang) y""",
    "content_hash_dedup": "select <SHA> as digest, min(doc_id) as doc_id, count(*) as copies from documents group by <SHA>",
    "having_duplicates": "select <SHA> as digest, count(*) as copies from documents group by <SHA> having count(*) > 1",
    "blocks_extract": "select doc_id, count(*) as n_blocks, cast(sum(length(line)) as bigint) as n_chars, max(length(line)) as longest from (select doc_id, <EX>(<LINES>) as line from documents) x group by doc_id",
    "html_blocks": "select page_id, <HTMLTITLE> as title, cast(<SIZE>(<HTMLWORDS>) as bigint) as n_words from pages",
    "json_props": "select event_type, count(*) as n, round(avg(cast(<K> as double)), 6) as mean_k, max(cast(<K> as bigint)) as max_k from events group by event_type",
    "header_repeat": "select line, count(*) as n, count(distinct doc_id) as n_documents from (select doc_id, <EX>(<LINES>) as line from documents) x where length(line) > 0 group by line having count(distinct doc_id) >= 3",
}
