"""Expressions that queries share, as SQL for Spark and for the oracle."""

#: Placeholders of query texts: (Spark, DuckDB).
DIALECT = {
    "EX": ("explode", "unnest"),
    "WORDS": ("regexp_extract_all(lower({}), r'[\\p{{L}}\\p{{N}}]+', 0)", "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+', 0)"),
    "FOLDED": (
        "regexp_extract_all(translate(lower({}), 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), r'[\\p{{L}}\\p{{N}}]+', 0)",
        "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+', 0)",
    ),
    "RANGE": ("sequence({}, {})", "range({}, {} + 1)"),
    "GLOBAL": ("", ", 'g'"),
    "HASH": ("sha2({}, 256)", "sha256({})"),
    "DAY": ("datediff({}, date'1970-01-01')", "date_diff('day', date '1970-01-01', cast({} as date))"),
    "HEAD": ("slice({}, 1, {})", "list_slice({}, 1, {})"),
    "DIV": ("({} div {})", "({} // {})"),
    "BLOCKS": (
        "select doc_id, cast(pos as bigint) as pos, line from documents lateral view posexplode(split(text, '\\n')) t as pos, line",
        "select doc_id, cast(generate_subscripts(ls, 1) - 1 as bigint) as pos, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from documents) b",
    ),
    "LASTSET": ("last({}, true)", "last_value({} ignore nulls)"),
    "CODES": ("regexp_extract_all(text, r'[A-Z]{2,}-?[0-9]+', 0)", "regexp_extract_all(text, '[A-Z]{2,}-?[0-9]+', 0)"),
    "LINES": ("split(text, '\\n')", "string_split(text, chr(10))"),
    "SIZE": ("size", "len"),
    "SHA": ("sha2(text, 256)", "sha256(text)"),
    "EPOCH": ("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)", "epoch_us(ts)"),
    "K": ("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"),
    "PCT": ("percentile({}, {})", "quantile_cont({}, {})"),
    "DOT": ("aggregate(zip_with(a.v, b.v, (x, y) -> x * y), cast(0 as double), (s, x) -> s + x)", "list_dot_product(a.v, b.v)"),
    "VEC": ("cast(embedding as array<double>)", "cast(embedding as double[])"),
    "HTMLTITLE": ("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)", "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"),
    "HTMLWORDS": (
        "regexp_extract_all(lower(regexp_replace(html, '(?s)<[^>]*>', ' ')), r'[\\p{L}\\p{N}]+', 0)",
        "regexp_extract_all(lower(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g')), '[\\p{L}\\p{N}]+', 0)",
    ),
    "JOINED": ("array_join(array_sort(collect_set({})), ',')", "coalesce(array_to_string(list_sort(list_distinct(list({}))), ','), '')"),
}

#: 95 % quantile of the normal distribution, two-sided.
Z95 = 1.959963984540054


def wilson(hits: str, n: str, sign: str) -> str:
    """SQL for an end of the Wilson interval, clamped to [0, 1]; null for n = 0."""
    z2 = Z95 * Z95
    p = f"({hits}) / cast({n} as double)"
    root = f"sqrt({p} * (1 - {p}) / {n} + {z2} / (4.0 * {n} * {n}))"
    return f"case when {n} = 0 then null else round(least(1.0, greatest(0.0, ({p} + {z2} / (2.0 * {n}) {sign} {Z95} * {root}) / (1 + {z2} / {n}))), 6) end"


def flags(hashes: str, bits: int) -> str:
    """Spark SQL for one row, flags: an array of longs with as many bits, set where one of the hashes (SQL of rows h) falls."""
    words = f"select cast(pmod(h, {bits}) div 64 as int) as at, bit_or(shiftleft(1L, cast(pmod(h, 64) as int))) as word from ({hashes}) x group by cast(pmod(h, {bits}) div 64 as int)"
    return f"select transform(sequence(0, {bits // 64 - 1}), i -> coalesce(m[i], 0L)) as flags from (select map_from_entries(collect_list(struct(at, word))) as m from ({words}) y) z"


def flagged(h: str, bits: int) -> str:
    """Spark SQL for whether the flag of hash h (SQL) is set in flags: false only if no hash equals h."""
    return f"getbit(flags[cast(pmod({h}, {bits}) div 64 as int)], cast(pmod({h}, 64) as int)) = 1"


def dialect(sql: str, which: int) -> str:
    """sql with its placeholders <NAME> or <NAME:argument|argument> in the dialect: 0 Spark, 1 DuckDB."""
    import re

    def put(m: "re.Match[str]") -> str:
        text = DIALECT[m[1]][which]
        return text.format(*m[2].split("|")) if m[2] else text

    return re.sub(r"<([A-Z]+)(?::([^<>]*))?>", put, sql)
