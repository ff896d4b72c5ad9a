"""Functions of this library by name, for SQL: temporary SQL functions and table functions of a session, all of built-in expressions.

    fold(text) -> string                     lower case without accents (Latin letters)
    words(text) -> array<string>             runs of letters and digits of the folded text
    term_keys(text) -> array<string>         first five letters of the words of three or more that carry content
    identifiers(text) -> array<string>       standards, compounds, letters with digits, dotted numbers; upper case, plain dashes
    parse_quantity(text) -> struct<value decimal(38,12), unit, refusal>    one number with a known unit or none, or why not
    convert_quantity(value, source, target) -> decimal(38,12)            null between dimensions
    reading_numbers(text) -> array<struct<number, unit, readings>>       see ``prose.numbers``
    sentences_of(text) -> table(place, start_at, end_at, sentence)       see ``prose.sentences``; for lateral joins
    question_kind(text) -> string                                         see ``prose.contract``
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from fathom.functions import dialect
from fathom.functions.arrow import FORMS
from fathom.functions.words import STOPWORDS, UNIT_ALIASES, UNITS, sql_list

MAX_CHARACTERS, MAX_DIGITS = 80, 24
FOLDED = "translate(lower({}), 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def unit_map() -> str:
    known = {u: (u, d, f, o) for u, d, f, o in UNITS} | {"": ("", "number", "1", "0")}
    known |= {a: known[u] for a, u in UNIT_ALIASES.items()}
    return "map(" + ", ".join(f"'{k}', named_struct('unit', '{u}', 'dimension', '{d}', 'factor', cast({f} as double), 'offset', cast({o} as double))" for k, (u, d, f, o) in known.items()) + ")"


def bodies() -> dict[str, str]:
    """name(arguments) returns -> body."""
    from fathom.operators import prose  # registers what the operators are made of

    number = r"^\s*([+\-−–]?[0-9]+(?:[.,][0-9]+)?(?:[eE][+\-]?[0-9]{1,2})?)\s*(" + prose.UNIT.removesuffix(r"(?![\w/])") + r")?\s*$"
    raw = f"translate(regexp_extract(t, {quoted(number)}, 1), '−–', '--')"
    digits = f"length(regexp_replace({raw}, '[^0-9]', ''))"
    grouped = f"{raw} rlike {quoted(r'^[+-]?[1-9][0-9]*[.,][0-9]{3}$')}"
    refusal = f"""case when t is null or length(t) > {MAX_CHARACTERS} then 'numeric_value_limit' when not t rlike {quoted(number)} then 'not_a_single_quantity' when {grouped} then 'ambiguous_decimal_separator'
        when {digits} > {MAX_DIGITS} or abs(try_cast(replace({raw}, ',', '.') as double)) >= 1e25 then 'numeric_value_limit' end"""
    unit = f"element_at({unit_map()}, regexp_extract(t, {quoted(number)}, 2)).unit"
    code = quoted("|".join(r"(?<!\w[-_/])" + form for form in FORMS))
    base = "(value * {m}[source].factor + {m}[source].offset - {m}[target].offset) / {m}[target].factor".format(m=unit_map())
    spans = f"""select row_number() over (order by pos) - 1 as place, start_at, start_at + length(sentence) as end_at, sentence from (select pos, regexp_replace(piece, {quoted(r'(?U)^\s+|\s+$')}, '') as sentence,
        cast(sum(length(piece)) over (order by pos) - length(piece) + length(regexp_extract(piece, {quoted(r'(?U)^\s*')}, 0)) as bigint) as start_at, pos % 2 as odd
        from posexplode({prose.parts_of('t', prose.BREAK)}) as p(pos, piece)) x where odd = 0 and sentence <> ''"""
    return {
        "fold(t string) returns string": FOLDED.format("t"),
        "words(t string) returns array<string>": dialect("<FOLDED:coalesce(t, '')>", 0),
        "term_keys(t string) returns array<string>": f"array_distinct(transform(filter({dialect(chr(60) + 'FOLDED:coalesce(t, ' + chr(39) * 2 + ')' + chr(62), 0)}, w -> length(w) >= 3 and w not in ({sql_list(STOPWORDS)})), w -> substring(w, 1, 5)))",
        "identifiers(t string) returns array<string>": f"array_distinct(transform(regexp_extract_all(translate(coalesce(t, ''), '‐‑‒–—―−', '-------'), {code}, 0), x -> upper(x)))",
        "parse_quantity(t string) returns struct<value: decimal(38,12), unit: string, refusal: string>": f"named_struct('value', case when {refusal} is null then try_cast(replace({raw}, ',', '.') as decimal(38,12)) end, 'unit', case when {refusal} is null then {unit} else '' end, 'refusal', {refusal})",
        "convert_quantity(value decimal(38,12), source string, target string) returns decimal(38,12)": f"case when {unit_map()}[source].dimension = {unit_map()}[target].dimension then cast(round({base}, 12) as decimal(38,12)) end",
        "reading_numbers(t string) returns array<struct<number: string, unit: string, readings: int>>": prose.numbers_sql("coalesce(t, '')"),
        "question_kind(t string) returns string": f"element_at({prose.contract_sql('t')}, 1).kind",
        "sentences_of(t string) returns table(place bigint, start_at bigint, end_at bigint, sentence string)": spans,
    }


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; returns their names."""
    names = []
    for signature, body in bodies().items():
        spark.sql(f"create or replace temporary function {signature} return {body}")
        names.append(signature.partition("(")[0])
    return names
