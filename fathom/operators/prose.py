"""Free prose as rows: sentences, numbers, measured relations with their conditions, and what a question asks for.

Everything is a Spark expression: a text is cut at the matches of a pattern, pieces keep their order, and offsets are running sums over
the pieces of a row. Offsets are code points, ends exclusive. Null texts have no sentences.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.functions.arrow import FORMS
from fathom.functions.words import ROLES, STOPWORDS, UNIT_ALIASES, UNITS
from fathom.sources import table

OPEN, CLOSE = "\ufdd0", "\ufdd1"  # not characters: no text should hold them; where one does it counts as a blank

# Where a sentence ends.
BREAK = r"(?U)\n+|(?<=[.!?])\s+(?=[A-ZÀ-Þ])"

# Numbers, and what holds digits but no value: identifiers, pages, paragraphs, ranks, dates, citations, numbers of lists.
NUMBER = r"[+\-−–]?\d+(?:[.,]\d+)?"
NO_VALUES = (
    *(r"(?<!\w[-_/])" + form for form in FORMS),
    r"(?i:\b(?:pages?|pp?\.)\s*\d+(?:\s*(?:[-–—/,]|\b(?:et|and|à|to)\b)\s*\d+)*)",
    r"§\s*\d+(?:[.,]\d+)*",
    r"(?<![\w.,])\d+(?i:st|nd|rd|th|er|re|e|è|ème|eme|nde?)s?(?!\w)",
    r"(?<![\w.,/-])(?:\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|\d{4}-\d{1,2}-\d{1,2})(?![\w/-])",
    r"\[S\d+\]",
    r"(?m:^[ \t>*#_-]*\d+[.)](?=\s))",
)
DIGIT = "[0-9]"  # every form of a number holds one
PLAIN = r"(?<![\w.,])(?:\d{1,3}(?:[ \u00a0\u202f]\d{3})+|\d+)(?:[.,]\d+)?(?![.,]?\d)"
UNIT_LIKE = r"[ \u00a0\u202f]?(?:%|‰|°[CF]?|[A-Za-zµΩ]{2,8}[²³]?|[AVWmgshlLKNJT])(?!\w)"
GROUPED = r"^[1-9]\d*[.,]\d{3}(?!\d)"

# Words that stand behind numbers without being units.
NO_UNITS = """à au aux avec ce ces dans de des du en est et la le les ou par pas pour puis qui sans si sont sur un une and are as at by for from in is it
not of on or out per so than that the then to up was were when with""".split()

SPELLINGS = sorted({u for u, *_ in UNITS} | set(UNIT_ALIASES), key=lambda u: (-len(u), u))
UNIT = "(?:" + "|".join(map(re.escape, SPELLINGS)) + r")(?![\w/])"
INTERVALS = {
    "symmetric": rf"({NUMBER})\s*(?:±|\+/-)\s*(\d+(?:[.,]\d+)?)\s*({UNIT})",
    "between": rf"(?i:between|entre|zwischen)\s+({NUMBER})\s*({UNIT})?\s+(?i:and|et|und)\s+({NUMBER})\s*({UNIT})",
    "range": rf"(?<![\w.,])({NUMBER})\s*({UNIT})?\s*(?:(?i:to|à|bis)\s|\.\.\.|…|–|-)\s*({NUMBER})\s*({UNIT})",
    "labelled": rf"(?i:\bmin(?:imum|imal|imale)?\b)[\s:=.]*({NUMBER})\s*({UNIT})[\s,;/]*(?:(?i:and|et|und)\s+)?(?i:\bmax(?:imum|imal|imale)?\b)[\s:=.]*({NUMBER})\s*({UNIT})",
}
INTERVAL = "|".join(INTERVALS.values())
SINGLE = rf"(?<![\w.,±])({NUMBER})\s*({UNIT})"
BARE = rf"(?<![\w.,±+\-/(])(\d+(?:[.,]\d+)?)(?![\w-]|\s*[/)%]|[.,]\d|\s*(?:{UNIT}))"
POINT = rf"^(?i:at|à|bei|for|pour|when|with)?\s*(?:([A-Za-z][A-Za-z0-9_]{{0,15}})\s*=\s*)?({NUMBER})\s*({UNIT})$"
SPAN = rf"^(?i:at|à|bei|for|pour|from|de)?\s*(?:([A-Za-z][A-Za-z0-9_]{{0,15}})\s*=\s*)?({NUMBER})\s*(?:{UNIT})?\s*(?:to|à|bis|–|-)\s*({NUMBER})\s*({UNIT})$"
NOT_EXACT = r"(?i)(?:\b(?:up to|at (?:least|most)|less than|more than|about|approximately|au (?:moins|plus)|jusqu['’]à|environ|mindestens|höchstens|etwa)|[≤≥<>≈~])\s*$"
NEGATED = r"(?i)\b(?:not|never|no|isn['’]t|cannot|nicht|kein\w*|pas|jamais|aucun\w*)\b"
DOUBTFUL = r"(?i)\b(?:may|might|could|perhaps|possibly|estimated|peut[- ]être|environ|vielleicht|estim\w+)\b|[≈~?]"

#: Words of questions and labels that name a quantity.
QUANTITIES = {
    "voltage": "voltage|tension|spannung", "current": "current|courant|strom", "power": "power|puissance|leistung", "frequency": "frequency|fréquence|frequenz",
    "resistance": "resistance|résistance|widerstand", "temperature": "temperature|température|temperatur", "time": "time|duration|durée|délai|dauer|zeit",
    "length": "length|longueur|länge", "pressure": "pressure|pression|druck", "capacitance": "capacitance|capacité|kapazität",
}
OPERATIONS = {"sum": "sum|total|somme|summe", "mean": "mean|average|moyenne|mittel", "ratio": "ratio|rapport|verhältnis", "difference": "difference|différence|differenz|unterschied", "convert": "convert|convertir|umrechnen"}


def quoted(pattern: str) -> str:
    """A pattern as a string of Spark SQL."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def parts_of(text: str, pattern: str) -> str:
    """SQL for the parts of text (SQL) outside and inside the matches of pattern, in turn: the parts of odd index are the matches."""
    return f"split(regexp_replace(translate({text}, '{OPEN}{CLOSE}', '  '), {quoted(pattern)}, '{OPEN}$0{CLOSE}'), '[{OPEN}{CLOSE}]', -1)"


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, row, place, start_at, end_at, sentence) of each text of docs (doc_id, text); row tells rows of one doc_id apart, place counts
    a row's sentences. Sentences stand without the white space around them. A long text's pieces are rows, so no task holds them twice."""
    texts = docs.where("text is not null").select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    rows = texts.select("doc_id", "row", F.expr(f"posexplode({parts_of('text', BREAK)}) as (pos, piece)"))
    piece = rows.select("doc_id", "row", "pos", F.length("piece").alias("size"), F.expr(r"regexp_replace(piece, '(?U)^\\s+|\\s+$', '')").alias("sentence"), F.length(F.expr(r"regexp_extract(piece, '(?U)^\\s*', 0)")).alias("lead"))
    before = Window.partitionBy("row").orderBy("pos")
    placed = piece.withColumn("start_at", F.sum("size").over(before) - F.col("size") + F.col("lead")).where("pos % 2 = 0 and sentence <> ''")
    return placed.select("doc_id", "row", (F.row_number().over(before) - 1).cast("long").alias("place"), "start_at", (F.col("start_at") + F.length("sentence")).alias("end_at"), "sentence")


def numbers(text: str = "text") -> Column:
    """array<struct<number, unit, readings>>: numbers of text outside what holds no value; 1,020 can be read in two ways."""
    return F.expr(numbers_sql(text))


def numbers_sql(text: str) -> str:
    found = f"filter(regexp_extract_all({text}, {quoted('(?:' + '|'.join(NO_VALUES) + ')|(' + PLAIN + '(?:' + UNIT_LIKE + ')?)')}, 1), x -> x <> '')"
    unit = f"regexp_extract(x, {quoted('(' + UNIT_LIKE + ')$')}, 1)"
    words = ", ".join(f"'{w}'" for w in NO_UNITS)
    cut = f"transform({found}, x -> struct(x, trim(translate({unit}, '\u00a0\u202f', '  ')) as u))"
    return f"transform({cut}, y -> struct(regexp_extract(y.x, {quoted(PLAIN)}, 0) as number, if(y.u = '' or lower(y.u) in ({words}), null, y.u) as unit, if(y.x rlike {quoted(GROUPED)}, 2, 1) as readings))"


def with_unit(rows: DataFrame, spelling: str, name: str) -> DataFrame:
    """rows with a struct name<unit, dimension, factor, offset> of the unit that column spelling spells; null where it spells none."""
    known = {u: (u, d, float(f), float(o)) for u, d, f, o in UNITS}
    known |= {a: known[u] for a, u in UNIT_ALIASES.items()}
    listed = rows.sparkSession.createDataFrame([(k, *v) for k, v in known.items()], "_spelling string, unit string, dimension string, factor double, offset double")
    listed = listed.select("_spelling", F.struct("unit", "dimension", "factor", "offset").alias(name))
    return rows.join(listed, rows[spelling] == listed._spelling, "left").drop("_spelling")


def value(text: str) -> str:
    """SQL for a number's value; null where it could be a group of thousands."""
    return f"if({text} rlike {quoted(GROUPED)}, null, cast(translate(replace({text}, ',', '.'), '−–', '--') as double))"


def with_condition_key(rows: DataFrame) -> DataFrame:
    """rows (condition, ...) with condition_key, what two conditions must share to be the same: one point or a span, in base units; else the words."""
    get = lambda pattern, n: F.regexp_extract("condition", pattern, n)
    kind = F.when(F.col("condition") == "", "").when(F.col("condition").rlike(POINT), "point").when(F.col("condition").rlike(SPAN), "span").otherwise("literal")
    cut = rows.withColumn("_kind", kind).withColumns({f"_{c}": F.when(F.col("_kind") == "span", get(SPAN, n)).otherwise(get(POINT, m)) for c, n, m in (("symbol", 1, 1), ("from", 2, 2), ("to", 3, 2), ("unit", 4, 3))})
    cut = with_unit(cut, "_unit", "_w")
    base = lambda c: f"round({value(c)} * _w.factor + _w.offset, 9)"
    key = F.expr(f"case _kind when '' then '' when 'literal' then concat('literal|', lower(condition)) when 'point' then concat_ws('|', 'point', _w.dimension, _symbol, {base('_from')}) else concat_ws('|', 'span', _w.dimension, _symbol, {base('_from')}, {base('_to')}) end")
    return cut.withColumn("condition_key", key).drop("_kind", "_symbol", "_from", "_to", "_unit", "_w")


def relations(lines: DataFrame, text: str = "sentence", bare: bool = False) -> DataFrame:
    """Measured relations of lines: their columns and (kind, form, low, high, unit, quantity, base_low, base_high, label, role, condition,
    condition_key, status, issue, rel_start, rel_end, quote).

    A line's intervals count: symmetric, between two values, a range, or a labelled minimum and maximum; both ends must have one unit, and the
    lower must come first. Where it has none, its single measure of a quantity counts, if there is only one of that quantity. bare: without
    any unit, a number that stands alone is a value of the quantity ''. label is the clause before the match, condition what
    stands between the match and the clause's end, and before it behind "at" or a comma. A number like 1,020 gives no value but an issue.
    """
    kept = lines.columns
    forms = [("interval", INTERVAL), ("single", SINGLE), *([("bare", BARE)] if bare else [])]
    parts = {name: F.expr(parts_of(text, pattern)) for name, pattern in forms}
    chosen = F.when(F.size(parts["interval"]) > 1, F.struct(F.lit("interval").alias("form"), parts["interval"].alias("parts")))
    chosen = chosen.when(F.size(parts["single"]) > 1, F.struct(F.lit("single").alias("form"), parts["single"].alias("parts")))
    if bare:
        chosen = chosen.when(F.size(parts["bare"]) == 3, F.struct(F.lit("bare").alias("form"), parts["bare"].alias("parts")))
    cut = lines.where(F.col(text).rlike(DIGIT)).withColumn("_c", chosen).where("_c is not null")
    at = cut.select(*kept, F.col("_c.form").alias("_form"), F.col("_c.parts").alias("_parts"), F.expr("explode(filter(sequence(0, size(_c.parts) - 1), i -> i % 2 = 1))").alias("_i"))
    at = at.select(*kept, "_form", F.expr("_parts[_i]").alias("quote"), F.expr("array_join(slice(_parts, 1, _i), '')").alias("_before"), F.expr("array_join(slice(_parts, _i + 2, size(_parts)), '')").alias("_after"))
    named = "case " + " ".join(f"when _form = 'interval' and quote rlike {quoted('^(?:' + p + ')$')} then '{n}'" for n, p in INTERVALS.items()) + " else _form end"
    patterns = [*INTERVALS.items(), ("single", SINGLE), ("bare", BARE)]
    groups = {"_a": (1, 1, 1, 1, 1, 1), "_b": (2, 3, 3, 3, 1, 1), "_ua": (3, 2, 2, 2, 2, 0), "_ub": (3, 4, 4, 4, 2, 0)}
    pick = {c: "case f.form " + " ".join(f"when '{n}' then regexp_extract(quote, {quoted(p)}, {g})" for (n, p), g in zip(patterns, gs, strict=True) if g) + " else '' end" for c, gs in groups.items()}
    let = f"inline(transform(array(struct({named} as form)), f -> struct(f.form as form, {', '.join(f'{e} as {c}' for c, e in pick.items())})))"  # the form is found once
    read = at.select(*kept, "quote", "_before", "_after", F.expr(let))
    read = with_unit(with_unit(read.withColumn("_ua", F.expr("if(_ua = '', _ub, _ua)")), "_ub", "_u"), "_ua", "_v").withColumns({"_x": F.expr(value("_a")), "_y": F.expr(value("_b"))})
    ends = {"low": "if(form = 'symmetric', _x - _y, _x)", "high": "if(form = 'symmetric', _x + _y, _y)"}
    read = read.withColumns({c: F.expr(e) for c, e in ends.items()}).where("(_u.unit <=> _v.unit) and (low <= high or low is null or high is null)")
    clause = F.expr(r"regexp_extract(_before, '(?s)(?:^|.*[;.,:]\\s)(.*)$', 1)")
    tail = F.expr(r"regexp_extract(_after, '^([^;.]*(?:\\.\\d[^;.]*)*)', 1)")
    lead = F.expr(r"regexp_extract(_before, '(?i)(?:^|[,;(]\\s*)((?:at|à|bei)\\s+[^;]*?),\\s+[^;]*$', 1)")
    condition = F.trim(F.regexp_replace(F.when(F.trim(lead) != "", lead).otherwise(tail), r"^[\s,()]+|[\s,()]+$", ""))
    role = F.expr("case " + " ".join(f"when lower(concat(_clause, ' ', _tail)) rlike {quoted(chr(92) + 'b(?:' + '|'.join(words) + ')' + chr(92) + 'b')} then '{r}'" for r, words in ROLES.items()) + " end")
    line = F.concat("_before", "quote", "_after")
    full = read.withColumns({"_clause": clause, "_tail": tail}).withColumns({"label": F.trim("_clause"), "condition": condition, "role": role})
    full = full.withColumns(
        {
            "kind": F.when(F.col("form").isin(*INTERVALS), "interval").otherwise("value"),
            "unit": F.coalesce("_u.unit", F.lit("")),
            "quantity": F.coalesce("_u.dimension", F.lit("")),
            "base_low": F.expr("coalesce(low * _u.factor + _u.offset, low)"),
            "base_high": F.expr("coalesce(high * _u.factor + _u.offset, high)"),
            "status": F.when(line.rlike(NEGATED), "negated").when(line.rlike(DOUBTFUL), "uncertain").otherwise("asserted"),
            "issue": F.when(F.col("low").isNull() | F.col("high").isNull(), "ambiguous_decimal_separator").when(F.col("_before").rlike(NOT_EXACT), "numeric_relation_not_exact"),
            "rel_start": F.length("_before"),
            "rel_end": F.length("_before") + F.length("quote"),
        }
    )
    full = with_condition_key(full)
    of_one = Window.partitionBy(*(F.col(c) for c in kept), "quantity")
    alone = full.withColumn("_n", F.when(F.col("form") == "single", F.count("*").over(of_one)).otherwise(1)).where("_n = 1")
    names = "kind form low high unit quantity base_low base_high label role condition condition_key status issue rel_start rel_end quote".split()
    return alone.select(*kept, *names)


def contract(questions: DataFrame, text: str = "text") -> DataFrame:
    """questions with what each asks for: kind, quantities, operation, role, bound, unit, subjects, conditions, and failure.

    The first of these kinds that fits: qualitative (why, under what conditions, or what without anything measured), calculation, interval,
    comparison, mapping, value (one quantity), general. Several quantities that nothing takes apart are a failure."""
    return questions.select("*", F.expr(f"inline({contract_sql(text)})"))


def contract_sql(text: str) -> str:
    """SQL for an array of one struct, the contract of text (SQL)."""
    q = f"lower(coalesce({text}, ''))"
    has = lambda words: f"{q} rlike {quoted(r'(?<!\w)(?:' + words + r')(?!\w)')}"


    def listed(table: dict[str, str]) -> str:
        words = {w: n for n, ws in table.items() for w in ws.split("|")}
        known = "map(" + ", ".join(f"'{w}', '{n}'" for w, n in words.items()) + ")"
        return f"sort_array(array_distinct(transform(regexp_extract_all({q}, {quoted(r'(?<!\w)(?:' + '|'.join(words) + r')(?!\w)')}, 0), w -> element_at({known}, w))))"

    digits = f"array_distinct(filter(regexp_extract_all(coalesce({text}, ''), {quoted(r'[\w][\w./-]*[\w]|[\w]')}, 0), x -> x rlike '[0-9]' and x rlike '[A-Za-z]' and not x rlike {quoted('^[A-Z]{1,3}[1-9][0-9]{0,6}$')} and not x rlike {quoted('^[0-9.,]+(?:' + UNIT + ')$')}))"
    points = f"transform(regexp_extract_all(coalesce({text}, ''), {quoted(rf'(?<!\w)(?i:at|à|bei|for|pour)\s+(?:[A-Za-z]\w{{0,15}}\s*=\s*)?{NUMBER}\s*{UNIT}')}, 0), x -> trim(x))"
    why, what = has("why|pourquoi|warum|under what conditions|sous quelles conditions|unter welchen"), has("what is|what are|quel est|quelle est|quels sont|quelles sont|was ist")
    low, high = has("min|minimum|minimal|minimale|least|lowest"), has("max|maximum|maximal|maximale|most|highest")
    read = {
        "quantities": listed(QUANTITIES), "operation": f"get({listed(OPERATIONS)}, 0)", "subjects": digits, "conditions": points, "bound": f"case when {low} and {high} then 'both' when {low} then 'lower' when {high} then 'upper' end",
        "role": "case " + " ".join(f"when {has('|'.join(words))} then '{r}'" for r, words in ROLES.items()) + " end", "unit": f"nullif(regexp_extract(coalesce({text}, ''), {quoted(rf'(?<!\w)(?i:in|en)\s+({UNIT})')}, 1), '')",
    }
    kind = f"""case when {why} or ({what} and size(r.quantities) = 0 and r.operation is null and size(r.conditions) = 0) then 'qualitative' when r.operation is not null and r.operation <> 'difference' then 'calculation'
        when size(r.quantities) > 0 and {has('range|between|interval|plage|entre|intervalle|bereich|zwischen')} then 'interval' when {has('compare|comparison|difference|versus|vs|comparer|différence|vergleich')} then 'comparison'
        when {has('code|mapping|maps?|means|signifie|bedeutet')} and size(r.subjects) > 0 then 'mapping' when size(r.quantities) = 1 then 'value' else 'general' end"""
    failure = "case when size(k.quantities) > 1 and k.kind not in ('comparison', 'qualitative') then 'multiple_quantities_not_decomposed' end"
    first = "struct(" + ", ".join(f"{e} as {n}" for n, e in read.items()) + ")"
    second = "struct(" + ", ".join(f"r.{n} as {n}" for n in read) + f", {kind} as kind)"
    third = "struct(" + ", ".join(f"k.{n} as {n}" for n in [*read, "kind"]) + f", {failure} as failure)"
    return f"transform(transform(array({first}), r -> {second}), k -> {third})"  # each value is computed once


def q_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every text, with their offsets in it."""
    return sentences(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "place", "start_at", "end_at", F.sha2("sentence", 256).alias("digest"))


#: The same by marking the places where a capital follows; a line break ends a sentence by itself.
SENTENCES = r"""with cut as (select doc_id, string_split(regexp_replace(text, '(\n+)|([.!?])(\s+)([A-ZÀ-Þ])', '\1\2\3' || chr(64976) || '\4', 'g'), chr(64976)) as parts from documents where text is not null),
    pieces as (select doc_id, generate_subscripts(parts, 1) as pos, unnest(parts) as piece from cut),
    placed as (select doc_id, pos, regexp_replace(piece, '^\s+|\s+$', '', 'g') as s, length(regexp_extract(piece, '^\s*', 0)) + sum(length(piece)) over (partition by doc_id order by pos) - length(piece) as start_at from pieces)
    select doc_id, row_number() over (partition by doc_id order by pos) - 1 as place, start_at::bigint as start_at, (start_at + length(s))::bigint as end_at, sha256(s) as digest from placed where s <> ''"""


def q_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of every text outside identifiers, pages, dates and the like: how many, with a unit, with two readings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", numbers("coalesce(text, '')").alias("n"))
    count = lambda test: F.size(F.filter("n", test)).cast("long")
    return docs.select("doc_id", F.size("n").cast("long").alias("n_numbers"), count(lambda x: x["unit"].isNotNull()).alias("n_units"), count(lambda x: x["readings"] > 1).alias("n_ambiguous"))


def q_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of every sentence of the documents and of the conversations' turns."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    talks = table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.lit("c"), "conv_id", "turn").alias("doc_id"), "text")
    texts = docs.union(talks).where(F.col("text").rlike(DIGIT))  # others have no relation, so their sentences need no places
    got = relations(sentences(texts).drop("row"), bare=True)
    return got.select("doc_id", "place", "kind", "form", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "unit", "label", "condition_key", "status", "issue", (F.col("start_at") + F.col("rel_start")).cast("long").alias("start_at"), "quote")


def q_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every turn of a user and every benchmark passage asks for."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws(":", F.lit("c"), "conv_id", "turn").alias("id"), "text")
    got = contract(asked.union(table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")), "text")))
    return got.select("id", "kind", F.array_join("quantities", ",").alias("quantities"), "operation", "bound", "role", "unit", F.array_join("subjects", ",").alias("subjects"), F.array_join("conditions", ",").alias("conditions"), "failure")


#: Words of a question that only name its scope.
SCOPE_WORDS = """document documents dossier dossiers fichier fichiers page pages pdf perimetre selection selectionne selectionnee selectionnes selectionnees
file files folder folders scope selected""".split()


def q_answer_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of every benchmark text as a question, outside its identifiers: first five letters of the words of three or more."""
    outside = F.regexp_replace("text", "|".join(r"(?<!\w[-_/])" + form for form in FORMS), " ")
    folded = F.translate(F.lower(outside), "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    words = F.expr(r"regexp_extract_all(w, '[\\p{L}\\p{N}]+', 0)")
    terms = table(spark, sf_dir, "benchmark").select("item_id", folded.alias("w")).select("item_id", F.explode(words).alias("word")).where((F.length("word") >= 3) & ~F.col("word").isin(*STOPWORDS, *SCOPE_WORDS))
    return terms.select("item_id", F.substring("word", 1, 5).alias("term")).distinct()


QUERIES = {
    "sentences": (q_sentences, SENTENCES),
    "number_readings": (q_numbers, None),
    "prose_relations": (q_relations, None),
    "question_contract": (q_contract, None),
    "answer_terms": (q_answer_terms, None),
}
