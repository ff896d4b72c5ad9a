"""Queries over cells, paths, chained logs and conversations; their oracles, where given, are of another form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType
from pyspark.sql.window import Window

from fathom.functions import quantities
from fathom.functions.arrow import FORMS
from fathom.operators.prose import quoted
from fathom.sources import table, trace

RESULT = StructType().add("value", StringType()).add("unit", StringType()).add("refusal", StringType())

UNITS_OF_LINES = "case l_linenumber % 4 when 0 then 'mV' when 3 then 'kV' else 'V' end"
OPERATION = "case l_orderkey % 5 when 0 then 'sum' when 1 then 'mean' when 2 then 'difference' when 3 then 'ratio' else 'power' end"


@F.pandas_udf(RESULT)
def calculated(operations: pd.Series, operands: pd.Series) -> pd.DataFrame:
    got = []
    for operation, cells in zip(operations, operands):
        r = quantities.calculate(operation, [quantities.Operand(str(c["id"]), c["text"], c["kind"]) for c in cells])
        got.append((r.value, r.unit, r.refusal))
    return pd.DataFrame(got, columns=["value", "unit", "refusal"])


def calculations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operation over the lines of each order as cells. No more operands are gathered than show that there are too many."""
    cells = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.expr(OPERATION).alias("operation"),
        F.expr("case when l_orderkey % 11 = 4 and l_linenumber = 1 then 'boolean' else 'number' end").alias("kind"),
        F.expr(f"concat(cast(cast(l_quantity as int) as string), ' ', case when l_orderkey % 13 = 5 and l_linenumber = 2 then 'm' else {UNITS_OF_LINES} end)").alias("text"),
        F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).alias("nth"),
    )
    some = cells.where(F.col("nth") <= quantities.MAX_OPERANDS + 1)
    held = some.groupBy("l_orderkey", "operation").agg(F.sort_array(F.collect_list(F.struct("nth", F.col("l_linenumber").alias("id"), "kind", "text"))).alias("cells"))
    got = held.select("l_orderkey", "operation", F.size("cells").alias("n"), calculated("operation", "cells").alias("r"))
    return got.select("l_orderkey", "operation", F.col("n").cast("long").alias("n"), F.round(F.col("r.value").cast("double"), 6).alias("value"), "r.unit", "r.refusal")


CALCULATIONS = f"""with cells as (select l_orderkey, {OPERATION} as operation, l_linenumber, cast(cast(l_quantity as int) as decimal(30, 12)) as q, case when l_orderkey % 13 = 5 and l_linenumber = 2 then 'm' else {UNITS_OF_LINES} end as unit,
        l_orderkey % 11 = 4 and l_linenumber = 1 as odd, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as nth from lineitem),
    firsts as (select l_orderkey, unit as own, case unit when 'mV' then 0.001 when 'kV' then 1000 else 1 end as scale from cells where nth = 1),
    read as (select c.*, f.own, cast(q * case unit when 'mV' then 0.001 when 'kV' then 1000 else 1 end / f.scale as decimal(30, 12)) as v from cells c join firsts f on c.l_orderkey = f.l_orderkey),
    sums as (select l_orderkey, operation, own, count(*) as n, count(distinct l_linenumber) as n_ids, sum(v) as total, max(case when nth = 1 then v end) as a, max(case when nth = 2 then v end) as b, bool_or(odd) as odd,
        bool_or(unit = 'm') as other from read group by l_orderkey, operation, own),
    judged as (select *, case when operation = 'power' then 'unsupported_operation' when n > 64 then 'operand_count_limit' when n_ids < n then 'duplicate_operand' when operation in ('difference', 'ratio') and n <> 2 then 'operand_count_mismatch'
        when odd then 'nonnumeric_cell_type' when other and own <> 'm' or other and n > 1 then 'incompatible_units' when operation = 'ratio' and b = 0 then 'division_by_zero' end as refusal from sums)
    select l_orderkey, operation, least(n, 65) as n, case when refusal is null then round(cast(case operation when 'sum' then total when 'mean' then cast(total as double) / n when 'difference' then a - b else cast(a as double) / cast(b as double) end as double), 6) end as value,
        case when refusal is not null then '' when operation = 'ratio' then '' else own end as unit, refusal from judged"""


def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every page's path, behind its host, whether it is a safe relative path; escapes are decoded up to three times."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]*/?(.*)$", 1).alias("path"))
    decoded = F.col("path")
    for _ in range(3):
        decoded = F.coalesce(F.try_url_decode(F.replace(decoded, F.lit("+"), F.lit("%2B"))), decoded)
    seen = F.translate(decoded, "\\", "/")
    rules = (
        ("too_long", F.length("path") > LONGEST_PATH), ("empty", F.col("seen") == ""), ("absolute", F.col("seen").rlike("^(/|[^/]:)")), ("traversal", F.exists("steps", lambda x: x.isin("", ".", ".."))),
        ("ends_in_dot_or_blank", F.exists("steps", lambda x: x.rlike("[. ]$"))), ("forbidden_character", F.col("seen").rlike("[\\x00-\\x1f<>:\"|?*]")),
        ("reserved_name", F.exists("steps", lambda x: F.upper(F.substring_index(x, ".", 1)).isin(*RESERVED))),
    )
    status = F.lit("ok")
    for name, wrong in reversed(rules):
        status = F.when(wrong, name).otherwise(status)
    return pages.withColumn("seen", seen).withColumn("steps", F.split("seen", "/", -1)).select("page_id", "path", status.alias("status"))


# Names that a file can't have, the longest path.
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"{d}{n}" for d in ("COM", "LPT") for n in range(1, 10))]
LONGEST_PATH = 1024

PATH_SAFETY = r"""with paths as (select page_id, regexp_extract(url, '^[a-z]+://[^/]*/?(.*)$', 1) as path from pages), seen as (select *, replace(url_decode(url_decode(url_decode(path))), '\', '/') as p from paths)
    select page_id, path, case when length(path) > 1024 then 'too_long' when p = '' then 'empty' when p[1] = '/' or regexp_matches(p, '^.:') then 'absolute' when regexp_matches(p, '(^|/)(\.|\.\.)?(/|$)') then 'traversal'
        when regexp_matches(p, '[. ](/|$)') then 'ends_in_dot_or_blank' when regexp_matches(p, '[\x00-\x1f<>:"|?*]') then 'forbidden_character' when regexp_matches(p, '(?i)(^|/)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.[^/]*)?(/|$)') then 'reserved_name' else 'ok' end as status from seen"""


def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a chain; some payloads are changed and some events taken out afterwards; what the check finds, by user."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.concat_ws("|", "event_type", "props").alias("payload"))
    kept = trace.chain(events).where("id % 101 <> 7").withColumn("payload", F.when(F.col("id") % 97 == 5, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    found = trace.verify(kept).groupBy(F.col("key").cast("long").alias("user_id"))
    count = lambda s: F.sum((F.col("status") == s).cast("long")).alias(s)
    return found.agg(F.count("*").alias("n"), count("ok"), count("payload_modified"), count("event_modified"), count("chain_broken"))


HASH_CHAIN = """with numbered as (select *, row_number() over (partition by user_id order by ts, event_id) as seq from events), kept as (select *, lag(seq) over (partition by user_id order by seq) as before from numbered where event_id % 101 <> 7),
    judged as (select user_id, event_id % 97 = 5 as changed, coalesce(before, 0) + 1 <> seq as broken from kept)
    select user_id, count(*) as n, count(*) filter (not changed and not broken) as ok, count(*) filter (changed) as payload_modified, 0::bigint as event_modified, count(*) filter (broken and not changed) as chain_broken from judged group by user_id"""


# Words that point back, how many questions are looked at, how many choices are offered.
POINTS_BACK = r"(?i)\b(?:elle|celui|celle|son|sa|ses|leur|its|it|this|that)\b"
EARLIER, CHOICES = 8, 4
IDENTIFIER = "|".join(r"(?<!\w[-_/])" + form for form in FORMS)


def followups(questions: DataFrame) -> DataFrame:
    """questions (scope, at, text) with method and codes: how each is read after the at most EARLIER questions before it in its scope.

    A question with an identifier, or that doesn't point back, stands for itself; else the newest earlier one with identifiers decides:
    one identifier is meant, several are choices, none leaves it open."""
    order = [F.col("at").asc_nulls_first(), "text"]
    named = F.array_distinct(F.transform(F.expr(f"regexp_extract_all(coalesce(text, ''), {quoted(IDENTIFIER)}, 0)"), lambda x: F.upper(F.translate(x, "\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "-------"))))
    before = Window.partitionBy("scope").orderBy(*order).rowsBetween(-EARLIER, -1)
    seen = questions.withColumn("named", named).withColumn("last", F.last(F.when(F.size("named") > 0, F.col("named")), True).over(before))
    explicit = (F.size("named") > 0) | ~F.coalesce(F.col("text").rlike(POINTS_BACK), F.lit(False))
    method = F.when(explicit, "explicit_question").when(F.col("last").isNull(), "no_authorized_referent").when(F.size("last") == 1, "unique_user_referent").otherwise("ambiguous_user_referent")
    codes = F.when(explicit | F.col("last").isNull(), F.array().cast("array<string>")).otherwise(F.slice("last", 1, CHOICES))
    return seen.withColumn("method", method).withColumn("codes", codes).drop("named", "last")


def followup_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each question of a conversation, which is its scope, is read after the questions before it."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("scope"), F.col("turn").alias("at"), "text")
    return followups(asked).select(F.col("scope").alias("conv_id"), F.col("at").alias("turn"), "method", F.array_join("codes", ",").alias("codes"))


#: Earlier messages of the conversation, 24 at most, whose capitalised words are among the present message's: those may be shown.
NAMED = "regexp_extract_all(text, {}'[A-Z][a-z]+', 0)"

QUERIES = {
    "calculations": (calculations, CALCULATIONS),
    "path_safety": (path_safety, PATH_SAFETY),
    "hash_chain_verify": (hash_chain, HASH_CHAIN),
    "followup_resolve": (followup_resolve, None),
    "history_subset": (
        f"""select conv_id, turn, cast(size(filter(earlier, x -> size(array_except(x.named, named)) = 0)) as bigint) as n_allowed, cast(size(earlier) as bigint) as n_earlier from (select conv_id, turn, named,
            collect_list(struct(named)) over (partition by conv_id order by turn, role, text rows between 24 preceding and 1 preceding) as earlier from (select *, array_distinct({NAMED.format('r')}) as named from conversations) c) x""",
        f"""with numbered as (select conv_id, turn, row_number() over (partition by conv_id order by turn, role, text) as r, {NAMED.format('')} as named from conversations),
            words as (select conv_id, r, unnest(named) as w from numbered), pairs as (select a.conv_id, a.r, a.turn, b.r as before from numbered a left join numbered b on b.conv_id = a.conv_id and b.r between a.r - 24 and a.r - 1),
            barred as (select distinct p.conv_id, p.r, p.before from pairs p join words o on o.conv_id = p.conv_id and o.r = p.before where not exists (select 1 from words n where n.conv_id = p.conv_id and n.r = p.r and n.w = o.w))
            select p.conv_id, p.turn, count(p.before) - count(x.before) as n_allowed, count(p.before) as n_earlier from pairs p left join barred x on x.conv_id = p.conv_id and x.r = p.r and x.before = p.before group by p.conv_id, p.r, p.turn""",
    ),
    "fold_search": (
        "select n.needle, count(*) as n, min(d.doc_id) as first_id from documents d join (select distinct upper(n_name) as needle from nation union select distinct upper(source) from documents) n on instr(lower(d.source), lower(n.needle)) > 0 group by n.needle",
        "select needle, count(*) as n, min(doc_id) as first_id from (select d.doc_id, n.needle from documents d, (select distinct upper(n_name) as needle from nation union select distinct upper(source) from documents) n where contains(lower(d.source), lower(n.needle))) x group by needle",
    ),
    "ordered_concat": (
        r"select l_orderkey, sha2(array_join(transform(array_sort(collect_list(struct(l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus))), x -> concat(cast(x.l_partkey as string), x.l_returnflag, x.l_linestatus)), '\n'), 256) as digest, count(*) as n from lineitem group by l_orderkey",
        "select l_orderkey, sha256(string_agg(cast(l_partkey as varchar) || l_returnflag || l_linestatus, chr(10) order by l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus)) as digest, count(*) as n from lineitem group by l_orderkey",
    ),
}
