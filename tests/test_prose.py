"""Sentences, numbers, relations and contracts against stated cases and a plain version over a whole table."""

import re

import pytest
from pyspark.sql import functions as F

from fathom.operators import prose, reading

DATA = "/root/testdata/sf0.001"


def related(spark, *texts, bare=False):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, sentence string")
    return sorted((tuple(r[c] for c in ("i", "form", "low", "high", "unit", "label", "condition_key", "status", "issue", "quote")) for r in prose.relations(rows, bare=bare).collect()), key=str)


def test_relations_of_each_form(spark):
    got = related(
        spark, "Supply voltage of X-1 is between 3 V and 5 V at 25 °C.", "The output is 12 ± 2 V", "Range 3 to 5 kV, absolute maximum", "min 3 V, max 7 V", "La tension est de 1,020 V", "It may be up to 4 A",
        "3 V and 4 V", "at TA = 25 °C, the voltage is 3 V", "entre 5 V et 3 V", "entre 3 V et 5 mV", "Not 3 mA", "Version 2.0", None, "", bare=False,
    )
    assert got == [
        (0, "between", 3.0, 5.0, "V", "Supply voltage of X-1 is", "point|temperature||298.15", "asserted", None, "between 3 V and 5 V"),
        (1, "symmetric", 10.0, 14.0, "V", "The output is", "", "asserted", None, "12 ± 2 V"),
        (10, "single", 3.0, 3.0, "mA", "Not", "", "negated", None, "3 mA"),
        (2, "range", 3.0, 5.0, "kV", "Range", "literal|absolute maximum", "asserted", None, "3 to 5 kV"),
        (3, "labelled", 3.0, 7.0, "V", "", "", "asserted", None, "min 3 V, max 7 V"),
        (4, "single", None, None, "V", "La tension est de", "", "asserted", "ambiguous_decimal_separator", "1,020 V"),
        (5, "single", 4.0, 4.0, "A", "It may be up to", "", "uncertain", "numeric_relation_not_exact", "4 A"),
        (7, "single", 25.0, 25.0, "°C", "at TA =", "literal|the voltage is 3 v", "asserted", None, "25 °C"),
        (7, "single", 3.0, 3.0, "V", "at TA = 25 °C, the voltage is", "point|temperature|TA|298.15", "asserted", None, "3 V"),
    ]


def test_conditions_in_other_units_agree(spark):
    """One point in two units, and one span, have one key."""
    got = related(spark, "5 V at 300 K", "5 V at 26.85 °C", "7 V, from 1 ms to 3 ms", "7 V, from 1000 µs to 3000 µs")
    keys = {r[0]: r[6] for r in got if r[4] == "V"}
    assert keys[0] == keys[1] == "point|temperature||300.0"
    spans = prose.with_condition_key(spark.createDataFrame([("from 1 to 3 ms",), ("1000 – 3000 µs",), ("X",), ("",)], "condition string")).collect()
    assert len({r.condition_key for r in spans}) == 3


def test_bare_numbers(spark):
    assert [(r[0], r[2], r[5]) for r in related(spark, "Version 2.0.", "call +1 (830) 555-6869", "1 and 2", "see 12 % of 3", bare=True)] == [(0, 2.0, "Version"), (3, 3.0, "see 12 % of")]


def test_contract(spark):
    asked = ["What is the maximum supply voltage of X-12 at 25 °C?", "Pourquoi le ciel", "compare voltage and current", "sum of B2 and C3", "Quelle est la plage de tension de AB-1 en mV ?", "voltage and current of X1", None, "What does code AB-1 stand for"]
    got = [tuple(r) for r in prose.contract(spark.createDataFrame([(t,) for t in asked], "text string")).select("kind", "quantities", "operation", "bound", "unit", "subjects", "conditions", "failure").collect()]
    assert got == [
        ("value", ["voltage"], None, "upper", None, ["X-12"], ["at 25 °C"], None), ("qualitative", [], None, None, None, [], [], None), ("comparison", ["current", "voltage"], None, None, None, [], [], None),
        ("calculation", [], "sum", None, None, [], [], None), ("interval", ["voltage"], None, None, "mV", ["AB-1"], [], None), ("general", ["current", "voltage"], None, None, None, [], [], "multiple_quantities_not_decomposed"),
        ("general", [], None, None, None, [], [], None), ("mapping", [], None, None, None, ["AB-1"], [], None),
    ]


def test_numbers(spark):
    text = "Selon EN 50155 (p. 12), le 3e essai du 12/03/2024 donne 24 V, 1 020 h et 5 pour 3.4.2.\n2) puis 7 bar [S12] et 1,020"
    got = spark.createDataFrame([(text,), (None,)], "text string").select(prose.numbers("coalesce(text, '')").alias("n")).collect()
    assert [tuple(x) for x in got[0].n] == [("24", "V", 1), ("1 020", "h", 1), ("5", None, 1), ("7", "bar", 1), ("1,020", None, 2)] and got[1].n == []


def plain_sentences(text):
    at, out = 0, []
    for m in [*re.finditer(r"\n+|(?<=[.!?])\s+(?=[A-ZÀ-Þ])", text), None]:
        piece = text[at : m.start() if m else len(text)]
        if piece.strip():
            a = at + len(piece) - len(piece.lstrip())
            out.append((a, a + len(piece.strip())))
        at = m.end() if m else at
    return out


def test_sentences_of_a_table(spark):
    """Every text's sentences, rows of one doc_id and odd texts among them."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(1, "A b.  C d!\n\n e"), (1, ""), (None, "X. Y"), (2, None), (3, "\ufdd0x. Y")], "doc_id long, text string"))
    got = sorted((str(r.doc_id), r.start_at, r.end_at, r.sentence) for r in prose.sentences(docs).collect())
    want = sorted((str(r.doc_id), a, b, r.text.replace("\ufdd0", " ")[a:b]) for r in docs.collect() if r.text is not None for a, b in plain_sentences(r.text.replace("\ufdd0", " ")))
    assert got == want


def test_relations_of_a_table(spark):
    """Bare numbers and relations of the documents by a plain scan with the same patterns."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = prose.relations(prose.sentences(docs), bare=True).select("doc_id", "start_at", "quote").collect()
    want = []
    for r in docs.collect():
        for a, b in plain_sentences(r.text or ""):
            s = r.text[a:b]
            intervals = [m[0] for m in re.finditer(prose.INTERVAL, s)]
            singles, bare = list(re.finditer(prose.SINGLE, s)), list(re.finditer(prose.BARE, s))
            if not intervals and not singles and len(bare) == 1:
                want.append((r.doc_id, a, bare[0][0]))
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 10


@pytest.mark.parametrize("earlier, text, want", [([], "et sa tension ?", "no_authorized_referent"), (["pour DA-P01", "rien"], "et sa tension ?", "unique_user_referent"), (["DA-P01 ou DA-P02"], "its range", "ambiguous_user_referent"), (["DA-P01"], "la tension ?", "explicit_question"), (["x"], "its EN 50155", "explicit_question")])
def test_followups(spark, earlier, text, want):
    rows = [(1, i, t) for i, t in enumerate([*earlier, text])] + [(2, 0, "DA-P09"), (2, 1, None)]
    got = {(r.scope, r["at"]): r for r in reading.followups(spark.createDataFrame(rows, "scope long, at long, text string")).collect()}
    assert got[1, len(earlier)].method == want and got[1, len(earlier)].codes == {"unique_user_referent": ["DA-P01"], "ambiguous_user_referent": ["DA-P01", "DA-P02"]}.get(want, [])


def test_paths(spark, tmp_path):
    paths = {"a/b.pdf": "ok", "a/%252e%252e/b": "traversal", "/a": "absolute", "C:\\a": "absolute", "a//b": "traversal", "con.txt": "reserved_name", "a.": "ends_in_dot_or_blank", "a?b": "forbidden_character", "a+b%": "ok", "": "empty", "x" * 1025: "too_long"}
    spark.createDataFrame([(i, "http://h/" + p) for i, p in enumerate(paths)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.path: r.status for r in reading.path_safety(spark, str(tmp_path)).collect()} == paths
