"""The functions by name, in SQL, against the plain functions and stated cases."""

import pytest

from fathom.functions import quantities, registry


@pytest.fixture(scope="module")
def sql(spark):
    assert "parse_quantity" in registry.register(spark)
    return spark.sql


def test_texts(sql):
    got = sql("select fold('Été') as a, words('L''Été 3') as b, term_keys('the voltages of it') as c, identifiers('see EN 50155, da‑p01 and 3.4.2') as d, question_kind('Pourquoi ?') as e, question_kind(null) as f").first()
    assert tuple(got) == ("ete", ["l", "ete", "3"], ["volta"], ["EN 50155", "DA-P01", "3.4.2"], "qualitative", "general")


@pytest.mark.parametrize("text", ["3 V", " −3,5 kV ", "3 uA", "0.125 m", "1,020", "3 to 5 V", "3 mv", "1" * 25, "1e99", "1" + " " * 80, "7", "", "5 °C", None])
def test_parse_quantity(spark, sql, text):
    want = quantities.read_quantity(text)
    got = spark.createDataFrame([(text,)], "t string").selectExpr("parse_quantity(t) as q").first().q
    assert (got.unit, got.refusal) == (want.unit, want.refusal) and (got.value is None) == (want.value is None) and (got.value is None or got.value == want.value)


def test_convert(sql):
    got = sql("select convert_quantity(25, '°C', 'K') as a, convert_quantity(3, 'kV', 'mV') as b, convert_quantity(3, 'V', 'A') as c").first()
    assert (float(got.a), float(got.b), got.c) == (298.15, 3_000_000.0, None)


def test_tables(spark, sql):
    spark.createDataFrame([(1, "A 3.1 b. É c\nd"), (2, None), (3, "")], "id int, t string").createOrReplaceTempView("some_texts")
    got = sql("select id, s.* from some_texts x, lateral sentences_of(x.t) s order by id, place").collect()
    assert [(r.id, r.place, r.start_at, r.end_at, r.sentence) for r in got] == [(1, 0, 0, 8, "A 3.1 b."), (1, 1, 9, 12, "É c"), (1, 2, 13, 14, "d")]
    assert [tuple(x) for x in sql("select reading_numbers('24 V et 1,020') as n").first().n] == [("24", "V", 1), ("1,020", None, 2)]
