"""What round 3's findings named as growing too fast: work on texts that can't count, whole sorts, counts of many documents in one task."""

import contextlib
import io

import pytest
from fathom import plans
from fathom.functions import arrow
from fathom.operators import prose

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_question_set_sorts_no_category_whole(spark):
    text = plan(plans.queries()["question_set_build"](spark, DATA))
    assert text.count("TakeOrderedAndProject") == 4


def test_overlap_is_counted_where_documents_lie(spark):
    text = plan(plans.queries()["lexical_overlap"](spark, DATA))
    assert "REPARTITION_BY_NUM" in text and "hashpartitioning(term" not in text.split("REPARTITION_BY_NUM")[0]
    assert "hashpartitioning(item_id" not in text


@pytest.mark.parametrize("text", ["from 3 V to 5 V", "min. 2 mA, max. 4 mA", "12", "± 3 V", "no number", "", None])
def test_relations_need_a_digit(spark, text):
    lines = spark.createDataFrame([(1, text)], "doc_id long, sentence string")
    got = prose.relations(lines, bare=True)
    assert not got.count() or any(c.isdigit() for c in text)
    assert "RLIKE" in plan(got).split("Generate")[-1]


def test_relations_cut_no_text_without_digits(spark):
    lines = plan(plans.queries()["prose_relations"](spark, DATA)).splitlines()
    scans = [n for n, line in enumerate(lines) if "FileScan" in line]
    assert scans and all("[0-9]" in "".join(lines[n - 3 : n]) for n in scans)


def test_batches_of_identifiers_are_bounded(spark):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    for query in ("identifiers_extract", "chunk_plan"):
        for name in names:
            spark.conf.unset(name)
        plans.queries()[query](spark, DATA)
        assert [int(spark.conf.get(n)) for n in names] == [arrow.BATCH_ROWS, arrow.BATCH_BYTES]
