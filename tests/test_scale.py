"""What grows with the tables stays out of broadcasts, of single tasks and of rows for all pairs."""

import contextlib
import io

import pytest

from fathom import plans

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_probes_of_fingerprints_are_not_broadcast(spark):
    pytest.importorskip("fathom.llm.simhash")
    from fathom.llm import simhash
    from fathom.llm.common import saved

    reps = saved(spark.createDataFrame([(1, 0), (2, 7), (3, 15), (4, 1 << 40)], "id long, fp long"), "reps")
    got = simhash.links(reps)
    assert "Broadcast" not in plan(got)
    assert {tuple(r) for r in got.collect()} == {(1, 2), (1, 4), (2, 3)}


@pytest.mark.parametrize("name", ["alias_fallback", "mandatory_evidence"])
def test_words_of_sentences_are_not_broadcast(spark, name):
    import re

    text = plan(plans.queries()[name](spark, DATA))
    assert not re.search(r"BroadcastHashJoin \[(word|code)#\d+\], \[(word|code)#\d+\], (Inner|LeftOuter), BuildRight", text)


def test_tables_continue_across_ranges(spark, tmp_path):
    spark.read.parquet(f"{DATA}/part.parquet").write.parquet(str(tmp_path / "part.parquet"))  # register sees its name in "partition"
    keys = [9899, 9990, 9999, 10000, 10019, 10040, 20005, -5, 12]
    spark.createDataFrame([(k, "A", "F") for k in keys], "l_orderkey long, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = plans.queries()["table_continuation"](spark, str(tmp_path))
    assert "SinglePartition" not in plan(got)
    assert {r.l_orderkey for r in got.collect() if r.continued} == {9999, 10000, 10019, 12}


def test_overlaps_make_no_row_for_each_pair(spark, tmp_path):
    rows = [(i, "b", 5, 900.0) for i in range(300)] + [(300, "b", 14, 999.99), (301, "b", 15, 900.0), (302, "b", 5, 1000.0), (303, None, 5, 900.0)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.id: (r.class_id, r.n_links, r.overlap) for r in plans.queries()["box_overlap"](spark, str(tmp_path)).collect()}
    assert got[7] == (0, 300, 299.00001) and got[300] == (300, 302, 0.10308) and got[303] == (303, 0, 0.0) and len(got) == 304


def test_best_keeps_few_rows_of_all_pairs(spark):
    from fathom.operators import retrieval

    rows = [(i, ["en" if i % 2 else "de"], [(1, 1 + i % 3, 10), (2, 1, 10)][: 1 + i % 2]) for i in range(500)]
    lists = spark.createDataFrame(rows, "doc_id long, langs array<string>, held array<struct<term:long,tf:long,size:long>>").coalesce(1)
    asked = spark.createDataFrame([(7, 1, 0.5, 12.0), (7, 2, 0.25, 12.0), (8, 2, 1.0, 12.0), (9, 3, 1.0, 12.0)], "item_id long, term long, rate double, mean double")
    got = retrieval.best(lists, asked, 3, docs=64).collect()
    weigh = lambda held, rates: round(sum(rates[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * s / 12)) for t, f, s in held if t in rates), 6)
    assert len(got) <= 3 * 2 * 2 * 2
    for item, rates in {7: {1: 0.5, 2: 0.25}, 8: {2: 1.0}}.items():
        for lang in ("en", "de"):
            all_ = [(-weigh(h, rates), d, sum(t in rates for t, _, _ in h)) for d, of, h in rows if lang in of and any(t in rates for t, _, _ in h)]
            mine = sorted((-r.score, r.doc_id, r.n) for r in got if r.item_id == item and r.lang == lang)
            assert [x[1:] for x in mine][:3] == [x[1:] for x in sorted(all_)][:3]
            assert {(-n, d) for _, d, n in mine} >= set(sorted((-n, d) for _, d, n in all_)[:3])


def test_nearest_vectors_are_multiplied_in_blocks(spark, tmp_path):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (51, [0.5, 0.5]), (52, None), (53, [None, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    df = plans.queries()["dense_topk"](spark, str(tmp_path))
    assert "MapInArrow" in plan(df)
    assert [tuple(r) for r in df.orderBy("query_id", "place").collect()] == [(0, 51, 0.5, 1), (0, 50, 0.0, 2), (0, 52, None, 3), (0, 53, None, 4), (50, 51, 0.5, 1), (50, 0, 0.0, 2), (50, 52, None, 3), (50, 53, None, 4)]


def test_index_has_a_row_for_each_document(spark):
    """Postings are arrays of a document's row, counted without an aggregation by word; rows of one doc_id and lang are one document."""
    from fathom.sources import postings

    rows = [(1, "en", "b a b"), (1, "en", "a c"), (1, "de", "a"), (2, None, "x"), (3, "en", ""), (4, "en", None)]
    index = postings.build(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3))
    lists = {(r.doc_id, r.lang): r for r in spark.table(index.lists).collect()}
    assert len(lists) == 5 and lists[1, "en"].n == 2 and lists[1, "en"].total == 5 and lists[3, "en"].terms == []
    got = {tuple(r) for r in spark.table(index.postings).collect()}
    assert got == {(1, "en", "a", 2, 3), (1, "en", "b", 2, 3), (1, "en", "c", 1, 2), (1, "de", "a", 1, 1), (2, None, "x", 1, 1)}
    assert tuple(spark.table(index.whole).first()) == (6, 7 / 6)


def test_second_search_reads_only_the_questions_words_of_first_documents():
    from fathom.operators import retrieval

    assert retrieval.HAD in retrieval.COMPLEMENT.format(terms="t", held="held", weight="0") and "array_intersect(q.terms, p.terms)" in retrieval.HAD_OWN


def test_flags_lose_no_hash(spark):
    """What begins a run that is asked for is flagged, so only such runs are written out (recall_at_k, mrr_at_10, claim_support)."""
    from fathom.functions import flagged, flags

    one = spark.sql(flags("select xxhash64(id) as h from range(50)", 1024))
    got = spark.range(2000).crossJoin(one).selectExpr("id", f"{flagged('xxhash64(id)', 1024)} as f").where("f").collect()
    assert {r.id for r in got} >= set(range(50)) and len(got) < 400
    none = spark.sql(flags("select xxhash64(id) as h from range(0)", 1024))
    assert not spark.range(50).crossJoin(none).selectExpr(f"{flagged('xxhash64(id)', 1024)} as f").where("f").count()
