"""Questions count with all their words, and the hybrid search with both lanes."""

import duckdb
import pytest

from fathom import plans

SHORT, WHOLE = 30, 500
NAMES = ["bm25_scoped_corpus", "bm25_topk", "comparison_round_robin", "coverage_selection", "hybrid_dense_scoped", "mrr_at_10", "q_hybrid_search", "recall_at_k", "rrf_fusion", "scope_isolation"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One passage of 104 words. SHORT documents hold its first 64 and nothing else; one holds it whole, the last and longest."""
    path = tmp_path_factory.mktemp("long")
    head, tail = (" ".join(f"{w}{i}" for i in range(n)) for w, n in (("first", 64), ("later", 40)))
    docs = [(i, head, "de") for i in range(SHORT)] + [(i, f"other{i} thing", "de") for i in range(SHORT, 120)] + [(WHOLE, f"{head} {tail}", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1,)], "p_partkey long").write.parquet(str(path / "part.parquet"))  # register sees its name in "partition"
    spark.createDataFrame([(1, f"{head} {tail}")], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def rows_of(got):
    return [r.asDict() for r in got.collect()]


@pytest.mark.parametrize("name", NAMES)
def test_words_behind_the_first_64_count(spark, folder, name):
    rows = rows_of(plans.queries()[name](spark, folder))
    if name == "scope_isolation":
        assert rows == [{"item_id": 1, "kept_after": 1, "kept_before": 1}]
    elif name in ("mrr_at_10", "recall_at_k"):
        assert [r["mrr" if name == "mrr_at_10" else "recall"] for r in rows] == [1.0]
    else:
        found = [r for r in rows if r["doc_id"] == WHOLE]
        assert len(found) == 1 and found[0].get("place", 1) == 1 and found[0].get("lexical", 1) == 1
        if name == "bm25_scoped_corpus":
            alone = [r for r in rows if r["doc_id"] == WHOLE]
            assert alone[0]["score"] == pytest.approx(104e-6, abs=1e-6)  # alone in its language: every word weighs 1e-6


@pytest.mark.parametrize("name", sorted(set(NAMES) & set(plans.oracles())))
def test_long_questions_against_duckdb(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = con.sql(plans.oracles()[name])
    rounded = lambda rows: sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows)
    assert rounded(tuple(r[c] for c in want.columns) for r in rows_of(plans.queries()[name](spark, folder))) == rounded(want.fetchall())


def test_hybrid_search_fuses_words_and_vectors(spark):
    """No passage there has more than 64 words, so the search with the lanes' marks gives the same documents in the same order."""
    data = "/root/testdata/sf0.001"
    got, marked = (plans.queries()[n](spark, data).select("item_id", "doc_id", "score", "place") for n in ("q_hybrid_search", "hybrid_dense"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, marked.collect()))
