"""The stored postings, the vectors and the searches over them, against plain computation."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom import api
from fathom.operators import retrieval
from fathom.sources import postings


def docs_of(spark, seed=1, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    rows = [(i, r.choice(["en", "de"]), " ".join(r.choice(vocab) for _ in range(r.randint(1, 30)))) for i in range(n)]
    return rows + [(900, "en", None), (901, "en", ""), (902, "en", "Étoile, étoile w1!")]


def test_index(spark):
    rows = docs_of(spark)
    index = postings.build(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)).dense(spark)
    want = {(i, t): n for i, _, text in rows for t, n in Counter(re.findall(r"[^\W_]+", (text or "").lower().replace("é", "e"))).items()}
    got = spark.table(index.postings).collect()
    assert {(p.doc_id, p.term): p.tf for p in got} == want and len(got) == len(want)
    df = Counter(t for _, t in want)
    assert {t.term: t.df for t in spark.table(index.terms).collect()} == df
    assert tuple(spark.table(index.whole).first())[0] == len(rows)
    vectors = {v.doc_id: np.array(v.vector) for v in spark.table(index.vectors).collect()}
    assert 900 not in vectors and 901 not in vectors and all(abs(v @ v - 1) < 1e-9 for v in vectors.values())
    axes = {t.term: (t.axis, t.sign) for t in spark.table(index.terms).collect()}
    plain = np.zeros(postings.AXES)
    for (i, t), tf in want.items():
        if i == 902:
            plain[axes[t][0]] += axes[t][1] * (1 + math.log(tf)) * math.log(1 + len(rows) / df[t])
    assert np.allclose(vectors[902], plain / np.linalg.norm(plain))


def test_index_needs_no_shuffle_to_score(spark):
    """Scores are summed where the postings lie: between the postings and the sum there is no exchange."""
    postings.build(spark.createDataFrame(docs_of(spark), "doc_id long, lang string, text string")).views(spark)
    spark.createDataFrame([(1, "w1 w2")], "item_id long, text string").createOrReplaceTempView("benchmark")
    from fathom.functions import dialect

    plan = spark.sql(dialect(retrieval.INDEXED, 0) + " select item_id, doc_id, score from scored")._jdf.queryExecution().executedPlan().toString()
    before = plan[: plan.index("fathom_postings")]
    last = before.rsplit("HashAggregate", 1)[1]
    assert "Bucketed: true" in plan and "Exchange" not in last.split("BroadcastExchange")[0]


def test_index_is_kept_while_files_stay(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(docs_of(spark), "doc_id long, lang string, text string").coalesce(1).write.parquet(path)
    first = postings.of(spark, spark.read.parquet(path))
    assert postings.of(spark, spark.read.parquet(path)) == first and first.vectors is None
    assert postings.of(spark, spark.read.parquet(path), dense=True).postings == first.postings and postings.of(spark, spark.read.parquet(path)).vectors
    spark.createDataFrame([(1000, "en", "more")], "doc_id long, lang string, text string").write.mode("append").parquet(path)
    second = postings.of(spark, spark.read.parquet(path))
    assert second != first and spark.table(second.postings).where("doc_id = 1000").count() == 1


@pytest.mark.parametrize("block", [3, 16, 4096])
def test_nearest(spark, block):
    """Every block size gives the same first k, ties by doc_id."""
    r = np.random.default_rng(block)
    q, d = r.integers(-2, 3, (7, 4)).astype(float), r.integers(-2, 3, (50, 4)).astype(float)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "item_id long, vector array<double>")
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], "doc_id long, vector array<double>").repartition(4)
    got = {(x.item_id, x.place): (x.doc_id, x.score) for x in retrieval.nearest(asked, docs, 5, block).collect()}
    score = q @ d.T
    want = {(i, n + 1): (j, score[i, j]) for i in range(7) for n, j in enumerate(sorted(range(50), key=lambda j: (-score[i, j], j))[:5])}
    assert got == want
    assert retrieval.nearest(asked, docs.limit(0), 5, block).count() == 0 and retrieval.nearest(asked.limit(0), docs, 5, block).count() == 0
    assert retrieval.nearest(asked, docs.limit(2), 5, block).count() == 14


def test_search_within_a_scope(spark):
    """A kept index answers as a fresh one; nothing outside the scope is ranked or counted."""
    rows = docs_of(spark, 5)
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w3"), (2, "nothing known"), (3, None)], "item_id long, text string")
    inside = api.scoped(docs, languages=["de"])
    one = sorted(map(tuple, api.search(asked, inside).collect()))
    assert one == sorted(map(tuple, api.search(asked, inside, index=postings.build(inside.select("doc_id", "lang", "text"))).collect()))
    languages = {i: lang for i, lang, _ in rows}
    assert one and {i for i, *_ in one} == {1} and all(languages[d] == "de" for _, d, *_ in one)
    assert {r.doc_id for r in docs.where(F.col("lang") == "de").collect()} >= {d for _, d, *_ in one}


def test_query_citation_readiness(spark):
    docs = spark.createDataFrame([*docs_of(spark, 7), (950, "en", "Supply voltage of X-1 is 3 V.")], "doc_id long, lang string, text string")
    index = postings.build(docs)
    asked = spark.createDataFrame([(1, "What is the maximum supply voltage of X-1?"), (2, "zz")], "item_id long, text string")
    got = {r.item_id: r for r in api.query(asked, docs, index).collect()}
    assert got[1].kind == "value" and got[1].bound == "upper" and got[1].hits[0].doc_id == 950 and got[1].hits[0].used > 0 and got[2].hits is None
    quote = hashlib.sha256(b"voltage").hexdigest()
    cited = spark.createDataFrame([(950, 7, 14, quote), (950, 8, 15, quote), (950, 20, 99, quote), (-1, 0, 1, quote), (900, 0, 1, quote)], "doc_id long, start_at long, end_at long, digest string")
    assert sorted((r.doc_id, r.start_at, r.quote, r.status) for r in api.citation(cited, docs).collect()) == [(-1, 0, None, "missing"), (900, 0, None, "out_of_range"), (950, 7, "voltage", "ok"), (950, 8, "oltage ", "changed"), (950, 20, None, "out_of_range")]
    assert tuple(api.readiness(index, docs).first()) == (64, 64, 62, 0, True)
    more = docs.union(spark.createDataFrame([(951, "en", "new words")], docs.schema))
    assert tuple(api.readiness(index, more).first())[3:] == (1, False)
