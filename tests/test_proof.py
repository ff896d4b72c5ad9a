"""Covers, as-of bindings, places of excerpts, support and question sets against brute force on stated cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fathom.operators import proof

DATA = "/root/testdata/sf0.001"


def brute_cover(rows, most):
    """rows: {row: terms}; {row: (step, gain)}, or nothing beyond most rows."""
    taken, covered, step = {}, set(), 0
    while True:
        step += 1
        left = {r: (len(t - covered), len(t)) for r, t in rows.items() if t - covered}
        if not left:
            return taken
        best = max(left.values())
        tied = [r for r, g in left.items() if g == best]
        taken |= {r: (step, best[0]) for r in tied}
        if len(taken) > most:
            return {}
        for r in tied:
            covered |= rows[r]


@pytest.mark.parametrize("most", [3, 12])
def test_cover(spark, most):
    r = random.Random(most)
    asked = {q: {row: {f"t{r.randrange(9)}" for _ in range(r.randint(0, 5))} for row in range(r.randint(0, 25))} for q in range(12)}
    asked[99] = {row: {"same"} for row in range(most + 1)}  # more ties than rows are allowed
    asked[100] = {row: {f"u{row}"} for row in range(most)}
    rows = [(q, row, t) for q, rs in asked.items() for row, ts in rs.items() for t in ts]
    got = sorted((x.question, x.row, x.step, x.gain) for x in proof.cover(spark.createDataFrame(rows, "question long, row long, term string"), most).collect())
    want = sorted((q, row, *at) for q, rs in asked.items() for row, at in brute_cover({k: v for k, v in rs.items() if v}, most).items())
    assert got == want and any(q == 100 for q, *_ in got) and not any(q == 99 for q, *_ in got)
    assert proof.cover(spark.createDataFrame([], "question long, row long, term string"), most).count() == 0


@pytest.mark.parametrize("chunk", [1, 3, 10_000])
def test_last_before(spark, chunk):
    r = random.Random(chunk)
    rows = [(s, i, r.choice([None, None, i])) for s in "ab" for i in range(40)] + [("c", 0, None)]
    got = {(x.s, x.i): x.seen for x in proof.last_before(spark.createDataFrame(rows, "s string, i long, v long"), "s", "i", F.col("v"), "seen", chunk).collect()}
    want, last = {}, {}
    for s, i, v in rows:
        last[s] = last.get(s) if v is None else v
        want[s, i] = last[s]
    assert got == want


def test_located(spark):
    words = [f"w{i}" for i in range(40)]
    text = " ".join(f"x{i}" for i in range(30)) + " " + " ".join(words) + " tail"
    worn = " ".join("zz" if i % 10 == 6 else w for i, w in enumerate(words))
    docs = [(1, text), (2, text.upper() + " " + text), (3, "nothing of it"), (4, None), (5, " ".join(words[:20])), (6, worn), (None, text)]
    items = [(1, " ".join(words)), (2, worn), (3, ""), (4, "w1 w2 w3 w4"), (5, None)]
    got = {(r.item_id, r.doc_id): (r.start_word, r.end_word, r.status) for r in proof.located(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1, 1] == (30, 70, "EXACT") and got[1, 2][2] == "EXACT" and got[1, None] == (30, 70, "EXACT") and got[1, 6] == (0, 40, "FUZZY")
    assert got[2, 1] == (30, 70, "FUZZY") and got[2, 6] == (0, 40, "EXACT") and not any(d in (3, 4, 5) for _, d in got) and not any(i > 2 for i, _ in got)


def test_located_recall(spark):
    """Every document that holds a benchmark passage holds its edited form's place too."""
    got = proof.excerpt_locate(spark, "/root/testdata/sf0.01").collect()
    exact = {(r.item_id, r.doc_id) for r in got if r.status == "EXACT" and r.item_id < 1_000_000}
    worn = {(r.item_id - 1_000_000, r.doc_id) for r in got if r.item_id >= 1_000_000}
    docs = {r.doc_id: re.findall(r"[^\W_]+", (r.text or "").lower()) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    items = {r.item_id: re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()}
    want = {(i, d) for d, ws in docs.items() for i, xs in items.items() if f" {' '.join(xs)} " in f" {' '.join(ws)} "}
    assert want and want <= exact and len(worn & want) >= 0.95 * len(want)


def test_support(spark):
    claims = [(1, 0, "a b c d e f g"), (1, 1, "q r s"), (1, 2, "never said by anyone at all"), (2, 0, ""), (2, 1, "a b c d e x y z u v w")]
    docs = [(1, "z a b c d e f g z q r s"), (2, "a b c d e x"), (3, None), (4, "y z u v w and a b c d e")]
    got = {(r.item_id, r.place): (r.doc_id, r.covered, r.n_spans, r.status) for r in proof.support_ledger(spark.createDataFrame(claims, "item_id long, place long, text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, 0): (1, 7, 1, "supported"), (1, 1): (1, 3, 1, "supported"), (1, 2): (None, 0, 0, "unsupported"), (2, 1): (4, 10, 2, "partial")}


def test_question_set(spark):
    docs = spark.createDataFrame([(i, f"Unit AB-{i * 7:03d} and XY{i % 7}9 of it. This sentence number is told in the text of {'one' if i % 2 else 'two'} document {i // 2} only.") for i in range(120)] + [(200, None)], "doc_id long, text string")
    got = proof.question_set(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, proof.question_set(docs.repartition(5)).collect()))
    by = {c: [r for r in got if r.category == c] for c in proof.QUOTAS}
    assert {c: len(rs) for c, rs in by.items()} == proof.QUOTAS
    texts = {r.doc_id: (r.text or "").upper() for r in docs.collect()}
    assert all(r.question in texts[r.expected] and r.scope == str(r.expected) for r in by["identifier"])
    assert all(r.question not in texts[int(r.scope)] and r.expected is None for r in by["out_of_scope"])
    assert all(not any(r.question in t for t in texts.values()) for r in by["no_answer"])
    assert len({r.question for r in got}) == len(got) and {r.split for r in got} == {"holdout", "development"}
    assert proof.question_set(docs.limit(0)).count() == 0
