"""op8 makes the keys of lines in generated code, from the scan on, and exchanges no texts to count them."""

import random

from pyspark.sql import functions as F

from fathom.llm import lines

EDITED = [(1, "a b c d e f"), (2, "a b c d e x"), (3, "p q r s t"), (4, "p q r s t"), (5, "a b c d e f\np q r s t"), (6, "a b")]


def test_keys_are_counted_without_texts(spark, monkeypatch):
    plans, saved = {}, lines.saved
    monkeypatch.setattr(lines, "saved", lambda df, name, *rest: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), saved(df, name, *rest))[1])
    got = lines.sharing(spark.createDataFrame(EDITED, "doc_id long, text string")).collect()
    assert len({r.ha for r in got}) == 2 and all(r.n == 2 for r in got)  # copies count once, and share no key with themselves
    plan = plans["line-shared-keys"]
    assert plan.count("Exchange hashpartitioning(") == 1 and "lambda" not in plan


def test_keys_of_every_length(spark):
    """Segments are whole and without overlap; of two lines within the threshold one has a run that is a segment of the other."""
    row = lambda n, words: (n, " ".join(words))
    base = {n: [f"w{n}x{k}" for k in range(n)] for n in (*range(1, 40), 143, 144, 145, 300, 511, 512, 600)}
    texts = [row(n, w) for n, w in base.items()] + [row(1000 + n, [*w[: n // 2], "new", *w[n // 2 :][1:], "end"]) for n, w in base.items() if n >= 10]
    made = lines.with_keys(spark.createDataFrame(texts, "ha long, line string")).groupBy("ha").agg(F.collect_set("key").alias("keys"), F.count_if("own").alias("own"))
    got = {r.ha: (set(r["keys"]), r.own) for r in made.collect()}
    edits = lambda n: 0 if n < 5 else 1 if n < 10 else 2 if n < 144 else min(30, int((n / 16) ** 0.5))
    assert {n for n in got if n < 1000} == {n for n in base if n >= 5}
    assert all(own == edits(n if n < 1000 else n - 999) + 1 for n, (_, own) in got.items())
    assert all(got[n][0] & got[1000 + n][0] for n in base if n >= 10)


def test_surely_is_within(spark):
    r = random.Random(3)
    word = lambda n: [r.choice("ab") for _ in range(r.randint(0, n))]
    rows = [(word(7), word(7), r.randint(0, 4)) for _ in range(300)] + [(x := list("abcdefgh"), [*x[:3], "q", *x[3 + n :]], 2) for n in range(4)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>, k int").select(lines.surely("a", "b", "k").alias("s"), lines.within("a", "b", "k").alias("w")).collect()
    assert all(x.w for x in got if x.s) and sum(x.s for x in got) > 100 and [x.s for x in got[-4:]] == [True, True, True, False]
