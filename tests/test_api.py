"""Calls of the library on small tables, generations, the coverage choice and the session stream."""

import itertools
import random

import pytest

from fathom import api, plans
from fathom.operators.coverage import choose
from fathom.sources import generations

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "red apple pie", "en", "a/x"), (2, "green apple", "en", "a"), (3, "tarte rouge", "fr", "b"), (4, None, "en", "ab"), (5, "", None, None), (6, "red red wine", "en", "a/x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_scope(spark, docs):
    assert ids(api.scoped(docs)) == [1, 2, 3, 4, 5, 6]
    assert ids(api.scoped(docs, folders=["a"])) == [1, 2, 6] and ids(api.scoped(docs, folders=[])) == []
    assert ids(api.scoped(docs, languages=["fr"])) == [3]
    some = spark.createDataFrame([(1,), (9,), (1,)], "doc_id long")
    assert ids(api.scoped(docs, doc_ids=some)) == [1]
    gone = api.missing(spark.createDataFrame([(1,), (3,), (9,)], "doc_id long"), docs, some.where("doc_id = 1"))
    assert {tuple(r) for r in gone.collect()} == {(3, "not_indexed"), (9, "unknown")}


def test_search_and_context(spark, docs):
    asked = spark.createDataFrame([(1, "red apple"), (2, "nothing"), (3, None)], "item_id long, text string")
    got = api.search(asked, docs).collect()
    assert {r.item_id for r in got} == {1} and {r.doc_id for r in got} == {1, 2, 6} and next(r for r in got if r.place == 1).doc_id == 1
    assert {r.doc_id for r in api.search(asked, api.scoped(docs, folders=["b"])).collect()} == set()
    assert len(api.search(asked, docs, 2).collect()) == 2
    assert {r.doc_id for r in api.context(asked, docs).collect()} == {1, 2, 6}
    assert api.search(asked.limit(0), docs).count() == 0 == api.search(asked, docs.limit(0)).count()


def test_cells_events_pages(spark):
    cells = spark.createDataFrame([("s", r, c, f"{r}{c}") for r in range(5) for c in range(5)], "sheet string, row_at int, col_at int, value string")
    assert api.sheet_cells(cells, "s", (1, 2), (3, 4)).count() == 4
    with pytest.raises(ValueError):
        api.sheet_cells(cells, "s", (1, 5000), (1, 3))
    events = spark.createDataFrame([(i, i % 2, i // 2) for i in range(10)], "event_id long, user_id long, ts long")
    after = api.events_since(events, spark.createDataFrame([(0, 4)], "user_id long, event_id long"))
    assert sorted(r.event_id for r in after.collect()) == [1, 3, 5, 6, 7, 8, 9]
    page = api.page_before(events, None, 3).collect()
    assert [r.event_id for r in page] == [9, 8, 7, 6]
    assert [r.event_id for r in api.page_before(events, (page[2].ts, page[2].event_id), 3).collect()] == [6, 5, 4, 3]
    assert {r.event_id for r in api.latest(events, "user_id", "ts", "event_id").collect()} == {8, 9}


def test_outline(docs):
    assert {r.doc_id for r in api.outline(docs).collect()} == {1, 2, 3, 6}


def test_generations(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id long, v string")
    b = spark.createDataFrame([(1, "x"), (3, "z")], "id long, v string")
    root = str(tmp_path / "index")
    generations.stage(a, root, "g1")
    assert {tuple(r) for r in generations.differences(b, root, "g1").collect()} == {(2, "foreign"), (3, "missing")}
    assert not generations.publish(b, root, "g1") and generations.publish(a, root, "g1")
    assert generations.active(spark, root).count() == 2
    generations.stage(b, root, "g2")
    assert sorted(r.id for r in generations.active(spark, root).collect()) == [1, 2]
    assert generations.publish(b, root, "g2")
    assert sorted(r.id for r in generations.active(spark, root).collect()) == [1, 3]


def test_choose_never_loses():
    rng = random.Random(5)
    for _ in range(300):
        holds = [set(rng.sample("abcdefgh", rng.randint(0, 3))) for _ in range(rng.randint(0, 9))]
        wanted, cap = sorted(set().union(*holds)), rng.randint(1, 4)
        got = choose(holds, wanted, cap)
        first = set().union(*holds[:cap]) if holds else set()
        assert len(got) == len(set(got)) == min(cap, len(holds)) and first <= set().union(*(holds[i] for i in got))
        best = max((len(set().union(*(holds[i] for i in c))) for c in itertools.combinations(range(len(holds)), min(cap, len(holds)))), default=0)
        assert len(set().union(*(holds[i] for i in got))) <= best


def test_coverage_query(spark):
    rows = plans.queries()["coverage_selection"](spark, DATA).collect()
    assert rows and all(1 <= r.turn <= 6 for r in rows) and len({(r.item_id, r.doc_id) for r in rows}) == len(rows)


def test_session_stream(spark, tmp_path):
    from fathom.streaming import sessions

    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    got = {(r.user_id, r.n, r.start) for r in sessions(spark, str(tmp_path / "in"), str(tmp_path / "check"), str(tmp_path / "out")).collect()}
    by_user = {}
    for r in events.select("user_id", "ts").orderBy("user_id", "ts").collect():
        runs = by_user.setdefault(r.user_id, [])
        if runs and (r.ts - runs[-1][-1]).total_seconds() < 1800:
            runs[-1].append(r.ts)
        else:
            runs.append([r.ts])
    assert got and got <= {(u, len(run), run[0]) for u, runs in by_user.items() for run in runs}
