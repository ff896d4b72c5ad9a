"""Every registered query text against DuckDB over the same tables."""

import math

import duckdb
import pytest

from fathom import plans
from fathom.sources import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda x: round(x, 5) if isinstance(x, float) and math.isfinite(x) else x
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.oracles()))
def test_query(spark, duck, name):
    got = plans.queries()[name](spark, DATA)
    want = duck.sql(plans.oracles()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert normal([tuple(r) for r in got.collect()], got.columns) == normal(want.fetchall(), want.columns)


def test_stream(spark, tmp_path):
    from fathom.streaming import event_counts

    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    got = event_counts(spark, str(tmp_path / "in"), str(tmp_path / "check"), str(tmp_path / "out"))
    batch = events.groupBy("event_type").count().count()
    assert 0 < got.agg({"n": "sum"}).first()[0] <= events.count() and batch >= 1
