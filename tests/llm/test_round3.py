"""Operators 11 to 13 against brute-force versions, held-out accuracy, odd rows and empty tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import codes, quality, queries, trie

DATA = "/root/testdata/sf0.01"
CLASH = ("row", "pos", "part", "parts", "key", "fold", "bin", "family", "statistics", "weight", "code")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def widened(df):
    """df with columns whose names the operators use for their own."""
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH))


def digest(role, text):
    return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", digest(role, text), text or ""))
    own = {c: [(role, text) for _, _, role, _, text in sorted(v)] for c, v in own.items()}
    whole = {c: own.get(c - c % 5, [])[: zlib.crc32(str(c).encode()) % 9] + turns[zlib.crc32(str(c).encode()) % 9 :] for c, turns in own.items()}
    members, children, out, leaves, saved = defaultdict(list), defaultdict(list), [], {}, {}
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[q] for q in children[path]) or 1
        saved[path] = (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0) + sum(saved[q] for q in children[path])
        ends = ",".join(map(str, sorted(c for c in members[path] if len(whole[c]) == len(path))))
        up = min(members[path[:-1]]) if path else None
        out.append((min(members[path]), len(path), up, len(members[path]), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks(seed, n):
    r = random.Random(seed)
    turn = lambda t: (r.choice([t, t, t, None]), r.choice(["user", "bot", None]) if r.random() < 0.1 else ("user", "bot")[t % 2], r.choice(["x", "é", None, ""]) if r.random() < 0.5 else "x")
    return [(c if r.random() < 0.98 else None, *turn(t)) for c in range(n) for t in range(r.randint(0, 5))]


@pytest.mark.parametrize(("seed", "n", "fan"), [(0, 150, 2), (1, 7, 3), (2, 60, 32), (3, 0, 2)])
def test_op12(spark, seed, n, fan, monkeypatch):
    """Small fans stitch several levels; chunks of two ids are streamed through one hash."""
    monkeypatch.setattr(trie, "CHUNK", 2)
    rows = talks(seed, n)
    df = widened(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert rows_of(trie.prefix_trie(df, fan=fan)) == brute_trie(rows)


def test_op12_hot_copies_and_a_long_conversation(spark):
    """Most conversations are equal and spread over all partitions; one has many turns."""
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 300) for t in range(9)] + [(1001, t, "user", f"own {t}") for t in range(3000)] + [(1002, None, None, None), (1003, 1, "user", "x" * 100_000)]
    assert rows_of(trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), task_turns=300, fan=4)) == brute_trie(rows)


def test_op12_whole_table(spark):
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    assert rows_of(queries.QUERIES["op12_prefix_trie"](spark, DATA)) == brute_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def brute_codes(rows):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    w = -(-max(len(v) for _, v, _ in kept) // 16)
    whole = [(i, [math.floor(256 * x) for x in v] + [0] * (16 * w - len(v)), label) for i, v, label in kept]
    whole = [(i, [tuple(v[p * w : p * w + w]) for p in range(16)], label) for i, v, label in whole]
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]
    books = [[r[1][p] for r in first] for p in range(16)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(2):
        for p in range(16):
            used = defaultdict(list)
            for _, v, _ in whole:
                used[near(v[p], books[p])[1]].append(v[p])
            books[p] = [tuple(sum(c) // len(used[k]) for c in zip(*used[k], strict=True)) if k in used else e for k, e in enumerate(books[p])]
    out, total = [], defaultdict(int)
    for i, v, label in whole:
        found = [near(v[p], books[p]) for p in range(16)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        total[label] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, code, error, total[label], sha) for i, code, error, label in out], key=str)


ODD = [None, [float("nan")] * 32, [float("inf")] * 32, [None] * 32, [0.0] * 32, [1.0] * 30, []]


@pytest.mark.parametrize("n", [0, 40, 200])
def test_op13(spark, n):
    """Null, repeated and tied rows, vectors of several lengths, fewer rows than entries."""
    r = random.Random(n)
    rows = [(r.choice([k, k, k, 5, None]), r.choice(ODD) if r.random() < 0.4 else [0.05 * r.randint(-9, 9) for _ in range(32)], r.choice([None, 1, 2])) for k in range(n)]
    df = widened(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    single = [(i, v and [x if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert rows_of(codes.vector_codes(df)) == brute_codes(single)


@pytest.mark.parametrize("hot", [2, 1 << 40])
def test_op13_hot_parts(spark, monkeypatch, hot):
    """A vector that half the rows have, joined by broadcast and by shuffle alike."""
    monkeypatch.setattr(codes, "HOT", hot)
    rows = [(k, [0.25] * 16 if k % 2 else [float(k % 7)] * 16, 1) for k in range(100)]
    assert rows_of(codes.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))) == brute_codes(rows)


def test_op13_large_components(spark):
    """Components beyond the limit saturate; nothing overflows."""
    got = codes.vector_codes(spark.createDataFrame([(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert [r.error for r in got] == [0, 0]


def test_op11(spark):
    """Held-out accuracy, and held-out rows by the stated rule."""
    got = {r.doc_id: r for r in queries.QUERIES["op11_quality"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(r.quality, got[r.doc_id].predicted) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) >= 0.98 * len(held) and sum(a == b for a, b in held if a == 0) >= 0.9 * sum(a == 0 for a, _ in held)


def test_op11_held_out_labels_do_not_teach(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows_of(quality.scores(docs, labels)) == rows_of(quality.scores(docs.repartition(7), turned))


def test_op11_statistics():
    """Shares and counts of a stated text; odd texts give finite numbers."""
    got = dict(zip(quality.STATISTICS, quality.statistics_of("AB ab ab 12\nAB ab ab 12 $$$"), strict=True))
    assert got["words"] == pytest.approx(math.log1p(9)) and got["distinct_words"] == pytest.approx(4 / 9) and got["repeated_words"] == pytest.approx(2 / 9)
    assert got["all_capitals"] == pytest.approx(2 / 9) and got["symbol_words"] == pytest.approx(1 / 9) and got["upper"] == pytest.approx(4 / 12)
    for text in (None, "", " ", "\n\n", "a", "é", "  ", "\x00", "x" * 3_000_000, "w " * 500_000):
        assert len(quality.statistics_of(text)) == len(quality.STATISTICS) and all(map(math.isfinite, quality.statistics_of(text)))


def test_op11_odd_rows(spark):
    texts = ["fine words of a text", "BAD!! BAD!! BAD!!", None, "", "fine words of a text"]
    docs = widened(spark.createDataFrame([(None if i % 9 == 8 else i % 30, texts[i % 5], "en") for i in range(80)], "doc_id long, text string, lang string"))
    labels = spark.createDataFrame([(i, int(i % 5 != 1)) for i in range(30)] + [(3, None), (4, 7), (None, 1), (0, 1)], "doc_id long, quality int")
    got = quality.scores(docs, labels).collect()
    assert len(got) == 80 and all(0 <= r.score <= 1 for r in got) and not any(r.held_out for r in got if r.doc_id is None)
    none = labels.limit(0)
    assert {r.score for r in quality.scores(docs, none).collect()} == {0.5} and quality.scores(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.scores(docs, labels.where("quality = 1")).collect()} == {1.0}


def test_op11_isotonic():
    assert quality.isotonic([(1, 2, 0), (2, 2, 2), (3, 2, 0), (5, 1, 1)]) == ([1.0, 2.5, 5.0], [0.0, 0.5, 1.0])
