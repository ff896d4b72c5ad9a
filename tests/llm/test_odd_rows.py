"""One table of odd rows through every operator and stage: null and repeated doc_ids, null, empty and long texts, clashing columns."""

import hashlib

import pytest
from tokenizers import Tokenizer

from fathom.llm import bpe, lines, media, mixing, queries, secrets, simhash, stages, substrings, suffixes, toxicity

LONG = " ".join(f"w{n % 977}" for n in range(30000))
COPY = " ".join(f"passage{n}" for n in range(60))
TEXTS = [
    (None, COPY), (None, COPY), (None, None), (1, COPY), (5, COPY), (5, "a text of its own that no other row of the table has"), (5, "a text of its own that no other row of the table has"),
    (6, None), (7, ""), (8, " \n\t\n"), (9, LONG), (9, LONG + " more"), (10, "token=abcdefgh12345"), (11, "x"), (11, "y"),
]
#: Names that the operators use for columns of their own.
CLASH = "id long, fp long, node long, component long, digest string, row long, key long, words long, _doc long, _n int, _had int, _drop int, _row long, _hash long, _id long, n_chars long, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "s", *range(15), len(t or ""), "en") for i, t in TEXTS]
    schema = "doc_id long, text string, source string, " + CLASH.replace("digest string", "digest long")
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    odd.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (5, 1, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_every_query_gives_a_row_a_document(spark, folder):
    for name in ("op2_toxicity", "op3_media_columns", "op4_secrets", "op5_substring_dedup", "op6_bpe", "op7_mixing", "op9_suffix_dedup", "op10_simhash"):
        got = queries.QUERIES[name](spark, folder).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in TEXTS), name


def test_op3(odd):
    want = sorted((str(i), len((t or "").encode())) for i, t in TEXTS)
    assert sorted((str(r.doc_id), r.n_bytes) for r in media.media_columns(odd).collect()) == want


def test_op4(odd):
    assert sorted((r.doc_id or 0, r.n_assign) for r in secrets.secrets(odd).collect() if r.n_assign) == [(10, 1)]


def test_op5(odd):
    """Rows without a doc_id stay whole; equal windows of one doc_id at one start tie and stay."""
    got = sorted((str(r.doc_id), r.n_words, len(r.kept.split())) for r in substrings.dedup(odd).collect() if r.n_words == 60)
    assert got == [("1", 60, 60), ("5", 60, 0), ("None", 60, 60), ("None", 60, 60)]


def test_op6(odd):
    known = Tokenizer.from_file(queries.vocabulary_path())
    want = sorted((str(i), " ".join(map(str, known.encode(t or "", add_special_tokens=False).ids))) for i, t in TEXTS)
    assert sorted((str(r.doc_id), r.ids) for r in bpe.encode(odd, queries.vocabulary_path()).collect()) == want


def test_op7(odd):
    got = mixing.mix(odd).collect()
    assert len(got) == len(TEXTS) and sum(r.taken for r in got) == sum(r.size for r in got) == sum(len((t or "").split()) for _, t in TEXTS)


def test_op8(odd):
    kept = sorted((str(r.doc_id), r.text or "") for r in lines.dedup(odd).collect())
    own = TEXTS[5][1]
    assert ("1", COPY) in kept and ("5", "") in kept and kept.count(("5", own)) == 2 and kept.count(("None", COPY)) == 2
    assert lines.dedup(odd).columns == odd.columns


def test_op9(odd):
    got = sorted((str(r.doc_id), r.n_bytes, len(r.kept)) for r in suffixes.dedup(odd).collect() if r.n_bytes == len(COPY))
    assert got == [("1", len(COPY), len(COPY)), ("5", len(COPY), 0), ("None", len(COPY), len(COPY)), ("None", len(COPY), len(COPY))]


def test_op10(odd):
    got = rows_of(simhash.near_duplicates(odd).select("doc_id", "component_id"))
    assert [c for i, c in got if i is None] == [None] * 3 and {c for i, c in got if i == 7} == {6} and {c for i, c in got if i == 1} == {1}


def test_stages(spark, odd, folder):
    """Repeated doc_ids lose no text of their own; of equal rows the SimHash stage keeps one; columns stay those of documents."""
    docs = odd.select(*stages.COLUMNS)
    clean = stages.toxicity_stage(spark, odd, folder)
    assert clean.columns == list(stages.COLUMNS) and clean.count() >= len(TEXTS) - 4
    lined = stages.line_stage(spark, odd, folder)
    texts = sorted((str(r.doc_id), r.text or "") for r in lined.collect())
    assert ("1", COPY) in texts and ("5", "") not in texts and texts.count(("5", TEXTS[5][1])) == 2
    kept = sorted((str(r.doc_id), r.text or "") for r in stages.simhash_stage(spark, docs, folder).collect())
    assert kept.count(("5", TEXTS[5][1])) == 1 and ("1", COPY) in kept and ("5", COPY) not in kept and kept.count(("None", COPY)) == 2
    assert [x for x in kept if x[0] == "9"] == [("9", LONG)] or [x for x in kept if x[0] == "9"] == [("9", LONG + " more")]
    assert {("11", "x"), ("11", "y")} <= set(kept)
    mixed = stages.mixing_stage(spark, docs, folder).collect()
    assert len(mixed) == len(TEXTS) and sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in mixed) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in TEXTS)
    assert stages.bpe_stage(spark, docs, folder).count() == len(TEXTS)


def test_empty_pipeline(spark, odd, folder):
    none = odd.select(*stages.COLUMNS).limit(0)
    for stage in (stages.toxicity_stage, stages.line_stage, stages.simhash_stage, stages.mixing_stage):
        got = stage(spark, none, folder)
        assert got.columns == list(stages.COLUMNS) and got.count() == 0
    assert stages.bpe_stage(spark, none, folder).count() == 0


def test_no_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.scores(odd, labels).collect()} == {0.0} and toxicity.clean(odd, labels).count() == len(TEXTS)
