"""The queries opN_<name> over whole tables; ``ORACLES`` has the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import bpe, codes, lines, media, mixing, quality, secrets, simhash, substrings, suffixes, toxicity, trie, vectors
from fathom.llm.common import documents
from fathom.llm.oracles import ORACLES  # noqa: F401

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = media.media_columns(documents(spark, sf_dir))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "digest")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.secrets(documents(spark, sf_dir))
    return got.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substrings.dedup(documents(spark, sf_dir))
    cut = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return got.select("doc_id", "n_words", cut.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.encode(documents(spark, sf_dir), vocabulary_path())
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir, "doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.classes(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffixes.dedup(documents(spark, sf_dir))
    cut = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return got.select("doc_id", "n_bytes", cut.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_toxicity, op3_media_columns, op4_secrets, op5_substring_dedup, op6_bpe, op7_mixing, op8_line_dedup, op9_suffix_dedup, op10_simhash, op11_quality, op12_prefix_trie, op13_vector_codes)}
