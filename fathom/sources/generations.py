"""Index generations: a generation is written whole, verified against what was meant, then named by a pointer row.

Readers see the generation that the pointer names, so a failed or repeated write is never visible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> DataFrame:
    """(id, digest): every row's digest over all its columns in order of name."""
    cols = sorted(c for c in df.columns if c != "id")
    return df.select("id", F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256).alias("digest"))


def stage(df: DataFrame, root: str, generation: str) -> None:
    """Writes rows (id, ...) as a generation; a second attempt replaces the first."""
    df.write.mode("overwrite").parquet(f"{root}/generation={generation}")


def differences(df: DataFrame, root: str, generation: str) -> DataFrame:
    """(id, state): rows that are missing, foreign or changed in a generation. Repeated ids count as changed."""
    count = lambda x, name: fingerprint(x).groupBy("id").agg(F.array_sort(F.collect_list("digest")).alias(name))
    a, b = count(df, "_a"), count(df.sparkSession.read.parquet(f"{root}/generation={generation}"), "_b")
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "foreign").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, a.id.eqNullSafe(b.id), "full_outer").select(F.coalesce(a.id, b.id).alias("id"), state.alias("state")).where("state is not null")


def publish(df: DataFrame, root: str, generation: str) -> bool:
    """Names a staged generation as the active one if it holds what df does; says whether it did."""
    if differences(df, root, generation).limit(1).count():
        return False
    df.sparkSession.createDataFrame([(generation,)], "generation string").coalesce(1).write.mode("append").parquet(f"{root}/pointers")
    return True


def active(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the generation published last."""
    named = spark.read.parquet(f"{root}/pointers").select("generation", F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_name").alias("file"))
    last = named.orderBy(F.col("at").desc(), F.col("generation").desc()).first().generation
    return spark.read.parquet(f"{root}/generation={last}")
