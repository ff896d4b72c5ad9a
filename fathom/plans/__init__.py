"""The registry of queries: name -> (Spark function, oracle SQL).

A family gives for each name one text for both dialects, or a pair: Spark text or function, and oracle text or None.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathom.functions import dialect
from fathom.operators import answers, corpus, coverage, evaluation, evidence, measures, proof, prose, reading, retrieval, scope, text
from fathom.sources import register

FAMILIES = (scope, text, retrieval, measures, corpus, answers, evaluation, coverage, reading, evidence, prose, proof)
PAIRS = {name: q if isinstance(q, tuple) else (q, q) for family in FAMILIES for name, q in family.QUERIES.items()}


def compile_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query text as a function of a session and a folder of tables."""
    own = dialect(dialect(sql, 0), 0)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, own)
        return spark.sql(own)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: own if callable(own) else compile_query(own) for name, (own, _) in PAIRS.items()}


def oracles() -> dict[str, str]:
    return {name: dialect(dialect(sql, 1), 1).replace("left anti join", "anti join").replace("left semi join", "semi join") for name, (_, sql) in PAIRS.items() if sql}
