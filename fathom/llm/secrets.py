"""Operator 4, secret scans with an incremental blob ledger.

Every text is a blob, named by its SHA-256. ``Ledger`` is a folder of tables: ``findings`` (blob, rules, spans), ``paths``
(doc_id, blob, version), one partition for each version of the documents that was added, and, if it keeps texts, ``blobs`` (blob,
text), each text once. A scan takes the blobs that the ledger lacks for these rules, scans one text of each and appends. Findings
are keyed by (blob, rules) and read once a key, so a repeated append, by a retry or by two scans at once, changes nothing; a version
that is added again replaces itself. ``secrets`` joins the findings to the rows of one table, ``Ledger.history`` to all paths of all
versions: a blob that these rules haven't scanned, because it came with other rules or its scan broke off, is unscanned there
and never clean. ``Ledger.catch_up`` scans the stored texts of such blobs.

A rule version names what scans: ``RULE_SETS`` binds ids to functions from a text to spans, and an id without one is refused.

Null texts are empty; all share one blob without findings. Rows with a null doc_id are paths like others. Repeated rows
stay repeated. Very long texts are scanned whole, in time linear in their length. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import shared_dir, tune

ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
PEM = re.compile(r"-----(BEGIN|END) ([A-Z ]*)PRIVATE KEY-----")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem", "jwt")
RULES = "v2:" + hashlib.sha256("\n".join(p.pattern for p in (ASSIGN, ACCESS, HEX, PEM, JWT)).encode()).hexdigest()[:16]


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) by start, then kind as listed; code points, end exclusive."""
    text = text or ""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in LONG_HEX.finditer(text)]  # a run's leftmost match is the whole run
    if "-----BEGIN" in text:
        found += [("pem", a, b) for a, b in keys(text)]
    if "eyJ" in text:
        found += [("jwt", *m.span()) for m in JWT.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def keys(text: str) -> list[tuple[int, int]]:
    """Spans of private keys, from the opening line to the closing one that follows; the opening line alone if none does."""
    marks = list(PEM.finditer(text))
    out = []
    for m, after in zip(marks, [*marks[1:], None]):
        if m[1] == "BEGIN":
            closed = after is not None and after[1] == "END" and after[2] == m[2]
            out.append((m.start(), after.end() if closed else m.end()))
    return out


#: What each rule version runs. The id of this module's own rules holds a hash of their patterns.
RULE_SETS: dict[str, Callable[[str | None], list[tuple[str, int, int]]]] = {RULES: scan}


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


BLOBS = "blob string, text string"
FINDINGS = "blob string, rules string, n_assign long, n_access long, n_hex long, base string, spans string"


class Ledger:
    """Findings by blob and version of the rules, and all paths, in a folder that all executors share; made if it isn't there.

    rule_sets: functions by rule version, beside ``RULE_SETS``. keep_texts: whether texts are stored, so that other rules can scan them later.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, rule_sets: dict | None = None, keep_texts: bool = False) -> None:
        self.spark, self.rule_sets, self.keep_texts = spark, RULE_SETS | (rule_sets or {}), keep_texts
        self.folder = folder or f"{shared_dir(spark).rstrip('/')}/fathom/ledger-{uuid.uuid4().hex}"
        spark.createDataFrame([], FINDINGS).write.mode("append").parquet(f"{self.folder}/findings")
        if keep_texts:
            spark.createDataFrame([], BLOBS).write.mode("append").parquet(f"{self.folder}/blobs")

    def findings(self, rules: str = RULES) -> DataFrame:
        """One row for each blob that was scanned by these rules."""
        every = self.spark.read.schema(FINDINGS).parquet(f"{self.folder}/findings")
        return every.where(F.col("rules") == rules).dropDuplicates(["blob"])

    def paths(self) -> DataFrame:
        """(doc_id, blob, version) of every row of every version that was added."""
        return self.spark.read.schema("doc_id long, blob string, version string").parquet(f"{self.folder}/paths")

    def add(self, docs: DataFrame, rules: str = RULES, version: str | None = None) -> DataFrame:
        """Scans what is new in docs (doc_id, text), a version of the documents; returns (doc_id, blob), its paths."""
        scanner = self.scanner(rules)
        tune(self.spark)
        named = docs.select(F.col("doc_id").cast("long"), "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("blob"))
        at = f"{self.folder}/paths/version={version or uuid.uuid4().hex}"
        named.select("doc_id", "blob").write.mode("overwrite").option("compression", "zstd").parquet(at)
        paths = self.spark.read.schema("doc_id long, blob string").parquet(at)
        if self.keep_texts:
            self.texts_of(docs, named, paths, self.blobs()).write.mode("append").option("compression", "zstd").parquet(f"{self.folder}/blobs")
        todo = self.texts_of(docs, named, paths, self.findings(rules))
        todo.mapInArrow(scanned(rules, scanner), FINDINGS).write.mode("append").parquet(f"{self.folder}/findings")
        return paths

    def texts_of(self, docs: DataFrame, named: DataFrame, paths: DataFrame, known: DataFrame) -> DataFrame:
        """(blob, text) of one path of each blob that known lacks; a null doc_id can't lead back to a row, so those texts are found by blob."""
        first = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).join(known.select("blob"), "blob", "left_anti")
        wanted = first.where("doc_id is not null").select("doc_id", F.col("blob").alias("want"))
        texts = docs.select(F.col("doc_id").cast("long"), "text")
        todo = texts.join(wanted, "doc_id").where(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256) == F.col("want")).select(F.col("want").alias("blob"), "text")
        lost = named.where("doc_id is null").join(first.where("doc_id is null").select("blob"), "blob", "left_semi").select("blob", "text")
        return todo.union(lost)

    def scanner(self, rules: str) -> Callable[[str | None], list[tuple[str, int, int]]]:
        if rules not in self.rule_sets:
            raise ValueError(f"no rules are bound to {rules!r}")
        return self.rule_sets[rules]

    def blobs(self) -> DataFrame:
        """(blob, text): each stored text once."""
        return self.spark.read.schema(BLOBS).parquet(f"{self.folder}/blobs").dropDuplicates(["blob"])

    def catch_up(self, rules: str = RULES) -> None:
        """Scans every stored text that these rules haven't scanned, of whatever version."""
        scanner = self.scanner(rules)
        if not self.keep_texts:
            raise ValueError("the ledger keeps no texts: add the versions again")
        todo = self.blobs().join(self.findings(rules).select("blob"), "blob", "left_anti")
        todo.mapInArrow(scanned(rules, scanner), FINDINGS).write.mode("append").parquet(f"{self.folder}/findings")

    def joined(self, paths: DataFrame, rules: str = RULES) -> DataFrame:
        """paths (blob, ...), all of them scanned by these rules, with the findings of their blobs."""
        hits = self.findings(rules).where("spans <> ''").drop("rules")
        return paths.join(hits, "blob", "left").fillna({"n_assign": 0, "n_access": 0, "n_hex": 0, "base": "", "spans": ""})

    def history(self, rules: str = RULES) -> DataFrame:
        """Findings of these rules at all paths of all versions; scanned is false, and the findings are null, where these rules saw no text of the blob."""
        found = self.findings(rules).drop("rules").withColumn("scanned", F.lit(True))
        return self.paths().join(found, "blob", "left").withColumn("scanned", F.coalesce("scanned", F.lit(False)))


def scanned(rules: str, scanner: Callable[[str | None], list[tuple[str, int, int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for blob, text in zip(b.column(0), b.column(1)):
                spans = scanner(text.as_py())
                base = [s for s in spans if s[0] in BASE]
                rows.append((blob.as_py(), rules, *(sum(s[0] == k for s in base) for k in BASE), joined(base), joined(spans)))
            types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["blob", "rules", "n_assign", "n_access", "n_hex", "base", "spans"])

    return run


def secrets(docs: DataFrame, ledger: Ledger | None = None, version: str | None = None) -> DataFrame:
    """(doc_id, blob, n_assign, n_access, n_hex, base, spans) for every row of docs (doc_id, text)."""
    ledger = ledger or Ledger(docs.sparkSession)
    return ledger.joined(ledger.add(docs, version=version))
