"""Operator 3, media columns as interleaved document sequences.

``sequence`` parses HTML into ordered items: text and media references (digest, caption), each with its position, so that
positions and captions stay aligned. ``store`` keeps payloads by digest, losslessly, as 8-bit grey samples in PGM files of
64 columns held in a binary column; ``describe`` reads the stored bytes back and computes features; ``resolve`` joins
references with payloads by digest. Payload bytes never move in a join: features are made where the bytes lie, and only
those small rows meet the references.

``media_columns`` makes every document a page: its lines as paragraphs and, between the first and the others, a figure that
refers to the payload. What comes out is the figure's item, at its place among the text runs, with its caption.

Null texts are empty payloads (one row of 64 zero bytes). Null HTML has no items. A reference without a payload keeps its
item, with nulls. Copies of a payload that different tasks stored have one digest and meet as one. Rows with a null or repeated
doc_id have a row each. Very long texts are stored whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import saved, tune

COLUMNS = 64
SCHEME = "digest:"
ITEM = "doc_id long, items array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
# HTML's void and hidden elements, and those that end a text run: fixed values.
HIDDEN = frozenset("script style template head noscript".split())
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figure figcaption footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


class _Items(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.held: list[str] = []
        self.hidden = 0
        self.caption: list[str] | None = None
        self.figure: int | None = None

    def put(self, **item: str | None) -> None:
        self.items.append({"position": len(self.items), "kind": None, "text": None, "digest": None, "caption": None} | item)

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.put(kind="text", text=text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure = len(self.items)
        if tag == "figcaption":
            self.caption = []
        if tag in ("img", "audio", "video", "source") and not self.hidden:
            known = dict(attrs)
            if (src := known.get("src")) is not None:
                self.flush()
                self.put(kind="media", digest=src.removeprefix(SCHEME), caption=known.get("alt") or known.get("title"))

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.items[self.figure or 0 :]:
                if item["kind"] == "media":
                    item["caption"] = text or item["caption"]
        if tag in BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.held if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """Ordered items of a page."""
    if not html:
        return []
    parser = _Items()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.items


def sequence(pages: DataFrame) -> DataFrame:
    """(doc_id, items) for every row of pages (doc_id, html)."""
    tune(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), *((c, pa.string()) for c in ("kind", "text", "digest", "caption"))]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse(h.as_py()) for h in b.column(1)], kind)], ["doc_id", "items"])

    return pages.select(F.col("doc_id").cast("long"), "html").mapInArrow(run, ITEM)


def payload(text: str | None) -> tuple[bytes, int]:
    """The text's bytes, padded with zero bytes to a positive multiple of 64; their number before."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % COLUMNS or COLUMNS * (not data)), len(data)


def to_pgm(data: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (COLUMNS, len(data) // COLUMNS) + data


def from_pgm(stored: bytes) -> bytes:
    magic, size, top, data = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or top != b"255" or len(data) != width * height:
        raise ValueError("not an 8-bit PGM of the size it states")
    return data


def feature(data: bytes) -> str:
    """Grey-value features of the samples: mean, deviation, 16-bin histogram and mean of neighbours' differences."""
    x = np.frombuffer(data, np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    total, square = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    step = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))
    mean = total / len(x)
    return f"mean={mean:.6f};dev={max(0.0, square / len(x) - mean * mean) ** 0.5:.6f};step={step / max(1, len(x) - 1):.6f};hist=" + ",".join(map(str, bins.tolist()))


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_bytes, media): every text's payload in its stored form; within an Arrow batch each payload once.

    Rows whose payload the batch has already stored carry a null media and the same digest. digest: SHA-256 of length and
    text, so that a text and the same text with zero bytes appended stay apart.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[str] = set()
            digests, sizes, media = [], [], []
            for t in b.column(1):
                data, n = payload(t.as_py())
                digest = hashlib.sha256(b"%d:" % n + data[:n]).hexdigest()
                digests.append(digest)
                sizes.append(n)
                media.append(None if digest in seen else to_pgm(data))
                seen.add(digest)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "digest", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, digest string, n_bytes long, media binary")


def digest_of(text: str) -> Column:
    """The digest that ``store`` gives a text."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return F.sha2(F.concat(F.concat(F.octet_length(data).cast("string"), F.lit(":")).cast("binary"), data), 256)


def describe(stored: DataFrame) -> DataFrame:
    """One row a digest: what the stored bytes (digest, n_bytes, media), read back, contain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, n, m in zip(b.column(0), b.column(1), b.column(2)):
                media = m.as_py()
                data = from_pgm(media)
                rows.append((d.as_py(), n.as_py(), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-COLUMNS:]), len(media), hashlib.sha256(media).hexdigest(), feature(data)))
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.where("media is not null").select("digest", "n_bytes", "media").mapInArrow(run, schema).dropDuplicates(["digest"])


def resolve(items: DataFrame, described: DataFrame) -> DataFrame:
    """Items (doc_id, items) one a row, media references with what ``describe`` knows of their payload."""
    flat = items.select("doc_id", F.explode("items").alias("i")).select("doc_id", "i.*")
    return flat.join(described, "digest", "left")


def page_of(digest: Column, text: Column) -> Column:
    """A document as a page: the lines of its text as paragraphs; after the first, a figure that shows the payload."""
    safe = F.coalesce(text, F.lit(""))
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(plain), F.lit(coded))
    lines = F.split(safe, "\n", -1)
    figure = F.concat(F.lit(f'<figure><img src="{SCHEME}'), digest, F.lit('"><figcaption>Payload '), F.substring(digest, 1, 12), F.lit("</figcaption></figure>"))
    rest = F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    return F.concat(F.lit("<p>"), F.get(lines, F.lit(0)), F.lit("</p>"), figure, rest)


def media_columns(docs: DataFrame) -> DataFrame:
    """For every row of docs (doc_id, text), as a page: the item of its payload, resolved, with its position among the items."""
    stored = saved(store(docs), "media")
    pages = docs.select("doc_id", page_of(digest_of("text"), F.col("text")).alias("html"))
    return resolve(sequence(pages), describe(stored)).where("kind = 'media'")
