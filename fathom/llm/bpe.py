"""Operator 6, BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can't be merged over, so it marks a certain cut.
Words are cut there, each fragment is encoded by itself (the last with the word-end mark) with the library's merges, and
the ids are concatenated; this gives exactly the ids of the whole word. Words are kept in a cache of the worker, bounded in bytes, of two
halves: a full half becomes the older one, from which words that come again move to the new one, so frequent words stay;
the words of a text that both lack are encoded together. Rows go out in slices, so that a worker holds the results of about
``SLICE_BYTES`` of text, or of one longer text, at a time.

Texts are normalised as the vocabulary file says: NFC, runs of white space to one space, lower case, character by
character; added tokens in the raw text stay whole. Null and empty texts have no tokens; a text without words likewise. Rows with
a null or repeated doc_id have a row each. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import add
from sys import getsizeof

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

from fathom.llm.common import give_back, tune

CACHE_BYTES = 64 << 20
SLICE_BYTES = 1 << 20
# Unicode white space, and the split pattern of the vocabulary file.
SPACE = "\\t\\n\\v\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^" + SPACE + "{L}{N}]+"
END = "</w>"
ENTRY = 160  # bytes of a dictionary's entry and its pair, about


def splitter(letters: str = "\\p{L}", numbers: str = "\\p{N}"):
    return regex.compile(SPLIT.replace("{L}", letters).replace("{N}", numbers)).findall


@lru_cache(1)
def latin_splitter():
    """The same for texts below U+0300, whose letters and numbers are listed; the standard library finds them in half the time."""
    low = [chr(i) for i in range(0x300)]
    listed = {k: "".join(re.escape(c) for c in low if regex.match(k, c)) for k in ("\\p{L}", "\\p{N}")}
    return re.compile(SPLIT.replace("{L}", listed["\\p{L}"]).replace("{N}", listed["\\p{N}"])).findall


@lru_cache(1)
def recent() -> frozenset[str]:
    """Letters and numbers of the regex module that Python's own Unicode tables don't have yet."""
    known = regex.compile("[\\p{L}\\p{N}\\p{M}]").match
    return frozenset(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn" and known(c))


@lru_cache(1)
def newer() -> frozenset[str]:
    """Those of ``recent`` that the tokenizers library, with Unicode tables of its own, doesn't count as letters or numbers."""
    split = pre_tokenizers.Split(Regex("[\\p{L}\\p{N}]"), "removed")
    return frozenset("".join(x for x, _ in split.pre_tokenize_str("".join(sorted(recent())))))


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(other)}


class Codec:
    """Encoder and decoder of a byte-level BPE vocabulary with word ends. spec: text of its JSON file."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        self.vocab: dict[str, int] = dict(data["model"]["vocab"])
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        self.last = Tokenizer(models.BPE(self.vocab, merges, end_of_word_suffix=END))
        self.inner = Tokenizer(models.BPE(self.vocab, merges))
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.added).items()}
        self.digits = {i: str(i) for i in self.names}
        self.inside = {t[i : i + 2] for t in (x.removesuffix(END) for x in self.vocab) for i in range(len(t) - 1)}
        self.table = str.maketrans({bytes([b]).decode("latin-1"): c for b, c in byte_letters().items()})
        self.plain, self.latin = splitter(), latin_splitter()
        self.library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.specials = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.words: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        self.held = 0

    def pieces(self, letters: str) -> list[str]:
        """letters cut at every pair of neighbours that no token contains."""
        if self.inside.issuperset(map(add, letters, letters[1:])):
            return [letters]
        cuts = [i for i in range(1, len(letters)) if letters[i - 1 : i + 1] not in self.inside]
        return [letters[a:b] for a, b in zip([0, *cuts], [*cuts, len(letters)])]

    def meet(self, words: list[str]) -> None:
        """Puts the words of a text into the newer half of the cache."""
        if self.held > CACHE_BYTES // 2:
            self.words, self.older, self.held = {}, self.words, 0
        lacking = set(words).difference(self.words)
        if again := [w for w in lacking if w in self.older]:
            self.keep((w, self.older[w]) for w in again)
            lacking.difference_update(again)
        if lacking:
            self.learn(list(lacking))

    def keep(self, found: Iterable[tuple[str, tuple[str, str]]]) -> None:
        for word, known in found:
            self.words[word] = known
            self.held += getsizeof(word) + getsizeof(known[0]) + getsizeof(known[1]) + ENTRY

    def learn(self, words: list[str]) -> None:
        """Puts words into the cache: their tokens' ids and their names, each joined by one space."""
        parts = [self.pieces(w if w.isascii() and w.isprintable() else w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table)) for w in words]
        ends = self.grouped(self.last, [p[-1] for p in parts])
        rest = iter(self.grouped(self.inner, [x for p in parts if len(p) > 1 for x in p[:-1]]))
        names, digits, known = self.names, self.digits, []
        for p, ids in zip(parts, ends):
            if len(p) > 1:
                ids = [i for _ in p[:-1] for i in next(rest)] + ids
            known.append((" ".join([digits[i] for i in ids]), " ".join([names[i] for i in ids])))
        self.keep(zip(words, known))

    @staticmethod
    def grouped(model: Tokenizer, fragments: list[str]) -> list[list[int]]:
        """The ids of each fragment, encoded by itself."""
        out: list[list[int]] = [[] for _ in fragments]
        if fragments:
            got = model.encode(fragments, is_pretokenized=True, add_special_tokens=False)
            for n, i in zip(got.word_ids, got.ids):
                out[n].append(i)
        return out

    def normal(self, text: str) -> str:
        if text.isascii() or max(text) < "\u0300":
            return text.lower()  # nothing composes below U+0300
        return self.library.normalize_str(text)  # its Unicode tables differ from Python's

    def split(self, text: str) -> list[str]:
        if text.isascii() or max(text) < "\u0300":
            return self.latin(text)
        if newer().isdisjoint(text):
            return self.plain(text)
        # a private-use character, no letter to either, stands for each of them while the text is split
        stand = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in text)
        back = iter([c for c in text if c in newer()])
        parts = self.plain(text.translate(dict.fromkeys(map(ord, newer()), stand)))
        return ["".join(next(back) if c == stand else c for c in p) for p in parts]

    def encode(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens; ids joined by one space; the decoded text."""
        text = text or ""
        parts = self.specials.split(text) if self.specials and "<|" in text else [text]
        found: list[tuple[str, str]] = []
        for n, part in enumerate(parts):
            if n % 2:
                found.append((str(self.added[part]), part))
            elif words := self.split(self.normal(part)):
                self.meet(words)
                found += map(self.words.__getitem__, words)
        if not found:
            return 0, "", ""
        ids, names = map(" ".join, zip(*found))
        return ids.count(" ") + 1, ids, names

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids)


_codecs: dict[int, Codec] = {}


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def rows_of(ids: list[pa.Scalar], found: list[tuple[int, str, str]]) -> pa.RecordBatch:
    n, text, decoded = ([f[k] for f in found] for k in range(3))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(text, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])


def encode(docs: DataFrame, path: str, decoded: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids string, decoded string) of every row of docs (doc_id, text).

    path: the vocabulary file, read by the driver; its text, of fixed size, is broadcast.
    """
    spark: SparkSession = docs.sparkSession
    tune(spark)
    spec = spark.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(spec.value)
        if not (codec := _codecs.get(key)):
            _codecs.clear()
            codec = _codecs.setdefault(key, Codec(spec.value))
            give_back()  # what reading the vocabulary took
        for b in batches:
            ids, found, size = [], [], 0
            for i, t in zip(b.column(0), b.column(1)):
                text = t.as_py()
                ids.append(i)
                found.append(codec.encode(text))
                size += len(text or "")
                if size >= SLICE_BYTES:
                    yield rows_of(ids, found)
                    ids, found, size = [], [], 0
            yield rows_of(ids, found)
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")
