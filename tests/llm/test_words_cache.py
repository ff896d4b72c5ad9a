"""The words' cache of op6: what comes again stays, whatever comes once in between."""

import sys
import unicodedata

import regex

from fathom.llm import bpe
from fathom.llm.queries import vocabulary_path


def test_frequent_words_stay(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 200_000)
    codec, learned = bpe.Codec(bpe.read_spec(vocabulary_path())), []
    learn = codec.learn
    monkeypatch.setattr(codec, "learn", lambda words, *rest, **named: (learned.extend(words), learn(words, *rest, **named)))
    fresh = bpe.Codec(bpe.read_spec(vocabulary_path()))
    for n in range(200):
        text = "the quick fox " + " ".join(f"a{chr(97 + n % 26)}{chr(97 + n // 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(50))
        got = codec.encode(text)
        if n % 50 == 0:
            monkeypatch.setattr(bpe, "CACHE_BYTES", sys.maxsize)
            assert got == fresh.encode(text)
            monkeypatch.setattr(bpe, "CACHE_BYTES", 200_000)
    assert learned.count("the") == learned.count("fox") == 1 and len(learned) > 10_000


def test_latin_split():
    """Every character below U+0300, alone, doubled and between letters and digits, is split as by Unicode's classes."""
    find = regex.compile(bpe.SPLIT.replace("{L}", "\\p{L}").replace("{N}", "\\p{N}")).findall
    codec = bpe.Codec(bpe.read_spec(vocabulary_path()))
    for c in map(chr, range(0x300)):
        text = f"{c} a{c}1{c}{c}'s {c}it'll{c} é{c}² {unicodedata.normalize('NFC', c)}"
        assert codec.split(text) == find(text)
