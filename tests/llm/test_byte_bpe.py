import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.load_ranks(open(PATH, "rb").read())
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def expected(text):
    ids = ENCODING.encode_ordinary(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def agree(docs):
    rows = bpe.encoded_digests(docs, PATH, public_tokenizers.PATTERN).collect()
    want = sorted(((r.doc_id, *expected(r.text or "")) for r in docs.select("doc_id", "text").collect()), key=str)
    assert sorted((tuple(r) for r in rows), key=str) == want


@pytest.mark.parametrize("name", ["odd", "clashing", "documents", "no_docs"])
def test_as_the_library(request, name):
    agree(request.getfixturevalue(name))


def test_chunks_meet(spark, monkeypatch):
    """Words and blanks longer than the overlap, marks and contractions at every cut."""
    for name, size in (("CHUNK", 64), ("OVERLAP", 16)):
        monkeypatch.setattr(bpe, name, size)
    rng = random.Random(1)
    parts = ["it's", " we'll", "  ", "\n\n", "é", "東京", "word", "12345", "!?", " ", "x" * 90, " " * 70, "\t", "'", "ve"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(400))) for _ in range(150)]
    agree(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4))


MATCHES = bpe.Matches(public_tokenizers.PATTERN)


MERGER = bpe.Merger(RANKS)


def merge(*pieces):
    return [np.frombuffer(ids, np.int32).tolist() for ids in MERGER.merge([p.encode() for p in pieces])]


def encode(text):
    return [i for ids in merge(*MATCHES.texts(text)) for i in ids]


def test_every_character_is_of_the_library_class():
    by_class = {name: tiktoken.Encoding("one", pat_str=name, mergeable_ranks=RANKS, special_tokens={})
                for name in (r"\p{L}", r"\p{N}", r"\s")}
    for code in range(0x110000):
        c = chr(code)
        if not 0xD800 <= code < 0xE000:
            own = bool(MATCHES.newer.match(c))
            got = [not own and bool(regex.match(p, c)) for p in (r"\p{L}", r"\p{N}", r"\p{White_Space}")]
            assert got == [bool(e.encode_ordinary(c)) for e in by_class.values()], hex(code)


def test_white_space():
    for c in [*range(0x300), *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x1680]:
        text = f"a{chr(c)}{chr(c)}b {chr(c)}1"
        assert encode(text) == ENCODING.encode_ordinary(text), hex(c)


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    ids = encode(text)
    assert ids == ENCODING.encode_ordinary(text)
    spell = {v: k for k, v in RANKS.items()}
    assert b"".join(spell[i] for i in ids) == text.encode()


def test_long_match():
    text = "ab" * 3000 + "é" * 2000
    assert merge(text) == [ENCODING.encode_ordinary(text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=70), max_size=20))
def test_both_ways_to_merge_agree(texts):
    """Many at a time, of all widths, and one by one over a heap."""
    whole = [[RANKS[t.encode()]] if t.encode() in RANKS else bpe.merge_long(t.encode(), RANKS) for t in texts]
    assert merge(*texts) == whole


def test_memory_is_emptied_when_full(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    coder = bpe.Encoder(open(PATH, "rb").read())
    rng = random.Random(3)
    for _ in range(20):
        texts = ["".join(rng.choice("abcdeé ") for _ in range(200)) for _ in range(4)]
        got = coder.encode([MATCHES.texts(t) for t in texts])
        assert [np.frombuffer(g, np.int32).tolist() for g in got] == [ENCODING.encode_ordinary(t) for t in texts]
        assert [coder.decode(np.frombuffer(g, np.int32).tolist()).decode() for g in got] == texts
