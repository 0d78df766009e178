import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import catalog, periodic_runs


def runs_by_hand(words):
    """Every stretch of every period, compared word by word."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if size >= max(6, 4 * q) and not any(
                    all(words[k] == words[k + p] for k in range(i, i + size - p)) for p in range(1, q)):
                found.append((i, size, q))
            i = j + 1
    return sorted(found)


def damaged(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_hand(doc_id, text):
    words = damaged(doc_id, [w.decode() for w in (text or "").encode().split()])
    runs = runs_by_hand(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    dropped = {k for s, size, q in runs for k in range(s + q, s + size)}
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)),
            sha(" ".join(w for k, w in enumerate(words) if k not in dropped)))


def agree(docs, longest=3000):
    rows = {}
    short = [r for r in docs.select("doc_id", "text").collect() if len((r.text or "").split()) <= longest]
    for r in catalog.runs_of_documents(docs).collect():
        rows.setdefault(r.doc_id, []).append(tuple(r))
    for r in short:
        assert by_hand(r.doc_id, r.text) in rows[r.doc_id]
    assert sum(map(len, rows.values())) == docs.count()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_small_alphabets(words):
    assert periodic_runs.runs_of_words([bytes([65 + w]) for w in words]) == runs_by_hand(words)


def test_nested_and_neighbouring_runs():
    rng = random.Random(5)
    for _ in range(300):
        words = []
        while len(words) < rng.randrange(20, 200):
            unit = [rng.randrange(4) for _ in range(rng.randrange(1, 7))]
            if rng.random() < 0.3:
                unit = unit * rng.randrange(4, 6) + [rng.randrange(9)]
            words += unit * rng.randrange(1, 7)
            words += [rng.randrange(60) for _ in range(rng.randrange(5))]
        assert periodic_runs.runs_of_words([b"%d" % w for w in words]) == runs_by_hand(words)
        # without cutting first: the automaton alone
        assert periodic_runs.runs_of_stretch(words) == runs_by_hand(words)


def test_last_ends_are_exact():
    """Each segment tells the latest earlier end and the exact length of the common suffix."""
    rng = random.Random(6)
    for _ in range(60):
        words = [rng.randrange(3) for _ in range(40)]
        length, link, ends = periodic_runs.suffix_automaton(words)
        segments = periodic_runs.PathSegments(length, link)
        for end, state in enumerate(ends):
            told = dict(segments.access(state, end))
            # an earlier end counts only where it shares more than all later ones
            want, most = {}, 0
            for before in range(end - 1, -1, -1):
                size = 0
                while size <= before and words[before - size] == words[end - size]:
                    size += 1
                if size > most:
                    want[before], most = size, size
            assert {b: s for b, s in told.items() if s} == want


@pytest.mark.parametrize("name", ["odd", "clashing", "documents", "no_docs"])
def test_query(request, name):
    agree(request.getfixturevalue(name))


def test_long_runs(spark):
    """A word repeated 50,000 times, and a long period, in time in step with the words."""
    texts = [(1, "a " * 50_000), (2, " ".join(f"w{k % 4000}" for k in range(20_000)) + " end"), (3, "x y " * 9_000 + "x z")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r.doc_id: r for r in periodic_runs.find_runs(docs, ["doc_id"]).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 50_000, 1)] and got[1].collapsed == "a"
    assert [tuple(r) for r in got[2].runs] == [(0, 20_000, 4000)]
    assert got[2].collapsed == " ".join(f"w{k}" for k in range(4000)) + " end"
    assert [tuple(r) for r in got[3].runs] == [(0, 18_001, 2)] and got[3].collapsed == "x y z"


def test_ties(spark):
    text = "a a a a a a b c b c b c b c b c b c z z z z z z"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = periodic_runs.find_runs(docs, ["doc_id"]).first()
    assert [tuple(r) for r in row.runs] == [(0, 6, 1), (6, 12, 2), (18, 6, 1)]
    assert tuple(row.strongest) == (0, 6, 1) and row.collapsed == "a b c z"
