import hashlib
import random
import re

import pytest

from colloquy.llm import catalog, decontaminate

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string"


def words(text):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return PATTERN.findall((text or "").translate(str.maketrans(upper, upper.lower())))


def by_hand(text, items):
    """(words, hit words, items): every window of every item at every place."""
    w, hit, ids = words(text), set(), set()
    for item, body in items:
        b = words(body)
        k = min(10, len(b))
        for i in range(len(b) - k + 1 if k else 0):
            for j in range(len(w) - k + 1):
                if w[j:j + k] == b[i:i + k]:
                    hit.update(range(j, j + k))
                    ids.add("null" if item is None else str(item))
    return len(w), hit, sorted(ids)


def agree(docs, bench):
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    want = []
    for r in docs.select("doc_id", "text").collect():
        n, hit, ids = by_hand(r.text, items)
        want.append((r.doc_id, n, len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    assert sorted((tuple(r) for r in catalog.hits_of_documents(docs, bench).collect()), key=str) == sorted(want, key=str)
    return want


@pytest.fixture(scope="session")
def bench(spark):
    text = "the and of with from this that would which the and of with"
    rows = [(1, text), (2, text), (2, text), (30, "One two"), (4, ""), (5, None), (6, "...!"), (None, "no id here"),
            (7, "naïve CAFÉ 東京"), (8, "café"), (9, "12345 67890"), (10, "absent " * 40), (11, "a copy of a text here")]
    return spark.createDataFrame(rows, ITEMS)


@pytest.mark.parametrize("name", ["odd", "clashing", "no_docs"])
def test_cases(request, bench, name):
    want = agree(request.getfixturevalue(name), bench)
    assert name == "no_docs" or any(w[5] for w in want)


def test_empty_benchmark(spark, odd):
    assert not any(w[5] for w in agree(odd, spark.createDataFrame([], ITEMS)))


def planted(spark):
    """Few different words, so that windows of many items, overlaps and near misses are common."""
    rng = random.Random(8)
    def prose(n):
        return " ".join(rng.choice(["a", "b", "c", "é"]) for _ in range(n))

    items = [(k, prose(rng.randrange(30))) for k in range(60)]
    docs = [(k, prose(rng.randrange(60))) for k in range(80)]
    docs += [(100 + k, prose(9) + " x " + rng.choice(items)[1].upper() + ". " + prose(5)) for k in range(40)]
    return (spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3),
            spark.createDataFrame(items, ITEMS).repartition(3))


def test_planted_passages(spark):
    assert sum(w[5] for w in agree(*planted(spark))) > 40


def test_blocks_and_pieces(spark, monkeypatch):
    """A benchmark beyond a block is scanned block by block, long items in pieces, with the same result."""
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 200)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 3)
    agree(*planted(spark))


def test_equal_hashes(spark, monkeypatch):
    """Hits are verified: with all hashes equal nothing changes."""
    docs, bench = planted(spark)
    index = decontaminate.WindowIndex([(str(r.item_id), min(10, len(w)), w) for r in bench.collect()
                                       if (w := decontaminate.words_of(r.text.encode()))])
    texts = [decontaminate.words_of(r.text.encode()) for r in docs.collect()]
    usual = [index.occurrences(t) for t in texts]
    real = decontaminate.window_hashes
    monkeypatch.setattr(decontaminate, "window_hashes", lambda codes, size: real(codes, size) & 1)
    for size, (hashes, windows, sets) in index.windows.items():
        order = (hashes & 1).argsort(kind="stable")
        index.windows[size] = (hashes & 1)[order], windows[order], sets[order]
    assert [index.occurrences(t) for t in texts] == usual


def test_spans_are_removed(spark, clashing, bench):
    docs = spark.createDataFrame(
        [(1, "Before, one TWO! After."), (2, "one"), (3, None), (4, "one two"), (5, "x café y"), (6, "one two one two z")],
        "doc_id bigint, text string")
    clean = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench).collect()}
    assert clean == {1: "Before, ! After.", 2: "one", 3: None, 4: "", 5: "x  y", 6: " z"}
    whole = decontaminate.decontaminate(docs, bench, whole_documents=True)
    assert {r.doc_id for r in whole.collect()} == {2, 3}
    for mode in (False, True):
        assert decontaminate.decontaminate(clashing, bench, mode).columns == clashing.columns
