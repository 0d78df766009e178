"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over all documents.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters from U+0080 on. Every ``SIZE``
neighbouring words of a benchmark item are a window; an item of fewer words is one window. The items
are cut into pieces that overlap by a window less one word, pieces are dealt into blocks of about
``BLOCK_WORDS`` words, and a block's index goes to all tasks: the words it knows, the hashes of
its windows in order, and where each window stands. So what is broadcast is bounded
whatever the benchmark's size: a larger benchmark has more blocks, which are scanned one after the other.

A document is scanned once per block. Words that no item knows end a stretch; in the stretches left a
rolling hash per window is looked up among the block's hashes, and each hit is verified word by word.
Verified windows give the hit words (as spans of word numbers) and the items whose windows occur.
The clean text leaves the spans out, the document form drops hit documents.

At scale: one narrow pass without any shuffle; hot passages or sources do not matter. Items that share a window share
one entry for it. Only where there are several blocks the documents are written between passes.

Cases: a null, empty or wordless text has no words and hits nothing; a null or wordless item has no windows; a null
item id is told as "null"; equal items and repeated rows are one item per id, listed once; repeated documents
are told each on their own; a null id is kept; empty tables give no rows or no hits; clashing columns do
not matter, as only those named are read and new ones get fresh names.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import fresh, whole_text, with_fields
from colloquy.plans.runtime import materialize

SIZE = 10  # words of a window
BLOCK_WORDS = 1 << 20  # words of benchmark items in a block, some 100 MB of index at most
PIECE_WORDS = 1 << 12  # windows of a piece of an item
ROWS = 256  # rows of an output batch

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Bytes to lower case, and all that are in no word to a space.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if WORD.match(bytes([b])) else 32 for b in range(256))
STEP = 0x9E3779B97F4A7C15  # odd multiplier of the rolling hash


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


def window_hashes(codes, size: int):
    """A 64-bit polynomial hash of each ``size`` neighbouring codes."""
    import numpy as np

    total = np.zeros(max(len(codes) - size + 1, 0), np.uint64)
    for k in range(size):
        total = total * np.uint64(STEP) + codes[k:k + len(total)]
    return total


class WindowIndex:
    """The windows of some items: word numbers, sorted hashes, and the sets of items of equal windows."""

    def __init__(self, pieces: list[tuple[str, int, list[bytes]]]):
        """``pieces``: (item id, words of its windows, words)."""
        import numpy as np

        self.numbers: dict[bytes, int] = {}
        holders: dict[bytes, set[str]] = {}  # the windows, as the bytes of their word numbers
        for item, size, words in pieces:
            codes = np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], np.uint32)
            for at in range(len(words) - size + 1):
                holders.setdefault(codes[at:at + size].tobytes(), set()).add(item)
        sets: dict[frozenset[str], int] = {}
        by_size: dict[int, list[tuple[bytes, int]]] = {}
        for window, items in holders.items():
            by_size.setdefault(len(window) // 4, []).append((window, sets.setdefault(frozenset(items), len(sets))))
        self.items = [sorted(s) for s in sets]  # of each set
        self.windows = {}
        for size, found in by_size.items():
            codes = np.frombuffer(b"".join(w for w, _ in found), np.uint32).reshape(-1, size)
            hashes = window_hashes(codes.T, size)[0]
            order = np.argsort(hashes, kind="stable")
            self.windows[size] = hashes[order], codes[order], np.array([s for _, s in found], np.int64)[order]

    def occurrences(self, words: list[bytes]):
        """(begin, end, set of items) of every window that occurs in ``words``."""
        import numpy as np

        none = len(self.numbers)
        codes = np.fromiter(map(self.numbers.get, words, [none] * len(words)), np.uint32, len(words))
        known = np.concatenate([[0], np.cumsum(codes < none)])
        found = []
        for size, (hashes, windows, sets) in self.windows.items():
            if len(words) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            hashed = window_hashes(codes.astype(np.uint64), size)[at]
            place = np.searchsorted(hashes, hashed)
            while len(at):  # windows of one hash are neighbours: go on while the hash is the same
                inside = np.flatnonzero(place < len(hashes))
                inside = inside[hashes[place[inside]] == hashed[inside]]
                at, hashed, place = at[inside], hashed[inside], place[inside]
                equal = (codes[at[:, None] + np.arange(size)] == windows[place]).all(1)
                found += zip(at[equal].tolist(), (at[equal] + size).tolist(), sets[place[equal]].tolist(), strict=True)
                at, hashed, place = at[~equal], hashed[~equal], place[~equal] + 1
        return sorted(found)


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that meet or overlap become one; ``spans`` in order."""
    out: list[tuple[int, int]] = []
    for begin, end in spans:
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((begin, end))
    return out


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without its words in ``spans`` and what stands between them."""
    places, kept, at = [m.span() for m in WORD.finditer(text)], [], 0
    for begin, end in spans:
        kept.append(text[at:places[begin][0]])
        at = places[end - 1][1]
    return b"".join([*kept, text[at:]])


def benchmark_pieces(benchmark: DataFrame, item: Column, text: Column) -> DataFrame:
    """(item, size of a window, words) of overlapping pieces of all items."""
    rows = benchmark.select(F.coalesce(item.cast("string"), F.lit("null")).alias("item"),
                            whole_text(text).cast("binary").alias("text"))

    def cut(batches):
        import pyarrow as pa

        kind = pa.schema([("item", pa.string()), ("size", pa.int32()), ("words", pa.list_(pa.binary()))])
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                size = min(SIZE, len(words))
                starts = range(0, len(words) - size + 1, PIECE_WORDS) if size else []
                yield pa.RecordBatch.from_pylist(
                    [{"item": item, "size": size, "words": words[a:a + PIECE_WORDS + size - 1]} for a in starts], kind)

    return rows.mapInArrow(cut, "item string, size int, words array<binary>")


def benchmark_blocks(benchmark: DataFrame, item: Column, text: Column):
    """A ``WindowIndex`` of each block of the benchmark, made when it is asked for."""
    pieces = materialize(benchmark_pieces(benchmark, item, text).distinct())
    total = pieces.agg(F.sum(F.size("words")).alias("n")).first().n or 0
    count = -(-total // BLOCK_WORDS)
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(max(count, 1))))
    for k in range(count):
        # about BLOCK_WORDS words of pieces of PIECE_WORDS at most: bounded, whatever the benchmark's size
        rows = dealt.filter(F.col("block") == k).select("item", "size", "words").collect()
        yield count, WindowIndex([(r.item, r.size, [bytes(w) for w in r.words]) for r in rows])


def scan(docs: DataFrame, text: str, n_words: str, spans: str, items: str, index: WindowIndex) -> DataFrame:
    """Add the hits of ``index`` to ``spans`` (of word numbers) and ``items`` (ids in order), and count words."""
    kept = [c for c in docs.columns if c not in (n_words, spans, items)]
    schema = with_fields(docs.select(*kept), f"`{n_words}` bigint, `{spans}` array<struct<begin:bigint,end:bigint>>, "
                                             f"`{items}` array<string>")
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def hits(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = [words_of(t or b"") for t in batch.column(text).cast(pa.binary()).to_pylist()]
                before = zip(batch.column(spans).to_pylist(), batch.column(items).to_pylist(), strict=True)
                found = []
                for words, (old, names) in zip(texts, before, strict=True):
                    new = shared.value.occurrences(words)
                    if new:
                        old = joined_spans(sorted([*((s["begin"], s["end"]) for s in old), *(n[:2] for n in new)]))
                        old = [{"begin": a, "end": b} for a, b in old]
                        names = sorted({*names, *(i for s in {n[2] for n in new} for i in shared.value.items[s])})
                    found.append((old, names))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in kept], pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([f[0] for f in found], span), pa.array([f[1] for f in found], pa.list_(pa.string()))],
                    [*kept, n_words, spans, items])

    return docs.mapInArrow(hits, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", names: tuple[str, str, str] = ("n_words", "spans", "items")) -> DataFrame:
    """``docs`` with the number of words, the spans of hit words, and the ids of the items that occur, as strings in order."""
    n_words, spans, items = names
    rows = docs.withColumns({n_words: F.lit(0).cast("bigint"), items: F.array().cast("array<string>"),
                             spans: F.array().cast("array<struct<begin:bigint,end:bigint>>")})
    scanned = False
    for count, index in benchmark_blocks(benchmark, F.col(item_id), F.col(item_text)):
        rows = scan(rows, text, n_words, spans, items, index)
        scanned = True
        if count > 1:
            rows = materialize(rows)
    return rows if scanned else scan(rows, text, n_words, spans, items, WindowIndex([]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, whole_documents: bool = False, text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the spans that occur in the benchmark, or without the documents that hold any."""
    names = tuple(fresh(docs, n) for n in ("_n_words", "_spans", "_items"))
    found = contamination(docs, benchmark, text, item_id, item_text, names)
    hit = F.size(names[1]) > 0
    if whole_documents:
        return found.filter(~hit).select(*docs.columns)

    import pandas as pd

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without_spans(t.encode(), [(s["begin"], s["end"]) for s in found]).decode() if len(found) else t
                for t, found in zip(texts, spans, strict=True)])

    return found.withColumn(text, cleaned(text, names[1])).select(*docs.columns)
