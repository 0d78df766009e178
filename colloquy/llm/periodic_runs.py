"""Runs of repeated words, found with a suffix automaton whose link tree is accessed path by path.

A run is a stretch of words with smallest period q that no neighbouring word extends, of at least
``LEAST`` words and ``POWER`` periods. The links of the automaton of all words form a tree; the path from
the class of a prefix to the root holds all suffixes of that prefix. A link-cut tree keeps the paths
of earlier prefixes as segments, each with the last end at which it was seen. Appending word i accesses
the path of its prefix: every segment on it, last seen at end e and L words long at its
deepest, says that the L words up to e and up to i are equal and that L is exact. Where i - e <= L
that is a square, and the stretch from i - L - (i - e) + 1 has period i - e. It cannot be extended to the left; the
largest i that tells of the same start and period is its right end. A segment's end is the *latest*
one, so no smaller period hides in such a stretch: it would have a later end.

Only stretches that can hold a run meet the automaton. In a run each three neighbouring words recur at least
``POWER - 1`` times, so a document is cut where three words are rarer, and the parts again by
their own counts, until nothing changes; a run is never cut. This is exact at any size, and leaves little of common prose.

At scale: a document is one row and one task walks it; nothing is shuffled. Memory is in step with the
longest stretch of such words, about 150 bytes a word of it.

Cases: a null, empty or blank text has no words, no runs and an empty collapsed text; repeated rows
are found each on their own; a null id is kept; an empty table gives an empty result; clashing
columns do not matter, as only ``keep`` and the text are read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import WORD, whole_text, with_fields

LEAST, POWER = 6, 4
ROWS = 256  # rows of an output batch
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def suffix_automaton(words: Sequence[int]) -> tuple[array, array, array]:
    """(longest length, link) of each class, from 1, the root; and the class of each prefix.

    A class has its first transition in ``word`` and ``to``; only branching ones have a table.
    """
    length, link, word, to = array("i", [0, 0]), array("i", [0, 0]), array("i", [-1, -1]), array("i", [0, 0])
    more: dict[int, dict[int, int]] = {}
    ends, last = array("i"), 1

    def add(size: int, up: int, first: int, target: int) -> int:
        length.append(size)
        link.append(up)
        word.append(first)
        to.append(target)
        return len(length) - 1

    for w in words:
        state = add(length[last] + 1, 1, -1, 0)
        p, found = last, 0
        while p:
            if word[p] == w:
                found = to[p]
                break
            if word[p] < 0:
                word[p], to[p] = w, state
            else:
                table = more.setdefault(p, {})
                if (found := table.get(w, 0)):
                    break
                table[w] = state
            p = link[p]
        if found and length[p] + 1 == length[found]:
            link[state] = found
        elif found:
            clone = add(length[p] + 1, link[found], word[found], to[found])
            if found in more:
                more[clone] = dict(more[found])
            while p:
                if word[p] == w and to[p] == found:
                    to[p] = clone
                elif p in more and more[p].get(w) == found:
                    more[p][w] = clone
                else:
                    break
                p = link[p]
            link[found] = link[state] = clone
        last = state
        ends.append(state)
    return length, link, ends


class PathSegments:
    """A link-cut tree over ``link``: preferred paths as splay trees, each with its last end.

    A tree's root holds the last end of its segment; a rotation to the root takes it along.
    """

    def __init__(self, length: array, link: array):
        self.length, self.parent = length, array("i", link)
        empty = bytes(4 * len(link))
        self.left, self.right = array("i", empty), array("i", empty)
        self.seen = array("i", [-1]) * len(link)

    def rotate(self, x: int) -> None:
        parent, left, right = self.parent, self.left, self.right
        p = parent[x]
        g = parent[p]
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x
        else:
            self.seen[x] = self.seen[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner:
            parent[inner] = p
        parent[p], parent[x] = x, g

    def splay(self, x: int) -> None:
        parent, left, right = self.parent, self.left, self.right
        while (p := parent[x]) and (left[p] == x or right[p] == x):
            g = parent[p]
            if g and (left[g] == p or right[g] == p):
                self.rotate(p if (left[g] == p) == (left[p] == x) else x)
            self.rotate(x)

    def access(self, state: int, end: int) -> Iterator[tuple[int, int]]:
        """(last end, longest length) of the segments from ``state`` to the root, which become one."""
        deeper, seen = 0, self.seen
        while state:
            self.splay(state)
            if (last := seen[state]) >= 0:
                yield last, self.length[state]
            if below := self.right[state]:
                seen[below] = last
            self.right[state] = deeper
            deeper, state = state, self.parent[state]
        seen[deeper] = end


def runs_of_stretch(words: Sequence[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in ``words`` by start, then period."""
    length, link, ends = suffix_automaton(words)
    segments, last = PathSegments(length, link), {}
    for end, state in enumerate(ends):
        for before, size in segments.access(state, end):
            period = end - before
            if period <= size:
                last[end - size - period + 1, period] = end
    return sorted((start, end - start + 1, period) for (start, period), end in last.items()
                  if end - start + 1 >= max(LEAST, POWER * period))


def repetitive_stretches(words) -> list[tuple[int, int]]:
    """(begin, end) of the parts in which every three neighbouring words occur POWER - 1 times or more.

    Triples are told apart by a 64-bit mix; were two of them taken for one, more would be kept.
    """
    import numpy as np

    found, waiting = [], [(0, len(words))]
    while waiting:
        begin, end = waiting.pop()
        if end - begin < LEAST:
            continue
        part = words[begin:end].astype(np.uint64)
        triples = (part[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ part[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ part[2:]
        _, which, counts = np.unique(triples, return_inverse=True, return_counts=True)
        common = counts[which] >= POWER - 1
        if common.all():
            found.append((begin, end))
            continue
        edges = np.flatnonzero(np.diff(common, prepend=False, append=False)).tolist()
        waiting.extend((begin + a, begin + b + 2) for a, b in zip(edges[::2], edges[1::2], strict=True))
    return sorted(found)


def runs_of_words(words: Sequence[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text by start, then period."""
    import numpy as np

    if len(words) < LEAST:
        return []
    numbers: dict[bytes, int] = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    return [(begin + start, size, period) for begin, end in repetitive_stretches(codes)
            for start, size, period in runs_of_stretch(codes[begin:end].tolist())]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, the first start and least period of equals."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def collapsed(words: Sequence[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside of runs and the first period of each, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept = bytearray(b"\1") * len(words)
    for start, size, period in runs:
        kept[start + period:start + size] = bytes(size - period)
    return b" ".join([w for w, keep in zip(words, kept, strict=True) if keep])


def find_runs(docs: DataFrame, keep: list[str], text: Column | None = None) -> DataFrame:
    """``keep`` with ``runs`` (start, length, period, by start and period), the ``strongest`` and the ``collapsed`` text."""
    rows = docs.select(*keep, whole_text(F.col("text") if text is None else text).cast("binary").alias("_words_of"))
    schema = with_fields(rows.select(*keep), f"runs array<{RUN}>, strongest {RUN}, collapsed binary")

    def find(batches):
        import pyarrow as pa

        fields = ("start", "length", "period")
        kind = pa.struct([(f, pa.int64()) for f in fields])

        def named(run):
            return None if run is None else dict(zip(fields, run, strict=True))

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                # split() parts bytes at exactly the six white-space characters that no word holds
                texts = [t.split() for t in batch.column("_words_of").to_pylist()]
                runs = [runs_of_words(words) for words in texts]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in keep],
                     pa.array([[named(r) for r in found] for found in runs], pa.list_(kind)),
                     pa.array([named(strongest(found)) for found in runs], kind),
                     pa.array(map(collapsed, texts, runs), pa.binary())],
                    [*keep, "runs", "strongest", "collapsed"])

    return rows.mapInArrow(find, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def with_repeated_tails(docs: DataFrame) -> Column:
    """The text of ``doc_id``, of one document in ten with a tail that repeats its first words.

    With h the CRC-32 of the id, n words, a = (h / 10) % n and p = 1 + (n - a) / (3 + (h / 10) % 8), the words from a
    on repeat the p words there.
    """
    h = F.crc32(docs["doc_id"].cast("string").cast("binary"))
    words = F.regexp_extract_all(whole_text(docs["text"]), F.lit(WORD), F.lit(0))

    def repeated(words: Column) -> Column:  # of a bound array: the words are found once, not once per word
        n, g = F.size(words).cast("bigint"), F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.transform(words, lambda w, i: F.when(i < a, w).otherwise(
            F.element_at(words, (a + (i - a) % p + 1).cast("int"))))

    bound = F.transform(F.array(words), lambda found: F.array_join(repeated(found), " "))
    return F.when(h % 10 == 0, bound[0]).otherwise(docs["text"])
