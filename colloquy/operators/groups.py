"""Terms and phrases of whole groups (a document, a meeting), found where the rows of the group meet.

Joins on terms write every term of every sentence to disk several times. Here the rows of a group of up to ``WHOLE``
words are dealt to one task, many groups to each, and only the few terms that can be among the best leave it. Larger
groups go the way of ``weights``, which holds none of them whole. Both give the same terms.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.plans.runtime import has_rows, materialize

WHOLE = 1 << 19  # words of a group that one task may hold
HELD = 1 << 18  # words of several groups looked at together
CLOSE = 2e-6  # sums that round alike differ by less


def by_size(rows: DataFrame, keys: list[str], words, whole: int) -> tuple[DataFrame, DataFrame | None]:
    """Written ``rows`` whose keys are no nulls: those of groups of up to ``whole`` words, and the others if there are any."""
    rows = rows.dropna(subset=keys)
    sizes = rows.groupBy(*keys).agg(F.sum(words).alias("_words"))
    large = materialize(sizes.filter(F.col("_words") > whole).select(*keys))
    if not has_rows(large):
        return rows, None
    return rows.join(large, keys, "left_anti"), rows.join(large, keys, "left_semi")


def dealt(rows: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    """The rows of each group in one task, in order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*keys, order, column).repartition(parts, *keys).sortWithinPartitions(*keys, order)


def dealt_words(rows: DataFrame, keys: list[str], order: str, words: str) -> DataFrame:
    """Words travel as one text, a third of the bytes of an array."""
    there = dealt(rows.withColumn("_text", F.array_join(words, " ")), keys, order, "_text")
    return there.select(*keys, order, F.when(F.col("_text") != "", F.split("_text", " ")).alias(words))


def _changes(columns: list) -> np.ndarray:
    """Whether each row differs from the one before it; the first does."""
    import pyarrow as pa
    import pyarrow.compute as pc

    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for column in columns:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
        out[1:] |= other.to_numpy(zero_copy_only=False)
    return out


def whole_groups(batches, keys: list[str], tokens: str, held: int = HELD):
    """Tables of whole groups, of about ``held`` words and rows in all, from batches sorted by ``keys``."""
    import pyarrow as pa
    import pyarrow.compute as pc

    parts, words = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append(batch)
        words += batch.num_rows + (pc.sum(pc.list_value_length(batch.column(tokens))).as_py() or 0)
        if words < held:
            continue
        table = pa.Table.from_batches(parts)
        last = int(np.flatnonzero(_changes([table.column(k) for k in keys]))[-1])  # where the last, perhaps unfinished group begins
        if last:
            yield table.slice(0, last).combine_chunks()
            parts = table.slice(last).to_batches()
            words = sum(b.num_rows + (pc.sum(pc.list_value_length(b.column(tokens))).as_py() or 0) for b in parts)
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks()


def _flat(table, column: str):
    """(length of each row's list, all values one after the other) of a column of lists."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = table.column(column).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, lists.flatten()


def _numbered(values):
    """(number of each value, the distinct values), numbers in the order of the values' bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    coded = values.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(pa.array(order))


def _output(table, keys: list[str], first: np.ndarray, group: np.ndarray, columns: dict):
    """Batches of the keys of ``group`` (each begins at row ``first``) and further columns."""
    import pyarrow as pa

    rows = pa.array(first[group])
    found = pa.table({**{k: table.column(k).take(rows) for k in keys}, **columns}).combine_chunks()
    yield from found.to_batches(max_chunksize=10_000)


def best_terms(keys: list[str], doc: str, top: int, max_features: int, skip: list[str] | None):
    """keys, term, raw: of each group, the terms that can be among the ``top`` of the summed weights of ``weights.tfidf``
    over single words and pairs."""
    def of_groups(table):
        import pyarrow as pa

        new = _changes([table.column(k) for k in keys])
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        doc_no = np.cumsum(_changes([table.column(k) for k in (*keys, doc)])) - 1
        sizes, values = _flat(table, "tokens")
        if not len(values):
            return
        word, names = _numbered(values)
        v, row = len(names), np.repeat(np.arange(len(sizes)), sizes)
        pair = np.flatnonzero(row[1:] == row[:-1])
        # Words and pairs, numbered by group; a stable sort brings those of a term together, row by row.
        own = group[row] * (v + v * v)
        every = np.concatenate([own + word, own[pair] + v + word[pair] * v + word[pair + 1]])
        by_term = np.argsort(every, kind="stable")
        every, row = every[by_term], np.concatenate([row, row[pair]])[by_term]
        fresh = np.ones(len(every), bool)
        fresh[1:] = every[1:] != every[:-1]
        begins = fresh.copy()
        begins[1:] |= row[1:] != row[:-1]
        entry = np.flatnonzero(begins)  # a term of a row, and how often it is there
        row, tf, spot = row[entry], np.diff(entry, append=len(every)), np.cumsum(fresh[entry]) - 1
        owner, code = np.divmod(every[fresh], v + v * v)  # a term of a group
        df, total = np.bincount(spot), np.bincount(spot, weights=tf)
        single = code < v
        left = np.where(single, code, (code - v) // v)
        right = np.where(single, -1, (code - v) % v)
        text = lambda at: [names[int(a)].as_py() if b < 0 else f"{names[int(a)].as_py()} {names[int(b)].as_py()}"
                           for a, b in zip(left[at], right[at], strict=True)]
        kept = np.ones(len(owner), bool)
        for g in np.flatnonzero(np.bincount(owner) > max_features):
            lo, hi = np.searchsorted(owner, [g, g + 1])
            least = np.sort(total[lo:hi])[::-1][max_features - 1]
            kept[lo:hi] = total[lo:hi] > least
            ties = lo + np.flatnonzero(total[lo:hi] == least)
            ties = ties[np.lexsort((right[ties], left[ties]))]  # as their texts: all characters of words come after the blank
            kept[ties[:max_features - int(kept[lo:hi].sum())]] = True
        n = np.bincount(group)[owner]
        idf = np.log((n + 1) / (df + 1)) + 1
        use = kept[spot]
        row, spot, tf = row[use], spot[use], tf[use]
        w = (np.log(tf) + 1) * idf[spot]
        length = np.sqrt(np.bincount(doc_no[row], weights=w * w, minlength=doc_no[-1] + 1))
        score = np.bincount(spot, weights=w / length[doc_no[row]], minlength=len(owner))
        if skip:
            known = {x: i for i, x in enumerate(names.to_pylist())}
            dropped = [known[s] for s in skip if s in known]
            dropped += [v + known[a] * v + known[b] for a, _, b in (s.partition(" ") for s in skip) if a in known and b in known]
            short = np.array([len(x) <= 2 for x in known])
            kept &= ~np.isin(code, dropped) & ~(single & short[left])
        at = np.flatnonzero(kept)
        at = at[np.lexsort((-score[at], owner[at]))]
        if not len(at):
            return
        start = np.flatnonzero(np.concatenate([[True], owner[at][1:] != owner[at][:-1]]))
        size = np.diff(np.concatenate([start, [len(at)]]))
        least = score[at[start + np.minimum(size, top) - 1]] - CLOSE
        at = at[score[at] >= np.repeat(least, size)]
        yield from _output(table, keys, first, owner[at], {"term": pa.array(text(at), pa.string()), "raw": pa.array(score[at])})

    def run(batches):
        for table in whole_groups(batches, keys, "tokens"):
            yield from of_groups(table)

    return run


class Phrases:
    """All phrases of the groups of ``table`` (keys, words, lowered): runs of two to five words that are no blanks.

    For each: its group, how often it is said, how many words it has, and where it is said first.
    """

    def __init__(self, table, keys: list[str], tails: list[str]):
        new = _changes([table.column(k) for k in keys])
        group, self.first = np.cumsum(new) - 1, np.flatnonzero(new)
        self.sentences = np.bincount(group)
        sizes, values = _flat(table, "words")
        self.word, self.names = _numbered(values)
        self.low, self.low_names = _numbered(_flat(table, "lowered")[1])
        row = np.repeat(np.arange(len(sizes)), sizes)
        lows = self.low_names.to_pylist()
        said = np.array([x != "" for x in lows], bool)[self.low]
        tails = set(tails)
        last = np.array([x not in tails for x in lows], bool)[self.low]
        at = np.flatnonzero(said)
        code, base = group[row[at]] * max(1, len(lows)) + self.low[at], max(1, len(lows))
        alone, found = np.zeros(len(at), bool), []
        for n in (2, 3, 4, 5):
            end = at + n - 1
            go = end < len(row)
            go[go] = (row[end[go]] == row[at[go]]) & said[end[go]]
            at, code, alone, end = at[go], code[go], alone[go], end[go]
            count, begins = np.ones(len(at), np.int64), np.ones(len(at), bool)
            many = np.flatnonzero(~alone)  # a run that is there once makes no longer one that is there twice
            _, where, code, times = np.unique(code[many] * base + self.low[end[many]], return_index=True, return_inverse=True, return_counts=True)
            count[many], begins[many] = times[code], False
            begins[many[where]] = True
            alone = count == 1
            full = np.zeros(len(at), np.int64)
            full[many] = code
            code = full
            use = begins & last[end]
            found.append((group[row[at[use]]], count[use], np.full(int(use.sum()), n), at[use]))
        self.group, self.n, self.size, self.at = (np.concatenate([f[k] for f in found]) for k in range(4))

    def words(self, i: int) -> list[int]:
        return self.low[self.at[i]:self.at[i] + self.size[i]].tolist()

    def text(self, i: int, lowered: bool) -> str:
        numbers, names = (self.low, self.low_names) if lowered else (self.word, self.names)
        return " ".join(names[int(x)].as_py() for x in numbers[self.at[i]:self.at[i] + self.size[i]])

    def ranked(self, among: np.ndarray, head: int) -> np.ndarray:
        """Of each group among these phrases, the first ``head`` at least: by count, words and label.

        Words are letters only, so labels compare as the lists of their words do.
        """
        kind = np.where(self.n[among] < 15, self.n[among] * 8 + self.size[among], 127)  # few are said more often than that
        width = 128
        counts = np.bincount(self.group[among] * width + kind, minlength=(self.group.max(initial=0) + 1) * width).reshape(-1, width)
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1]  # as good or better
        least = np.where(above[:, 0] <= head, 0, width - 1 - (above[:, ::-1] >= head).argmax(axis=1))
        among = among[kind >= least[self.group[among]]]
        places = [np.where(k < self.size[among], self.word[np.minimum(self.at[among] + k, len(self.word) - 1)], -1) for k in range(5)]
        among = among[np.lexsort((*places[::-1], -self.size[among], -self.n[among], self.group[among]))]
        return among


def best_phrases(keys: list[str], limit: int, head: int, tails: list[str]):
    """keys, label, phrase, n, total: of each group the first ``limit`` phrases whose words no better one holds."""
    def run(batches):
        import pyarrow as pa

        for table in whole_groups(batches, keys, "words"):
            every = Phrases(table, keys, tails)
            chosen, among, ahead = [], np.arange(len(every.at)), head
            while len(among):
                left, sizes = [], np.bincount(every.group[among])
                ranked = every.ranked(among, ahead)
                cuts = np.flatnonzero(np.diff(every.group[ranked], prepend=-1))
                for lo, hi in zip(cuts, [*cuts[1:], len(ranked)], strict=True):
                    kept, sets = [], []
                    for i in ranked[lo:hi]:
                        words = set(every.words(i))
                        if not any(words <= s for s in sets):
                            kept.append(i)
                            sets.append(words)
                            if len(kept) == limit:
                                break
                    g = every.group[ranked[lo]]
                    if len(kept) < limit and hi - lo < sizes[g]:
                        left.append(g)  # not settled yet
                    else:
                        chosen += kept
                among, ahead = among[np.isin(every.group[among], left)], ahead * 16
            if chosen:
                at = np.array(chosen)
                yield from _output(table, keys, every.first, every.group[at], {
                    "label": pa.array([every.text(i, False) for i in at], pa.string()), "phrase": pa.array([every.text(i, True) for i in at], pa.string()),
                    "n": pa.array(every.n[at]), "total": pa.array(every.sentences[every.group[at]])})

    return run


def most_said(keys: list[str], tails: list[str]):
    """keys, phrase: of each group the phrase that is said most often, then the longest, then the last in order."""
    def run(batches):
        import pyarrow as pa

        for table in whole_groups(batches, keys, "words"):
            every = Phrases(table, keys, tails)
            if not len(every.at):
                continue
            letters = np.array([len(x) for x in every.low_names.to_pylist()], np.int64)[every.low]
            upto = np.concatenate([[0], np.cumsum(letters)])
            length = upto[every.at + every.size] - upto[every.at] + every.size - 1
            order = np.lexsort((length, every.n, every.group))
            last = np.flatnonzero(np.diff(every.group[order], append=-1))
            best = np.zeros((every.group.max() + 1, 2), np.int64)
            best[every.group[order[last]]] = np.stack([every.n[order[last]], length[order[last]]], 1)
            found: dict[int, str] = {}
            for i in np.flatnonzero((every.n == best[every.group, 0]) & (length == best[every.group, 1])):
                g = int(every.group[i])
                found[g] = max(found.get(g, ""), every.text(i, True))
            yield from _output(table, keys, every.first, np.array([*found]), {"phrase": pa.array([*found.values()], pa.string())})

    return run
