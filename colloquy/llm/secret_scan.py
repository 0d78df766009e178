"""Secret scans: fixed patterns, and a character network over every other candidate.

Base findings come from three patterns over the whole text. Candidates are all runs of at least ``SHORTEST``
token characters that hold a digit, and all values after an assignment sign, also inside each other and
beyond a base finding. Each candidate is
seen in a window of its own characters and its surroundings (inside and outside are different symbols; a base
finding is outside), one of more than ``INSIDE`` characters in windows every ``STEP`` characters, of which the largest
score counts, and
scored by a convolutional network in numpy (``cnn``), trained on every whole document:
all findings, against all other
candidates and all long plain words, equal windows once. Findings are also learned in the surroundings of other
candidates, so the network knows them without a tell-tale word before them. The windows are dealt by a hash over shards
of about ``SHARD``; in each pass all shards learn at once, each from the same network, and what they have learned is
averaged. A first pass over one shard gives them a common start. Many windows take fewer passes (``passes``).

Scores are calibrated (a scale and a shift fitted on spans that the network did not learn from, one in four by a hash, all
counted by their log odds in steps of 1/``STEPS``). The
threshold is ``CONFIDENT``, or as low as it must be to find ``RECALL`` of the findings of each kind
there; the recall reached and the share of other candidates over the threshold are part of the model. Base findings always stay; a
candidate over the threshold adds a span of kind `model`, and of overlapping candidates the one of the highest score does (the
shorter, then the first of equal ones).

Cases: a null text is empty and has no findings; with no finding or nothing else to learn from
there is no network and only base findings are given; the longest texts are
read whole; ties between kinds at one start follow the order of the kinds; repeated rows get equal
spans; an empty table gives an empty result.
"""

from __future__ import annotations

import copy
import math
import re
from bisect import bisect_right
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import cnn
from colloquy.llm.common import whole_text, with_fields
from colloquy.plans.runtime import materialize

KINDS = ("assign", "access", "hex", "model")
# The base patterns. A dropped match of `assign` still uses up its characters; for
# the other two, a run that is long enough is found whole, so the least length is in the pattern.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 12
ASSIGNED = ("passw", "secret", "token", "api")  # each match of `assign` begins with one of them
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

SHORTEST = 12
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)
SIGN = re.compile(r"""[A-Za-z0-9_]["']?\x20*[:=]\x20*["']?(?=[^\s"']{%d})""" % SHORTEST)
VALUE_END = re.compile(r"""[\s"']|\Z""")
NAME = re.compile(r"[A-Za-z_.-]*")
PLAIN = re.compile(r"(?<![^\W\d_])[^\W\d_]{%d,}" % SHORTEST)
DIGIT = re.compile(r"[0-9]")

SHARD = 1 << 15  # windows that one task learns from at a time, about
REPEATS = 8  # times that a window of a rare class is seen in a pass, at most
EXACT = 1 << 30  # parameters are added up as whole numbers of 1/EXACT, so that their order does not matter
STEPS = 256  # of log odds, to the unit
RECALL, CONFIDENT = 0.98, 0.9
DOUBT = 0.5  # other candidates that look this much like findings are not learned from
CONTEXT, INSIDE, STEP = 20, 40, 8  # characters on either side, of the candidate, and from window to window
WINDOW = 2 * CONTEXT + INSIDE
AT_ONCE = 4096  # windows


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in code points, sorted."""
    low, found = text.lower() if ":" in text or "=" in text else "", []
    if any(name in low for name in ASSIGNED):
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, apart) of all spans that may be secrets, sorted; apart from base findings, or reaching beyond them.

    The rest of a name before an assigned value reaches beyond nothing.
    """
    spans = {m.span() for m in RUN.finditer(text) if DIGIT.search(text, *m.span())}
    end = -1
    for m in SIGN.finditer(text) if ":" in text or "=" in text else ():
        if m.end() >= end:
            end = VALUE_END.search(text, m.end()).start()
        spans.add((m.end(), end))
    if not base:
        return [(s, e, True) for s, e in sorted(spans)]
    covered = merged(base)
    ends, found = [e for _, e in covered], []
    names = {s for s, kind, _ in base if kind == 0}
    for start, stop in sorted(spans):
        at, k, beyond, apart = start, bisect_right(ends, start), False, True
        while at < stop and not beyond:
            low, high = covered[k] if k < len(covered) else (stop, stop)
            if low >= stop:
                apart = apart and at == start
                beyond = True
            else:
                apart = False
                beyond = at < low and not (low in names and at == start and NAME.fullmatch(text, at, low))
                at, k = high, k + 1
        if beyond:
            found.append((start, stop, apart))
    return found


def merged(base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The stretches that base findings cover."""
    stretches = []
    for start, _, end in base:
        if stretches and start <= stretches[-1][1]:
            stretches[-1] = (stretches[-1][0], max(end, stretches[-1][1]))
        else:
            stretches.append((start, end))
    return stretches


def codes_of(text: str) -> np.ndarray:
    """1..127 for ASCII, 128 for the rest."""
    return np.clip(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 1, 128).astype(np.uint8)


def views(start: int, end: int, step: int = STEP) -> list[tuple[int, int]]:
    """The stretches in which a span is seen: itself, or its start, its end and all multiples of ``step`` between."""
    if end - start <= INSIDE:
        return [(start, end)]
    grid = range(start // step * step + step, end - INSIDE, step)
    return [(start, start + INSIDE), *((at, at + INSIDE) for at in grid), (end - INSIDE, end)]


class Views:
    """Windows of a text, each once, and the candidates that they belong to."""

    def __init__(self, text: str, spans: list[tuple[int, int, bool]], base: list[tuple[int, int, int]]):
        self.text, self.spans, self.base = text, [x[:2] for x in spans], base
        self.codes = self.known = None
        grid = set()
        for first, last in merged([(s, 0, e) for s, e in self.spans if e - s > INSIDE]):
            grid.update(range(first // STEP * STEP + STEP, last - INSIDE, STEP))
        self.grid = np.array(sorted(grid), np.int64)
        short = {(s, min(e, s + INSIDE)) for s, e in self.spans} | {(e - INSIDE, e) for s, e in self.spans if e - s > INSIDE}
        self.place = {x: k + len(self.grid) for k, x in enumerate(sorted(short))}
        self.where = np.concatenate([np.stack([self.grid, self.grid + INSIDE], 1), np.array(list(self.place), np.int64).reshape(-1, 2)])

    def windows(self, first: int, last: int) -> np.ndarray:
        """Symbols of the windows from first to last."""
        if self.codes is None:
            self.codes = codes_of(self.text)
            self.known = np.zeros(len(self.codes), bool)
            for start, _, end in self.base:
                self.known[start:end] = True
        start, end = self.where[first:last, :1], self.where[first:last, 1:]
        at = start - CONTEXT + np.arange(WINDOW)
        spot = np.clip(at, 0, len(self.codes) - 1)
        outside = (at < start) | (at >= end) | self.known[spot]
        rows = np.where((at == spot) & (at < end + CONTEXT), self.codes[spot] + 128 * outside, 0)
        if last >= len(self.where):
            self.codes = self.known = None
        return rows

    def scores(self, of_window: np.ndarray) -> np.ndarray:
        """The largest score of the windows of each candidate."""
        out = np.empty(len(self.spans))
        lows = np.searchsorted(self.grid, [s for s, _ in self.spans], side="right")
        highs = np.searchsorted(self.grid, [e - INSIDE for _, e in self.spans])
        for k, (s, e) in enumerate(self.spans):
            out[k] = of_window[self.place[s, min(e, s + INSIDE)]]
            if e - s > INSIDE:
                out[k] = max(out[k], of_window[self.place[e - INSIDE, e]], *([of_window[lows[k]:highs[k]].max()] if lows[k] < highs[k] else []))
        return out

    def settled(self, scores: np.ndarray, threshold: float) -> list[tuple[int, int]]:
        """Candidates over the threshold; of overlapping ones, that of the highest score."""
        order = sorted((-p, e - s, s, e) for p, (s, e) in zip(scores.tolist(), self.spans, strict=True) if p >= threshold)
        taken: list[tuple[int, int]] = []
        for _, _, s, e in order:
            k = bisect_right(taken, (s, e))
            if not (k and taken[k - 1][1] > s or k < len(taken) and taken[k][0] < e):
                taken.insert(k, (s, e))
        return taken


def symbols(text: str, outside: bool) -> list[int]:
    """1..127 for ASCII, 128 for the rest; outside a candidate 128 more."""
    return [(min(ord(c), 128) or 1) + (128 if outside else 0) for c in text]


SYMBOLS = 257


def window(before: str, inside: str, after: str) -> np.ndarray:
    row = np.zeros(WINDOW, np.int64)
    left, mid, right = symbols(before[-CONTEXT:], True), symbols(inside, False), symbols(after[:CONTEXT], True)
    row[CONTEXT - len(left):CONTEXT + len(mid) + len(right)] = left + mid + right
    return row


def _learning_windows(batches):
    """(kind, n, w) of findings, other candidates (-1) and long plain words (-2): ``w`` is the codes, ``n`` of them inside."""
    import pyarrow as pa

    def batch_of(kinds, sizes, rows):
        data = np.concatenate(rows)
        offsets = np.arange(len(data) + 1, dtype=np.int32) * WINDOW
        w = pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds), pa.int32()), pa.array(np.concatenate(sizes), pa.int32()), w],
                                          ["kind", "n", "w"])

    for batch in batches:
        kinds, sizes, rows, size = [], [], [], 0
        for text in batch.column("text").to_pylist():
            base = base_findings(text)
            spans = [(k, s, e) for s, k, e in base] + [(-1, s, e) for s, e, apart in candidates(text, base) if apart]
            spans += [(-2, *m.span()) for m in PLAIN.finditer(text)]
            places = []
            for kind, start, end in spans:
                if kind == 0:  # learn the value, with its name and sign as its surroundings
                    start = ASSIGN.match(text, start).start(2)
                places += [(kind, s, e) for s, e in views(start, end, INSIDE)]
            codes = codes_of(text)
            for first in range(0, len(places), AT_ONCE):
                kind, start, end = np.array(places[first:first + AT_ONCE], np.int64).T
                at = start[:, None] - CONTEXT + np.arange(WINDOW)
                spot = np.clip(at, 0, len(codes) - 1)
                rows.append(np.where((at == spot) & (at < end[:, None] + CONTEXT), codes[spot], 0).astype(np.uint8))
                kinds.append(kind)
                sizes.append(end - start)
                size += len(kind)
                if size >= AT_ONCE:
                    yield batch_of(kinds, sizes, rows)
                    kinds, sizes, rows, size = [], [], [], 0
        if rows:
            yield batch_of(kinds, sizes, rows)


PACKED = "shard int, kind binary, n binary, learn binary, w binary"


def learning_shards(docs: DataFrame) -> DataFrame:
    """All different windows of all texts, one row a shard; which window is where depends on nothing but its content."""
    texts = docs.select(whole_text(F.col("text")).alias("text"))
    windows = materialize(texts.mapInArrow(_learning_windows, "kind int, n int, w binary").distinct())
    shards = max(1, math.ceil(windows.count() / SHARD))
    h = F.xxhash64("kind", "n", "w")

    def packed(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["h", "w", "kind", "n"])
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "kind": [pdf["kind"].to_numpy(np.int8).tobytes()],
                             "n": [pdf["n"].to_numpy(np.uint8).tobytes()], "learn": [(pdf["h"].to_numpy() % 4 != 0).tobytes()],
                             "w": [b"".join(pdf["w"])]})

    dealt = windows.withColumn("h", h).withColumn("shard", F.pmod(F.shiftright("h", 8), F.lit(shards)).cast("int"))
    return materialize(dealt.repartition(shards, "shard").groupBy("shard").applyInPandas(packed, PACKED))


class Shard(NamedTuple):
    number: int
    kind: np.ndarray
    n: np.ndarray
    learn: np.ndarray
    codes: np.ndarray

    def alone(self) -> np.ndarray:
        """The windows without their surroundings."""
        return np.where(outside(self.n), 0, self.codes).astype(np.int16)

    def examples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows, kinds, learned from): all windows, and findings once more in the surroundings of others."""
        rows, other = np.flatnonzero(self.kind >= 0), np.flatnonzero(self.kind < 0)
        codes, n = self.codes, self.n
        kind, learn = self.kind, self.learn
        if len(rows) and len(other):
            around = other[rows * 7919 % len(other)]
            place, own, its = np.arange(WINDOW), n[rows][:, None], n[around][:, None]
            after = np.take_along_axis(codes[around], np.clip(place - own + its, 0, WINDOW - 1), axis=1)
            swapped = np.where(place < CONTEXT, codes[around], np.where(place < CONTEXT + own, codes[rows], after))
            codes = np.concatenate([codes, np.where(place < 2 * CONTEXT + own, swapped, 0)])
            n, kind, learn = (np.concatenate([x, x[rows]]) for x in (n, kind, learn))
        return np.where(codes > 0, codes + 128 * outside(n), 0).astype(np.int16), kind, learn


def outside(n: np.ndarray) -> np.ndarray:
    place = np.arange(WINDOW)
    return (place < CONTEXT) | (place >= CONTEXT + n[:, None])


def over_shards(shards: DataFrame, work, schema: str) -> DataFrame:
    """The columns that ``work`` gives for each ``Shard``, one after the other."""
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                number, kind, n, learn, w = (batch.column(name)[k].as_py() for name in ("shard", "kind", "n", "learn", "w"))
                shard = Shard(number, np.frombuffer(kind, np.int8).astype(int), np.frombuffer(n, np.uint8).astype(int),
                              np.frombuffer(learn, bool), np.frombuffer(w, np.uint8).reshape(-1, WINDOW))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in work(shard)], names)

    return shards.mapInArrow(run, schema)


def window_counts(shards: DataFrame) -> dict[tuple[int, bool], int]:
    """Windows of each (kind, learned from)."""
    def work(shard):
        keys, counts = np.unique(shard.kind * 2 + shard.learn, return_counts=True)
        return keys.astype(np.int32), counts.astype(np.int64)

    rows = over_shards(shards, work, "key int, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return {(r.key >> 1, bool(r.key & 1)): r.n for r in rows}


def passes(windows: int) -> int:
    """Over all windows: six, fewer where there are many, as each pass then has more steps."""
    return max(1, min(6, 600_000 // max(1, windows)))


class Network(cnn.SymbolCnn):
    """The same network with its steps in fewer and larger operations, for millions of windows."""

    def _forward(self, windows: np.ndarray):
        x = np.lib.stride_tricks.sliding_window_view(self.embed[windows], self.span, axis=1)  # (n, places, dim, span)
        places = x.shape[1]
        maps = (np.ascontiguousarray(x).reshape(len(windows) * places, -1)
                @ self.conv.transpose(1, 0, 2).reshape(-1, self.conv.shape[2])).reshape(len(windows), places, -1)
        best = maps.argmax(axis=1)
        top = np.take_along_axis(maps, best[:, None, :], axis=1)[:, 0] + self.bias
        return best, top, np.maximum(top, 0)

    def _gradients(self, windows, labels, weights):
        n, (best, top, hidden) = len(labels), self._forward(windows)
        error = cnn.softmax(hidden @ self.out + self.shift)
        error[np.arange(n), labels] -= 1
        error *= (weights / n)[:, None]
        back = (error @ self.out.T) * (top > 0)  # (n, filters)
        d_embed, d_conv, filters = np.zeros_like(self.embed), np.zeros_like(self.conv), back.shape[1]
        for o in range(self.span):
            seen = np.take_along_axis(windows, best + o, axis=1)  # symbol under each filter's maximum
            by_symbol = np.bincount((seen.astype(np.int64) * filters + np.arange(filters)).ravel(), back.ravel(),
                                    self.symbols * filters).reshape(self.symbols, filters).astype(np.float32)
            d_conv[o] = self.embed.T @ by_symbol
            d_embed += by_symbol @ self.conv[o].T
        return [d_embed, d_conv * self.mask, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]


def fitted(shards: DataFrame, examples, counts: np.ndarray) -> Network:
    """A network for kind >= 0; findings, other candidates and plain words weigh half, a quarter and a quarter.

    ``counts`` are those of plain words, other candidates and findings among the ``examples`` of all shards.
    """
    total, counts = int(counts.sum()), np.maximum(counts, 1)
    weights = np.array([1, 1, 2]) * total / 4 / counts
    repeats = np.clip(np.array([1, 1, 2]) * total // (4 * counts), 1, REPEATS)

    def learned(network, rate, epochs):
        def work(shard):
            windows, kind = examples(shard)
            group = np.clip(kind, -2, 0) + 2
            rows = np.repeat(np.arange(len(kind)), repeats[group])
            own = copy.deepcopy(network)
            if len(rows):
                own.fit(windows[rows], (kind[rows] >= 0).astype(int), (weights / repeats)[group[rows]], epochs=epochs, rate=rate,
                        seed=11 + shard.number)
            flat = np.concatenate([p.ravel() for p in own._params()]).astype(float)
            return np.arange(len(flat), dtype=np.int32), np.round(flat * EXACT).astype(np.int64)
        return work

    network, rate = Network(SYMBOLS, 2, dim=8, widths=(3, 4, 6), filters=12), 0.01
    many = shards.count() > 1
    rounds = [(shards.filter("shard = 0"), 1), *[(shards, 1)] * passes(total)] if many else [(shards, passes(total))]
    for some, epochs in rounds:
        rows = over_shards(some, learned(network, rate, epochs), "at int, value bigint").groupBy("at").agg(
            F.sum("value").alias("value"), F.count(F.lit(1)).alias("n")).collect()
        flat = np.array([r.value / r.n / EXACT for r in sorted(rows, key=lambda r: r.at)])
        for p in network._params():
            p[...], flat = flat[:p.size].reshape(p.shape), flat[p.size:]
        rate *= 0.8
    network.tables = None
    return network


class Model(NamedTuple):
    """``recall`` by kind of finding and ``wrong``, the share of other candidates and plain words over the threshold,
    on spans that the network did not learn from."""

    network: Network
    scale: float
    shift: float
    threshold: float
    recall: dict[str, float]
    wrong: dict[str, float]


def train(docs: DataFrame) -> Model | None:
    """A ``Model``, or None where there is nothing to learn from.

    What the patterns miss is among the other candidates, so these are not all examples of harmless text:
    a first network sees candidates without their surroundings, and those that look like
    findings to it are left out of what the final network learns from.
    """
    shards = learning_shards(docs)
    counts = window_counts(shards)
    if not any(k >= 0 for k, _ in counts) or not any(k < 0 for k, _ in counts):
        return None
    of = lambda some, twice: np.array([sum(n for (k, _), n in some.items() if g(k)) for g in (
        lambda k: k == -2, lambda k: k == -1, lambda k: k >= 0)]) * np.array([1, 1, 2 if twice else 1])
    first = fitted(shards, lambda x: (x.alone(), x.kind), of(counts, False))

    def clear(x):
        keep = x.kind >= 0
        keep[~keep] = first.probabilities(x.alone()[~keep])[:, 1] < DOUBT
        return np.array([x.number], np.int32), *([part.astype(t)[keep].tobytes()] for part, t in zip(x[1:], (np.int8, np.uint8, bool, np.uint8), strict=True))

    left = materialize(over_shards(shards, clear, PACKED))
    left_counts = window_counts(left)
    if any(k < 0 for k, _ in left_counts):
        shards, counts = left, left_counts
    # Where a hash puts all on one side, that side is both learned from and checked with.
    sides = {learn for _, learn in counts}
    part = lambda x, side: (x[0], x[1]) if len(sides) == 1 else (x[0][x[2] == side], x[1][x[2] == side])
    learned = counts if len(sides) == 1 else {key: n for key, n in counts.items() if key[1]}
    network = fitted(shards, lambda x: part(x.examples(), True), of(learned, True))

    def judged(x):
        windows, kind = part(x.examples(), False)
        step = np.floor(log_odds(network, windows) * STEPS).astype(int)
        keys, n = np.unique(np.stack([kind, step]), axis=1, return_counts=True)
        return keys[0].astype(np.int32), keys[1].astype(np.int32), n.astype(np.int64)

    rows = over_shards(shards, judged, "kind int, step int, n bigint").groupBy("kind", "step").agg(F.sum("n").alias("n")).collect()
    kind, step, n = np.array(sorted(tuple(r) for r in rows), np.int64).reshape(-1, 3).T
    scale, shift = calibrate((step + 0.5) / STEPS, kind >= 0, n)
    chance = 1 / (1 + np.exp(-(scale * step / STEPS + shift)))  # at least that for all of a step
    threshold = CONFIDENT
    for k in range(3):
        own = np.flatnonzero(kind == k)[::-1]  # from the highest step
        if len(own):
            threshold = min(threshold, float(chance[own[np.searchsorted(np.cumsum(n[own]), RECALL * n[own].sum() - 1e-9)]]))
    share = lambda k, over: float(n[(kind == k) & over].sum() / max(1, n[kind == k].sum()))
    found = {KINDS[k]: share(k, chance >= threshold) for k in range(3) if (kind == k).any()}
    beyond = 1 / (1 + np.exp(-(scale * (step + 1) / STEPS + shift))) >= threshold
    return Model(network, scale, shift, threshold, found, {"other": share(-1, beyond), "plain": share(-2, beyond)})


def log_odds(network, windows: np.ndarray) -> np.ndarray:
    p = np.clip(network.probabilities(windows)[:, 1].astype(float), 1e-7, 1 - 1e-7)
    return np.log(p / (1 - p))


def calibrate(odds: np.ndarray, truth: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the log odds, of which there are ``n`` each, by Newton's method with a small ridge."""
    x, y, w = np.stack([odds, np.ones_like(odds)], 1), truth.astype(float), np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + 0.1 * (w - [1, 0])
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        w = w - np.linalg.solve(curve, slope)
    return float(max(w[0], 0.05)), float(w[1])


def bounded(seen: list) -> list[list]:
    """Views of texts in runs of some thousand windows, or of one text."""
    runs, size = [], 0
    for n, view in seen:
        if not runs or size > AT_ONCE:
            runs.append([])
            size = 0
        runs[-1].append((n, view))
        size += len(view.where)
    return runs


def stacked(some: list):
    """The windows of all texts, about ``AT_ONCE`` at a time."""
    held, size = [], 0
    for _, view in some:
        for at in range(0, len(view.where), AT_ONCE):
            held.append(view.windows(at, at + AT_ONCE))
            size += len(held[-1])
            if size >= AT_ONCE:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def find_secrets(docs: DataFrame, model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The id and ``findings``: kind, start, end (code points, end exclusive), by start, then kind."""
    schema = with_fields(docs.select(id_col), "findings array<struct<kind: string, start: int, end: int>>")

    def scan(batches):
        import pyarrow as pa

        if model is not None:
            network, scale, shift, threshold = model[:4]
            network.folded()
        kind_of = pa.array(KINDS)
        for batch in batches:
            results, seen = [], []
            for n, value in enumerate(batch.column("_text").to_pylist()):
                found = base_findings(value)
                if model is not None and (spans := candidates(value, found)):
                    seen.append((n, Views(value, spans, found)))
                results.append(found)
            for some in bounded(seen):
                chance = [p for rows in stacked(some) for p in 1 / (1 + np.exp(-(scale * log_odds(network, rows) + shift)))]
                at = 0
                for n, view in some:
                    scores = view.scores(np.array(chance[at:at + len(view.where)]))
                    results[n] = results[n] + [(s, 3, e) for s, e in view.settled(scores, threshold)]
                    at += len(view.where)
            flat = np.array([f for found in results for f in sorted(found)], np.int32).reshape(-1, 3)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in results])]).astype(np.int32)
            findings = pa.StructArray.from_arrays(
                [kind_of.take(pa.array(flat[:, 1])), pa.array(flat[:, 0].copy()), pa.array(flat[:, 2].copy())],
                ["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.ListArray.from_arrays(pa.array(offsets), findings)], [id_col, "findings"])

    if model is not None:
        model[0].tables = None  # they are made again in each task, from far fewer bytes
    return docs.select(id_col, whole_text(F.col(text)).alias("_text")).mapInArrow(scan, schema)
