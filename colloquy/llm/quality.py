"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` bytes. Each passage is encoded from the shares of pairs of
character classes in it and of how often a byte equals the one k places before (words that
repeat show up at their length), through one hidden layer. Gated attention weighs the passages, and
the weighted mean of their codes is scored. Everything is learned in numpy from document
labels only, on a bounded sample: at most about ``PER_CLASS`` labelled documents of each class of up to
``SAMPLE_BYTES`` bytes, chosen by a hash of the id. The final scale and shift are fitted on a
quarter of them that the network did not learn from, with the classes at their shares in the corpus.

Every passage of every whole text is scored; a text needs two numbers per passage at
the end, so long texts are scored in parts without loss.

Cases: a null text is empty; an empty text is one empty passage and gets a score; without labels
of both classes the score is the share of label 1 (0.5 without any); rows with equal ids
share labels, and of contradicting labels the lowest counts; a null id has no label and counts as
the empty text in the hash that holds rows out; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm import cnn
from colloquy.llm.common import unsigned_share, whole_text, with_fields

PASSAGE = 512
PER_CLASS = 3000
SAMPLE_BYTES = 1 << 16
HIDDEN, ATTENTION = 32, 16
LAGS = range(2, 26)
CUT = 0.3

CLASSES = 16


def byte_classes() -> np.ndarray:
    """0 padding, 1 lower case, 2 upper case, 3 digit, 4 blank, 5 line end, 6 beyond ASCII, then marks."""
    table = np.full(256, 15, np.uint8)
    table[0] = 0
    table[ord("a"):ord("z") + 1], table[ord("A"):ord("Z") + 1] = 1, 2
    table[ord("0"):ord("9") + 1], table[ord(" ")], table[[10, 13]], table[128:] = 3, 4, 5, 6
    for k, marks in enumerate([".", ",", "!?", "|<>", "#$%&*@^~", "\"'`", "()[]{}", "=+-_/\\:;"]):
        table[[ord(m) for m in marks]] = 7 + k
    return table


FEATURES = CLASSES * CLASSES + len(LAGS)


def passage_features(matrix: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    n = len(matrix)
    classes = byte_classes()[matrix].astype(np.int32)
    codes = classes[:, :-1] * CLASSES + classes[:, 1:] + (np.arange(n, dtype=np.int32) * CLASSES ** 2)[:, None]
    out = np.empty((n, FEATURES), np.float32)
    out[:, :CLASSES ** 2] = np.bincount(codes.ravel(), minlength=n * CLASSES ** 2).reshape(n, -1)
    out[:, 0] = 0  # padding beside padding
    for k, lag in enumerate(LAGS):
        same = (matrix[:, lag:] == matrix[:, :-lag]) & (matrix[:, lag:] > 0)
        out[:, CLASSES ** 2 + k] = same.sum(axis=1)
    return np.sqrt(out / np.maximum(sizes, 1)[:, None])


class BagNetwork:
    """Hidden layer, gated attention over the passages of a bag, logistic score."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        make = lambda a, b: rng.normal(0, a ** -0.5, (a, b)).astype(np.float32)
        self.params = [make(FEATURES, HIDDEN), np.zeros(HIDDEN, np.float32), make(HIDDEN, ATTENTION),
                       make(HIDDEN, ATTENTION), make(ATTENTION, 1)[:, 0], make(HIDDEN, 1)[:, 0], np.zeros(1, np.float32)]
        self.mean, self.spread, self.scale, self.offset = None, None, 1.0, 0.0

    def code(self, features: np.ndarray):
        x = (features - self.mean) / self.spread
        return x, np.tanh(x @ self.params[0] + self.params[1])

    def passages(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Attention before the softmax, and the passage's part of the score."""
        _, h = self.code(features)
        _, _, v, u, w, c, _ = self.params
        return (np.tanh(h @ v) / (1 + np.exp(-(h @ u)))) @ w, h @ c

    def gradients(self, features, bag, n, truth, weights):
        """``bag``: number of each passage's document among the n of the batch, in order."""
        _, _, v, u, w, c, c0 = self.params
        x, h = self.code(features)
        left, gate = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = (left * gate) @ w
        first = np.searchsorted(bag, np.arange(n))
        share = np.exp(e - np.maximum.reduceat(e, first)[bag])
        share /= np.add.reduceat(share, first)[bag]
        z = np.add.reduceat(share[:, None] * h, first)
        score = 1 / (1 + np.exp(-(z @ c + c0[0])))
        error = (weights * (score - truth) / n).astype(np.float32)
        d_z = error[:, None] * c
        value = (h * d_z[bag]).sum(axis=1)
        d_e = share * (value - np.add.reduceat(share * value, first)[bag])
        d_left, d_gate = d_e[:, None] * w * gate * (1 - left ** 2), d_e[:, None] * w * left * gate * (1 - gate)
        d_h = (share[:, None] * d_z[bag] + d_left @ v.T + d_gate @ u.T) * (1 - h ** 2)
        return [x.T @ d_h, d_h.sum(axis=0), h.T @ d_left, h.T @ d_gate, (left * gate).T @ d_e, z.T @ error,
                np.array([error.sum()], np.float32)]

    def fit(self, features, bag, truth, weights, epochs: int = 25, batch: int = 128, rate: float = 0.01):
        self.mean, self.spread = features.mean(axis=0), features.std(axis=0) + 0.02
        rng = np.random.default_rng(13)
        ends = np.searchsorted(bag, np.arange(len(truth) + 1))
        first, second, step = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params], 0
        for _ in range(epochs):
            order = rng.permutation(len(truth))
            for at in range(0, len(order), batch):
                docs = order[at:at + batch]
                rows = np.concatenate([np.arange(ends[d], ends[d + 1]) for d in docs])
                own = np.repeat(np.arange(len(docs)), ends[docs + 1] - ends[docs])
                step += 1
                grads = self.gradients(features[rows], own, len(docs), truth[docs], weights[docs])
                for p, g, m, s in zip(self.params, grads, first, second, strict=True):
                    g = g + 1e-4 * p
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-6)
            rate *= 0.9
        return self

    def log_odds(self, attention, value, owners, n) -> np.ndarray:
        """Of n documents from their passages' numbers, in order of ``owners``; every document has one."""
        first = np.searchsorted(owners, np.arange(n))
        share = np.exp(attention - np.maximum.reduceat(attention, first)[owners])
        return np.add.reduceat(share * value, first) / np.add.reduceat(share, first) + self.params[6][0]

    def chance(self, odds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * odds + self.offset, -40, 40)))


def all_passages(data: np.ndarray, offsets: np.ndarray):
    """``cnn.text_windows``, with one empty passage for an empty text (given first)."""
    empty = np.flatnonzero(np.diff(offsets) == 0)
    if len(empty):
        yield np.zeros((len(empty), PASSAGE), np.uint8), empty, np.zeros(len(empty), np.int64)
    yield from cnn.text_windows(data, offsets, PASSAGE)


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[DataFrame, dict]:
    """(text, quality) of a bounded sample, and the number of labelled rows of each class."""
    known = (labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = unsigned_share(F.xxhash64(F.lit("quality"), "doc_id"))
    limit = F.coalesce(*[F.when(F.col("quality") == q, F.lit(per_class / n)) for q, n in counts.items()], F.lit(0.0))
    few = known.withColumn("chance", chance).filter(F.col("chance") < limit)
    texts = docs.select("doc_id", whole_text(F.col("text")).alias("text")).filter(
        F.octet_length("text") <= SAMPLE_BYTES)
    # About per_class rows of 20 bytes for each of two classes, whatever the size of the tables.
    return texts.join(F.broadcast(few), "doc_id").select("text", "quality", "chance"), counts


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS):
    """A network, or the share of label 1 where there are not two classes to learn."""
    sample, counts = training_sample(docs, labels, per_class)
    if len(counts) < 2:
        return float(max(counts)) if counts else 0.5
    rows = sorted(sample.collect(), key=lambda r: (r.chance, r.text, r.quality))
    truth = np.array([r.quality for r in rows], np.float32)
    if len(set(truth.tolist())) < 2:
        return counts[1] / (counts[0] + counts[1])
    raw = [r.text.encode() for r in rows]
    data = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    parts = [(passage_features(m, s), o) for m, o, s in all_passages(data, offsets)]
    features, owners = np.concatenate([f for f, _ in parts]), np.concatenate([o for _, o in parts])
    order = np.argsort(owners, kind="stable")
    features, owners = features[order], owners[order]
    share = np.bincount(truth.astype(int), minlength=2)
    even = (len(truth) / 2 / share)[truth.astype(int)]
    corpus = np.array([counts[0] / share[0], counts[1] / share[1]])[truth.astype(int)]
    learn = np.arange(len(rows)) % 4 != 0
    if len(set(truth[learn].tolist())) < 2:
        learn[:] = True
    member = learn[owners]
    network = BagNetwork().fit(features[member], np.searchsorted(np.flatnonzero(learn), owners[member]),
                               truth[learn], even[learn])
    check = ~learn if len(set(truth[~learn].tolist())) == 2 else learn
    odds = network.log_odds(*network.passages(features), owners, len(rows))
    network.scale, network.offset = calibrate(odds[check], truth[check], corpus[check])
    return network


def calibrate(odds, truth, weights) -> tuple[float, float]:
    """Scale and shift of the log odds, by Newton's method with a small ridge."""
    x, w = np.stack([odds, np.ones_like(odds)], 1).astype(float), np.array([1.0, 0.0])
    weights = weights / weights.mean()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weights * (p - truth)) + 0.5 * (w - [1, 0])
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        w = w - np.linalg.solve(curve, slope)
    return float(max(w[0], 0.05)), float(w[1])


def score_documents(docs: DataFrame, model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The id and the score of every row."""
    if isinstance(model, float):
        return docs.select(id_col, F.lit(model).alias("score"))
    schema = with_fields(docs.select(id_col), "score double")

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = cnn.string_buffers(batch.column("_text"))
            found = [(*model.passages(passage_features(m, s)), o) for m, o, s in all_passages(data, offsets)]
            if not found:
                continue
            attention, value, owners = (np.concatenate([f[k] for f in found]) for k in range(3))
            order = np.argsort(owners, kind="stable")
            odds = model.log_odds(attention[order], value[order], owners[order], batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(model.chance(odds.astype(float)))],
                                             [id_col, "score"])

    return docs.select(id_col, whole_text(F.col(text)).alias("_text")).mapInArrow(score, schema)
