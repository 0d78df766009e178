"""Language identification by a byte convolutional network.

The network (filters of widths 2 to 4 over byte embeddings, max pooling, softmax; ``cnn``) is
trained in numpy on windows of a bounded sample: at most about ``PER_LANGUAGE`` labelled
documents of each language, chosen by a hash of the id, ``PER_TEXT`` windows spread over each. It
is applied to all windows of ``WIDTH`` bytes of every whole text; a text's prediction is the mean of its
windows' probabilities, weighted by their bytes.

Cases: `und` with score 0 for a null text or one without a letter, and for all texts when
there is nothing to learn from; other empty or short texts are one padded window; ties go to
the language first in code point order; a null id counts as the empty text in the hash that
holds rows out; repeated rows are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm import cnn
from colloquy.llm.common import fresh, unsigned_share, whole_text, with_fields

WIDTH = 256
PER_LANGUAGE = 500
PER_TEXT = 6
SAMPLE_BYTES = 1 << 16  # longer texts are not learned from, which bounds the sample
KEEP_SCORE = 0.5  # the pipeline rejects `und` and scores below this


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4 == 2


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(text, lang): labelled rows that are not held out, about ``per_language`` of each language."""
    usable = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES)
        & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # the classes
    chance = unsigned_share(F.xxhash64(F.lit("language"), "doc_id"))
    limits = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, per_language / n)])
    few = usable.filter(chance < F.element_at(limits, F.col("lang"))) if counts else usable.limit(0)
    return few.select("text", "lang", chance.alias("chance"))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE):
    """(network, languages), or None where the sample has no language."""
    rows = training_sample(docs, per_language).orderBy("lang", "chance", "text").collect()
    languages = sorted({r.lang for r in rows}, key=lambda x: x.encode())
    if not languages:
        return None
    windows, labels = [], []
    for row in rows:
        raw = np.frombuffer(row.text.encode(), np.uint8)
        last = max(0, len(raw) - WIDTH)
        for start in sorted({last * k // (PER_TEXT - 1) for k in range(PER_TEXT)}):
            window = np.zeros(WIDTH, np.uint8)
            piece = raw[start:start + WIDTH]
            window[:len(piece)] = piece
            windows.append(window)
            labels.append(languages.index(row.lang))
    labels = np.array(labels)
    share = np.bincount(labels, minlength=len(languages))
    network = cnn.SymbolCnn(256, len(languages))
    network.fit(np.stack(windows), labels, (len(labels) / len(languages) / share)[labels])
    return network, languages


def predict(docs: DataFrame, model, keep: list[str], text: str = "text", lang_col: str = "lang_pred",
            score_col: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs``, the predicted language and its probability."""
    letters = fresh(docs, "_letters")
    marked = docs.select(*dict.fromkeys([*keep, text])).withColumn(
        letters, whole_text(F.col(text)).rlike(r"\p{L}"))
    if model is None:
        return marked.select(*keep, F.lit("und").alias(lang_col), F.lit(0.0).alias(score_col))
    network, languages = model
    schema = with_fields(docs.select(*keep), f"{lang_col} string, {score_col} double")

    def score(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        network.folded()
        for batch in batches:
            known = batch.column(letters)
            data, offsets = cnn.string_buffers(pc.fill_null(batch.column(text), ""))
            total = np.zeros((batch.num_rows, len(languages)))
            for matrix, owners, sizes in cnn.text_windows(data, offsets, WIDTH):
                np.add.at(total, owners, network.probabilities(matrix) * sizes[:, None])
            total /= np.maximum(np.diff(offsets), 1)[:, None]
            best = total.argmax(axis=1)
            names = pc.if_else(known, pa.array(languages, pa.string()).take(pa.array(best)), "und")
            scores = pc.if_else(known, pa.array(np.clip(total[np.arange(len(best)), best], 0, 1)), 0.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], names, scores],
                                             [*keep, lang_col, score_col])

    network.tables = None  # they are made again in each task, from far fewer bytes
    return marked.mapInArrow(score, schema)


def identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language the network (trained on ``docs``) is sure enough of."""
    lang, score = fresh(docs, "_lang_pred"), fresh(docs, "_lang_score")
    scored = predict(docs, train(docs), docs.columns, lang_col=lang, score_col=score)
    return scored.filter((F.col(lang) != "und") & (F.col(score) >= KEEP_SCORE)).select(*docs.columns)
