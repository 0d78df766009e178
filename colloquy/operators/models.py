"""Model-backed operators on Spark ML."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import (CountVectorizer, ElementwiseProduct, IDF, IndexToString, Normalizer,
                                StringIndexer)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.functions import vocab as V
from colloquy.operators.vectors import plus_one
from colloquy.operators.weights import ngrams, tfidf
from colloquy.plans.runtime import fresh_path, materialize

TERMS = 3000  # default sizes of vocabularies: topics, and the classifier's sequences
GRAMS = 20000


def _grams(rows: DataFrame) -> DataFrame:
    tokens = F.regexp_extract_all(F.lower("sentence"), F.lit(r"\b[a-z][a-z0-9]*\b"), 0)
    return rows.withColumn("_tokens", tokens).withColumn("_grams", ngrams(F.col("_tokens"),
                                                                         (1, 2, 3)))


def train_classifier(labelled: DataFrame, iterations: int = 1000, terms: int = GRAMS) -> PipelineModel:
    """M1. Sentence classifier: tf-idf of one- to three-word sequences, balanced classes.

    ``labelled``: sentence, label. C = 1 on summed loss is regParam = 1/n on the mean loss.
    """
    # Written once, as every step of the training reads them again.
    rows = materialize(labelled.filter(F.col("label").isin(V.CLASS_LABELS)).dropna(subset=["sentence", "label"]))
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_k"))
    totals = sizes.agg(F.sum("_k").alias("n"), F.count(F.lit(1)).alias("classes")).first()
    weighted = _grams(rows.join(F.broadcast(sizes), "label").withColumn(  # a row for each of a fixed list of classes
        "_weight", F.lit(float(totals["n"])) / (F.lit(totals["classes"]) * F.col("_k"))))
    counter = CountVectorizer(inputCol="_grams", outputCol="_tf", vocabSize=terms).fit(weighted)
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(counter.transform(weighted)).idf
    stages = [StringIndexer(inputCol="label", outputCol="_label", handleInvalid="keep",
                            stringOrderType="alphabetAsc"),
              counter, ElementwiseProduct(inputCol="_tf", outputCol="_idf", scalingVec=plus_one(idf)),
              Normalizer(inputCol="_idf", outputCol="_features", p=2.0),
              LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_weight",
                                 maxIter=iterations, regParam=1.0 / max(1, totals["n"]),
                                 elasticNetParam=0.0, standardization=False,
                                 family="multinomial", probabilityCol="_probability",
                                 rawPredictionCol="_raw", predictionCol="_prediction")]
    model = Pipeline(stages=stages).fit(weighted)
    back = IndexToString(inputCol="_prediction", outputCol="model_label",
                         labels=model.stages[0].labels)
    return PipelineModel([*model.stages[1:], back])


def classify(model: PipelineModel, sentences: DataFrame) -> DataFrame:
    """M2. Model label and confidence, then the rule cascade decides the shown label."""
    scored = model.transform(_grams(sentences))
    confidence = F.round(F.array_max(vector_to_array("_probability")), 4)
    return scored.withColumn("confidence", confidence).select(
        *sentences.columns, "model_label", "confidence",
        X.rule_label("sentence", F.col("model_label"), F.col("confidence")).alias("label"))


def save_model(model: PipelineModel, path: str) -> str:
    """S13."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def lda_topics(sentences: DataFrame, topics: int = 5, iterations: int = 20, terms: int = TERMS) -> DataFrame:
    """M3. Topics with their eight strongest terms and mean share, strongest first."""
    rows = sentences.withColumn("_tokens", X.content_words("sentence"))
    counter = CountVectorizer(inputCol="_tokens", outputCol="_tf", vocabSize=terms).fit(rows)
    counted = materialize(counter.transform(rows).select("_tf"))
    model = LDA(k=topics, maxIter=iterations, optimizer="online", seed=42, featuresCol="_tf",
                topicDistributionCol="_share").fit(counted)
    shares = model.transform(counted).select(F.posexplode(vector_to_array("_share"))
                                             .alias("topic", "_s"))
    weights = shares.groupBy("topic").agg(F.round(F.avg("_s"), 4).alias("weight"))
    vocabulary = X.words_array(counter.vocabulary)
    strongest = model.describeTopics(8).select("topic", F.transform(
        "termIndices", lambda i: F.element_at(vocabulary, i + 1)).alias("terms"))
    return (strongest.join(weights, "topic").select("topic", F.array_join("terms", ", ").alias("terms"),
                                                "weight").orderBy(F.desc("weight"), "topic"))


class Factors(NamedTuple):
    """Non-negative ``terms`` (topics x terms), the mean share of each topic and the length of what is left over."""

    terms: np.ndarray
    shares: np.ndarray
    error: float


def _flat(batch: pd.DataFrame):
    """(row of each entry, term of each entry, value, times of each row) of a batch of sparse rows."""
    sizes = np.array([len(x) for x in batch["idx"]])
    return (np.repeat(np.arange(len(sizes)), sizes), np.concatenate(batch["idx"].to_list()),
            np.concatenate(batch["val"].to_list()), batch["times"].to_numpy(np.float64))


def non_negative(target: np.ndarray, gram: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """Rows w >= 0 of least w gram w / 2 - w target, one coordinate after the other until they rest."""
    w = np.zeros_like(target)
    for _ in range(sweeps):
        before = w.copy()
        for t in range(target.shape[1]):
            if gram[t, t] > 0:
                w[:, t] = np.maximum(0, w[:, t] + (target[:, t] - w @ gram[:, t]) / gram[t, t])
        if np.abs(w - before).max(initial=0) <= 1e-9 * np.abs(w).max(initial=1e-300):
            break
    return w


def _summed(rows: DataFrame, shape: tuple[int, int], of_batch) -> np.ndarray:
    """The sum of ``of_batch`` (a table of ``shape``) over all batches: cells are summed where they are, then by cell."""
    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            if len(batch):
                total += of_batch(*_flat(batch))
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "x": total[i, j]})

    out = np.zeros(shape)
    cells = rows.select("idx", "val", "times").mapInPandas(run, "i int, j int, x double")
    for r in cells.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():  # at most as many as the table has cells
        out[r["i"], r["j"]] = r["x"]
    return out


def svd_start(rows: DataFrame, documents: int, terms: int, topics: int, rounds: int = 6) -> np.ndarray:
    """Term factors to begin with: the positive or negative halves of singular vectors, whichever weigh more.

    Subspace iteration on the terms' side; gaps are filled with the mean of the table.
    """
    width = min(terms, topics + 8)
    basis = np.linalg.qr(np.random.default_rng(42).normal(size=(terms, width)))[0]

    def through(row, term, value, times, basis=None):
        seen = np.zeros((len(times), basis.shape[1]))
        np.add.at(seen, row, value[:, None] * basis[term])
        return seen

    for _ in range(rounds):
        def gram(row, term, value, times, basis=basis):
            out = np.zeros((basis.shape[1], terms))
            seen = through(row, term, value, times, basis) * times[:, None]
            np.add.at(out.T, term, value[:, None] * seen[row])
            return out

        image = _summed(rows, (width, terms), gram).T
        basis = np.linalg.qr(image)[0]

    def inner(row, term, value, times, basis=basis):
        seen = through(row, term, value, times, basis)
        return seen.T @ (seen * times[:, None])

    values, turn = np.linalg.eigh(_summed(rows, (width, width), inner))
    order = np.argsort(-values)[:topics]
    strength, vectors = np.sqrt(np.maximum(values[order], 1e-24)), basis @ turn[:, order]

    def halves(row, term, value, times):
        seen = through(row, term, value, times, vectors) / strength
        return np.stack([(times[:, None] * np.maximum(side, 0) ** 2).sum(axis=0) for side in (seen, -seen)])

    above, below = np.sqrt(_summed(rows, (2, topics), halves))
    mean = _summed(rows, (1, 1), lambda row, term, value, times: (value * times[row]).sum().reshape(1, 1))[0, 0]
    factors = np.full((topics, terms), 0.0)
    for t in range(topics):
        v = vectors[:, t]
        if t == 0:
            factors[t] = np.sqrt(strength[t]) * np.abs(v)
            continue
        plus, minus = np.maximum(v, 0), np.maximum(-v, 0)
        side, other = (plus, above[t]) if np.linalg.norm(plus) * above[t] > np.linalg.norm(minus) * below[t] else (minus, below[t])
        length = np.linalg.norm(side)
        factors[t] = np.sqrt(strength[t] * length * other) * side / max(length, 1e-300)
    factors[factors < 1e-6] = mean / (documents * terms)
    return factors


def factorise(rows: DataFrame, documents: int, terms: int, topics: int, iterations: int = 300,
              tolerance: float = 1e-4) -> Factors:
    """Non-negative factors of a sparse table (idx, val, times: equal documents are one row).

    Rounds of alternating least squares: given the term factors (the model, topics x terms numbers), every document's
    own factors are solved for where it lies, and what the term factors need is summed in one aggregation;
    then these are solved for. The error falls in every round; rounds end when it falls by less than
    ``tolerance`` of the first error, or after ``iterations``.
    """
    factors, first, last = svd_start(rows, documents, terms, topics), None, None
    while True:
        gram = factors @ factors.T

        def one_round(row, term, value, times, factors=factors, gram=gram):
            target = np.zeros((len(times), topics))
            np.add.at(target, row, value[:, None] * factors.T[term])
            w = non_negative(target, gram)
            weighed = w * times[:, None]
            out = np.zeros((topics + 1, terms + topics + 1))
            for t in range(topics):
                out[t, :terms] = np.bincount(term, weights=value * weighed[row, t], minlength=terms)
            out[:topics, terms:-1] = w.T @ weighed
            out[:topics, -1] = weighed.sum(axis=0)
            left = np.bincount(row, weights=value ** 2, minlength=len(times)) - 2 * (w * target).sum(axis=1) + ((w @ gram) * w).sum(axis=1)
            out[topics, -1] = (left * times).sum()
            return out

        found = _summed(rows, (topics + 1, terms + topics + 1), one_round)
        error = float(np.sqrt(max(found[topics, -1], 0.0)))
        first, fell, last = first or error, None if last is None else last - error, error
        iterations -= 1
        if iterations <= 0 or fell is not None and fell <= tolerance * first or error == 0:
            return Factors(factors, found[:topics, -1] / documents, error)
        factors = non_negative(found[:topics, :terms].T, found[:topics, terms:-1]).T


def sparse_rows(weights: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(idx, val, times) from (doc, term, w): documents of equal weights are one row."""
    places = weights.sparkSession.createDataFrame(list(enumerate(vocabulary)), "i int, term string")  # a model's vocabulary
    entries = F.array_sort(F.collect_list(F.struct("i", F.round("w", 12).alias("w"))))
    return materialize(weights.join(F.broadcast(places), "term").groupBy("doc").agg(entries.alias("e"))
                       .groupBy("e").agg(F.count(F.lit(1)).alias("times"))
                       .select(F.col("e.i").alias("idx"), F.col("e.w").alias("val"), "times"))


def nmf_topics(sentences: DataFrame, topics: int = 5, iterations: int = 300, terms: int = TERMS,
               tolerance: float = 1e-4) -> DataFrame:
    """M4. Topics as non-negative factors of the tf-idf table of ``sentences`` (doc, sentence), see ``factorise``."""
    docs = sentences.select(F.lit(0).alias("g"), "doc", X.content_words("sentence")
                            .alias("tokens"))
    weights = materialize(tfidf(docs, ["g"], "doc", (1,), terms))
    vocabulary = [r["term"] for r in weights.select("term").distinct().orderBy("term").collect()]
    count = sentences.count()
    schema = "topic int, terms string, weight double"
    topics = min(topics, count, len(vocabulary))
    if topics < 1:
        return sentences.sparkSession.createDataFrame([], schema)
    found = factorise(sparse_rows(weights, vocabulary), count, len(vocabulary), topics, iterations, tolerance)
    result = [(int(k), ", ".join(vocabulary[i] for i in np.argsort(-found.terms[k], kind="stable")[:8]),
               round(float(found.shares[k]), 4)) for k in np.argsort(-found.shares, kind="stable")]
    return sentences.sparkSession.createDataFrame(result, schema)
