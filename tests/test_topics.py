"""Non-negative factors against plain numpy on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import models


def table(rng, documents=120, terms=40, topics=4):
    """A sparse table of few themes with noise, some documents several times."""
    themes = rng.random((topics, terms)) * (rng.random((topics, terms)) < 0.3)
    x = rng.random((documents, topics)) ** 3 @ themes * (rng.random((documents, terms)) < 0.7)
    x[rng.integers(0, documents, 30)] = x[0]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def as_rows(spark, x):
    rows = [([int(i) for i in np.flatnonzero(d)], [float(v) for v in d[d > 0]]) for d in x if d.any()]
    return (spark.createDataFrame(rows, "idx array<int>, val array<double>").repartition(3)
            .groupBy("idx", "val").agg(F.count(F.lit(1)).alias("times")))


def plain_factors(x, topics, rounds=3000):
    """Multiplicative updates of both factors, to convergence, from the best of some random starts."""
    best = np.inf
    for seed in range(4):
        rng = np.random.default_rng(seed)
        w, h = rng.random((len(x), topics)) + 0.1, rng.random((topics, x.shape[1])) + 0.1
        for _ in range(rounds):
            h *= (w.T @ x) / (w.T @ w @ h + 1e-12)
            w *= (x @ h.T) / (w @ h @ h.T + 1e-12)
        best = min(best, np.linalg.norm(x - w @ h))
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_error_is_that_of_a_plain_factorisation(spark, seed):
    x = table(np.random.default_rng(seed))
    found = models.factorise(as_rows(spark, x), len(x), x.shape[1], 4, tolerance=1e-5)
    assert (found.terms >= 0).all()
    w = models.non_negative(x @ found.terms.T, found.terms @ found.terms.T, 5000)
    assert abs(np.linalg.norm(x - w @ found.terms) - found.error) < 1e-6
    assert np.allclose(w.mean(axis=0), found.shares, atol=1e-6)
    assert found.error <= 1.01 * plain_factors(x, 4)


def test_start_is_that_of_singular_vectors(spark):
    x = table(np.random.default_rng(3))
    u, s, v = np.linalg.svd(x)
    got = models.svd_start(as_rows(spark, x), len(x), x.shape[1], 3, rounds=40)
    first = np.sqrt(s[0]) * np.abs(v[0])
    assert np.allclose(got[0], np.where(first < 1e-6, x.mean(), first), atol=1e-6)
    for t in (1, 2):
        halves = [(np.maximum(g * u[:, t], 0), np.maximum(g * v[t], 0)) for g in (1, -1)]
        left, right = max(halves, key=lambda h: np.linalg.norm(h[0]) * np.linalg.norm(h[1]))
        want = np.sqrt(s[t] * np.linalg.norm(left) * np.linalg.norm(right)) * right / np.linalg.norm(right)
        want[want < 1e-6] = x.mean()
        assert np.allclose(got[t], want, atol=1e-6)


def test_rows_of_non_negative_least_squares():
    """No step along any coordinate is better."""
    rng = np.random.default_rng(4)
    h, x = rng.random((5, 30)), rng.random((20, 30)) - 0.3
    w, gram = models.non_negative(x @ h.T, h @ h.T, 5000), h @ h.T
    slope = w @ gram - x @ h.T
    assert (w >= 0).all() and (np.abs(slope[w > 0]) < 1e-5).all() and (slope[w == 0] > -1e-5).all()


def test_topics_of_sentences(spark):
    themes = ["budget invoice payment", "docker kubernetes release", "harbour lantern mills"]
    rows = [(k, themes[k % 3] + (" budget" if k % 3 == 0 and k % 2 else "")) for k in range(90)] + [(90, ""), (91, "12 34")]
    got = models.nmf_topics(spark.createDataFrame(rows, "doc bigint, sentence string"), 3).collect()
    assert {frozenset(r["terms"].split(", ")[:3]) for r in got} == {frozenset(t.split()) for t in themes}
    assert [r["weight"] for r in got] == sorted((r["weight"] for r in got), reverse=True)
    assert models.nmf_topics(spark.createDataFrame([], "doc bigint, sentence string"), 3).count() == 0
