"""Quality and language: held-out accuracy, cases, and that inputs are the text alone."""

import pytest
from pyspark.sql import functions as F

from colloquy.llm import language_id, quality


@pytest.fixture(scope="module")
def large(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def test_language_on_held_out_rows(large):
    docs, _ = large
    model = language_id.train(docs)
    out = language_id.predict(docs, model, ["doc_id", "lang"]).filter(language_id.held_out(F.col("doc_id")))
    assert out.count() > 150
    assert out.filter("lang_pred = lang").count() / out.count() > 0.97
    assert out.filter("score < 0 or score > 1").count() == 0


@pytest.mark.parametrize("name", ["odd", "clashing"])
def test_language_cases(request, name):
    docs = request.getfixturevalue(name)
    model = language_id.train(docs)
    rows = language_id.predict(docs, model, ["doc_id", "text"], lang_col="guess", score_col="sure").collect()
    assert len(rows) == docs.count()
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.guess, r.sure) == ("und", 0.0)
        else:
            assert r.guess in ("en", "fr") and 0 < r.sure <= 1
    assert len({(r.guess, r.sure) for r in rows if r.doc_id == 110}) == 1
    kept = language_id.identified(docs)
    assert kept.columns == docs.columns
    assert kept.filter("doc_id in (100, 101, 102, 106)").count() == 0
    assert kept.filter("doc_id < 40").count() >= 38


def test_language_without_rows_or_labels(spark, odd, no_docs):
    assert language_id.train(no_docs) is None
    assert language_id.predict(no_docs, None, ["doc_id"]).count() == 0
    assert language_id.identified(no_docs).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    rows = language_id.predict(unlabelled, language_id.train(unlabelled), ["doc_id"]).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.train(docs, labels, per_class=600)
    held = docs.filter(quality.held_out(F.col("doc_id"))).join(labels, "doc_id")
    rows = quality.score_documents(held, model).join(labels, "doc_id").collect()
    assert len(rows) > 500
    good = [r.score for r in rows if r.quality == 1]
    poor = [r.score for r in rows if r.quality == 0]
    assert sum(s >= quality.CUT for s in good) / len(good) > 0.97
    assert sum(s < quality.CUT for s in poor) / len(poor) > 0.8


@pytest.mark.parametrize("name", ["odd", "clashing", "no_docs"])
def test_quality_cases(spark, request, name):
    docs = request.getfixturevalue(name)
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(40)] + [(3, 0, 1), (None, 1, 0), (5, None, 0), (6, 7, 0)],
                                   "doc_id bigint, quality int, toxic int")
    rows = quality.score_documents(docs, quality.train(docs, labels)).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 110}) <= 1
    one_class = labels.filter("quality = 1 and doc_id is not null")
    assert {r.score for r in quality.score_documents(docs, quality.train(docs, one_class)).collect()} <= {1.0}
    none = labels.limit(0)
    assert {r.score for r in quality.score_documents(docs, quality.train(docs, none)).collect()} <= {0.5}
