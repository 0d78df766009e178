import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from colloquy.llm import exact_dedup


def groups_by_hand(docs):
    groups = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        groups[r.text or ""].append(r.doc_id)
    return groups


def agree(docs):
    groups, kept = groups_by_hand(docs), defaultdict(list)
    rows = exact_dedup.duplicate_groups(docs).collect()
    assert len(rows) == docs.count()
    digests = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in rows:
        ids = digests[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.keep_id == (max(known) if known else None)
        assert r.group_size == len(ids)
        if r.kept:
            kept[r.text_sha256].append(r.doc_id)
    assert {d: [max((i for i in ids if i is not None), default=None)] for d, ids in digests.items()} == dict(kept)
    dropped = exact_dedup.drop_duplicates(docs)
    assert dropped.columns == docs.columns
    got = sorted(((r.text or "", r.doc_id) for r in dropped.select("doc_id", "text").collect()), key=str)
    assert got == sorted(((t, max((i for i in ids if i is not None), default=None)) for t, ids in groups.items()), key=str)


@pytest.mark.parametrize("name", ["odd", "clashing", "documents", "no_docs"])
def test_groups(request, name):
    agree(request.getfixturevalue(name))


def test_a_third_of_all_rows_is_split(spark):
    text = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("long beginning shared by all texts "), F.col("id") % 900))
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), text.alias("text"))
    assert exact_dedup.hot_texts(docs, "text").filter("runs > 600").count() == 1
    agree(docs)


def test_all_equal(spark):
    agree(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("same").alias("text")))
    agree(spark.range(50).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text")))
