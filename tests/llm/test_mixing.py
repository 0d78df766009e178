import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from colloquy.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets_by_steps(sizes, weights=(5, 2, 1), cap=3):
    """Shares by weight, what is over the limit shared out again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not over:
            for s in open_:
                target[s] = left * weight[s] / total
            return target
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def mixed(docs):
    units = mixing.queue_units(docs)
    return mixing.fair_mix(units).collect()


@pytest.mark.parametrize("name", ["odd", "clashing", "documents"])
def test_targets_and_taken_words(request, name):
    docs = request.getfixturevalue(name)
    rows, sizes, largest = mixed(docs), defaultdict(int), defaultdict(int)
    for r in docs.select("source", "text").collect():
        n = len(WORD.findall(r.text or ""))
        sizes[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    assert len(rows) == docs.count()
    want = targets_by_steps(dict(sizes))
    taken = defaultdict(int)
    for r in rows:
        source = r.skey[1:] if r.skey else None
        assert r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source])
        assert 0 <= r.passes <= 3
        taken[source] += r.passes * r.size
    budget = sum(sizes.values())
    assert budget - max(largest.values()) <= sum(taken.values()) <= budget
    for source, words in taken.items():
        assert abs(words - want[source]) <= 2 * max(largest.values())


def test_reruns_agree(odd):
    key = lambda rows: sorted((str(r.doc_id), r.size, r.passes) for r in rows)
    assert key(mixed(odd)) == key(mixed(odd.repartition(5)))


def test_small_documents_come_near_their_targets(spark):
    docs = spark.range(30000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 5 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    for r in (mixing.fair_mix(mixing.queue_units(docs)).groupBy("skey", "target")
              .agg(F.sum(F.col("passes") * F.col("size")).alias("taken")).collect()):
        assert abs(r.taken - r.target) <= 10


def test_no_rows(no_docs):
    assert mixed(no_docs) == []
    assert mixing.mix_documents(no_docs).count() == 0


def test_documents_come_once_per_pass(clashing):
    out = mixing.mix_documents(clashing)
    assert out.columns == clashing.columns
    got, want = defaultdict(int), defaultdict(int)
    for r in out.collect():
        got[r.doc_id, r.text, r.source] += 1
    units = mixing.queue_units(clashing)
    for r in mixing.fair_mix(units).join(units.select("uid", "row_key"), "uid").collect():
        want[r.row_key] += r.passes
    assert sum(got.values()) == sum(want.values())
    assert sorted(got.values()) == sorted(v for v in want.values() if v)
