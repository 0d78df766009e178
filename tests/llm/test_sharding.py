import math
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from colloquy.llm import sharding


def spark_hash(*words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed


def descend(key, tree):
    node = {"children": tree}
    while "children" in node:
        node = min(node["children"], key=lambda c: -math.log(
            ((spark_hash(key, c["name"]) >> 11) + 0.5) / 2 ** 53) / c["weight"])
    return node["shard"]


@pytest.mark.parametrize("name", ["odd", "clashing", "documents", "no_docs"])
def test_rows(request, name):
    docs = request.getfixturevalue(name)
    rows = sharding.shard_rows(docs).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()))
                   for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    now, later = sharding.shard_tree(40), sharding.shard_tree(41, base=40)
    for r in rows:
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert (r.law, r.shard, r.grown_shard) == ("key", descend(key, now), descend(key, later))
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_spread_and_growth(spark):
    key = F.col("id").cast("string")
    for n in (40, 43):
        out = spark.range(40000).select(
            sharding.shard_of(key, sharding.shard_tree(n, base=40)).alias("a"),
            sharding.shard_of(key, sharding.shard_tree(n + 1, base=40)).alias("b"))
        assert out.filter(f"a <> b and b <> {n}").count() == 0
        counts = [r["count"] for r in out.groupBy("b").count().collect()]
        assert len(counts) == n + 1
        assert max(abs(c - 40000 / (n + 1)) for c in counts) < 200


def test_a_changed_weight_moves_rows_only_over_its_path(spark):
    key = F.col("id").cast("string")
    heavier = sharding.shard_tree(40, weights={5: 3.0})
    out = spark.range(20000).select(sharding.shard_of(key, sharding.shard_tree(40)).alias("a"),
                                    sharding.shard_of(key, heavier).alias("b"))
    region = range(0, 8)  # shard 5 is in the first region; shards of other regions only lose rows to it
    assert out.filter("a <> b").filter(~F.col("b").isin(*region)).count() == 0
    share = out.filter("b = 5").count() / 20000
    assert share == pytest.approx(3 / 42, rel=0.1)
