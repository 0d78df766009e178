from collections import defaultdict

import numpy as np
import pytest

from colloquy.llm import vector_search

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def by_hand(rows, k=5, every=50):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(
        x is not None and np.isfinite(np.float32(x)) for x in v) and any(v)})
    hits = {}
    for i, v in rows:
        if i % every == 0:
            q = np.array(v, np.float32).astype(float)
            found = set()
            for j, w in rows:
                if j != i and len(w) == len(v):
                    x = np.array(w, np.float32).astype(float)
                    found.add((-float(x @ q / (np.sqrt((x ** 2).sum()) * np.sqrt((q ** 2).sum()))), j))
            hits[i, v] = sorted(found)[:k]
    return hits


def test_recall_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect()]
    want, got = by_hand(rows), defaultdict(list)
    for r in vector_search.nearest(table, shard_rows=400).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    assert set(got) == {i for i, _ in want}
    hit = sum(len({j for _, j in got[i]} & {j for _, j in found}) for (i, _), found in want.items())
    assert hit / sum(map(len, want.values())) >= 0.95
    assert all(found == sorted(found) for found in got.values())


@pytest.mark.parametrize("extra", [False, True])
def test_odd_rows(spark, extra):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=4)], 1) for k in range(1, 130)]
    rows += [(k, [1.0, 0.0, 0.0, 0.5], 2) for k in range(200, 320)]  # a vector that very many rows share
    rows += [(400, [1.0, 0.0, 0.0, 0.5], 2)] * 2 + [(450, [2.0, 0.0, 0.0, 1.0], 2), (500, [-0.0, 0.0, 0.0, 0.0], 2)]
    rows += [(550, None, 1), (600, [], 1), (650, [1.0, None, 0.0, 0.0], 1), (700, [float("nan"), 1.0, 0.0, 0.0], 1),
             (750, [float("inf"), 1.0, 0.0, 0.0], 1), (None, [1.0, 1.0, 1.0, 1.0], None), (800, [1.0, 2.0], 1),
             (801, [2.0, 1.0], None), (850, [1.0, 2.0, 3.0], 1)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        table = table.selectExpr("*", "1 AS shard", "2 AS query_id", "array(1L) AS members", "0.5D AS score")
    got = defaultdict(list)
    for r in vector_search.nearest(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    want = {i: [(j, round(-s, 9)) for s, j in found] for (i, _), found in by_hand([r[:2] for r in rows]).items() if found}
    assert dict(got) == want


def test_no_rows(spark):
    assert vector_search.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
