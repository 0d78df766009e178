"""Nearest vectors by cosine, over robust-pruned directed graphs.

Vectors are dealt by a hash into shards of about ``SHARD_ROWS``. In each shard a directed graph
grows batch by batch: a greedy (beam) search over the graph so far proposes neighbours of the new
vectors, and relaxed distance pruning keeps a proposal only if no kept neighbour is ``ALPHA``
times nearer to it than the vector itself, which leaves diverse edges, back edges alike. A second
round over all vectors refines the first. Every query walks the graph of every shard with a beam; scores of what it
finds are computed in double precision from the original vectors, and the best of all shards remain.

A shard and a block of queries are all that a task holds: rows of a shard come first, queries stream after
them. Equal vectors are one point with its smallest ids, so a vector that a third of all rows
share costs one point, and ties go to the smaller id. The queries are a stated share of the rows
and meet each shard in blocks; ``SHARD_ROWS`` sets how much work that is beside building (N / 50
queries times N / SHARD_ROWS shards), and is to be raised with the memory of a task.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows
without id, take no part; vectors meet only vectors of their own length; equal rows count once;
rows with one id and different vectors are separate, but never neighbours; with fewer candidates all are
returned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.plans.runtime import materialize

SHARD_ROWS = 8192
DEGREE, BUILD_BEAM, QUERY_BEAM, EXPAND, ALPHA = 32, 72, 192, 4, 1.2
BATCH = 512


def beam_search(x, graph, entry, queries, width: int, total: int):
    """For each query the ``width`` nearest points found among the first ``total``, nearest first.

    Returns (ids, dot products); missing ones have id -1. In each step every query opens its EXPAND
    nearest unopened points, until the whole beam is open.
    """
    rows = len(queries)
    lines = np.arange(rows)[:, None]
    ids = np.full((rows, width), -1, np.int64)
    dots = np.full((rows, width), -np.inf, np.float32)
    ids[:, 0], dots[:, 0] = entry, queries @ x[entry]
    opened = np.zeros((rows, width), bool)
    seen = np.zeros((rows, total + 1), bool)
    seen[:, entry] = seen[:, total] = True  # the last column stands for "no neighbour"
    while True:
        rank = np.where((ids >= 0) & ~opened, np.arange(width), width)
        picks = np.sort(rank, axis=1)[:, :EXPAND]
        if (picks[:, 0] == width).all():
            return ids, dots
        safe = np.minimum(picks, width - 1)
        found = graph[ids[lines, safe]]
        found[picks == width] = -1
        opened |= (rank < width) & (rank <= picks[:, -1:])
        found = np.sort(found.reshape(rows, -1), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found[seen[lines, found]] = -1  # index -1 is the last column
        seen[lines, found] = True
        found = -np.sort(-found, axis=1)
        found = found[:, :max(1, int((found >= 0).sum(axis=1).max()))]
        near = np.einsum("qnd,qd->qn", x[found], queries)
        near[found < 0] = -np.inf
        ids, dots = np.concatenate([ids, found], axis=1), np.concatenate([dots, near], axis=1)
        opened = np.concatenate([opened, np.zeros(found.shape, bool)], axis=1)
        order = np.argsort(-dots, axis=1, kind="stable")[:, :width]
        ids, dots, opened = ids[lines, order], dots[lines, order], opened[lines, order]


def robust_prune(x, points, candidates, alpha: float):
    """Up to DEGREE diverse neighbours of each point out of its candidates (-1: none)."""
    rows, lines = len(points), np.arange(len(points))
    candidates = np.sort(candidates, axis=1)
    bad = (candidates < 0) | (candidates == points[:, None])
    bad[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
    vectors = x[candidates]
    own = np.where(bad, np.inf, 2 - 2 * np.einsum("qnd,qd->qn", vectors, x[points]))
    order = np.argsort(own, axis=1, kind="stable")
    candidates, own = np.take_along_axis(candidates, order, 1), np.take_along_axis(own, order, 1)
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    between = 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    alive, kept = np.isfinite(own), np.full((rows, DEGREE), -1, np.int64)
    for k in range(DEGREE):
        first = alive.argmax(axis=1)
        some = alive[lines, first]
        if not some.any():
            break
        kept[some, k] = candidates[some, first[some]]
        alive &= ~((alpha * between[lines, first] <= own) & some[:, None])
        alive[lines, first] = False
    return kept


def add_back_edges(x, graph, points, kept, alpha: float):
    """Points become neighbours of what they chose; lists that run over are pruned."""
    sources, targets = np.repeat(points, DEGREE)[kept.ravel() >= 0], kept.ravel()[kept.ravel() >= 0]
    order = np.argsort(targets, kind="stable")
    sources, targets = sources[order], targets[order]
    own, first, count = np.unique(targets, return_index=True, return_counts=True)
    column = np.arange(len(targets)) - np.repeat(first, count)
    for low in range(0, int(count.max(initial=0)), 2 * DEGREE):  # many newcomers are taken in turns
        part = (column >= low) & (column < low + 2 * DEGREE)
        line = np.searchsorted(own, targets[part])
        extra = np.full((len(own), 2 * DEGREE), -1, np.int64)
        extra[line, column[part] - low] = sources[part]
        touched = (extra >= 0).any(axis=1)
        for at in range(0, len(own), BATCH):
            some = np.flatnonzero(touched[at:at + BATCH]) + at
            if len(some):
                both = np.concatenate([graph[own[some]], extra[some]], axis=1)
                graph[own[some]] = robust_prune(x, own[some], both, alpha)


def build_graph(x: np.ndarray):
    """(entry point, neighbours (n, DEGREE), -1 for none) over unit vectors."""
    n = len(x)
    graph = np.full((n, DEGREE), -1, np.int64)
    entry = int((x @ x.mean(axis=0)).argmax())
    order = np.random.default_rng(3).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    for alpha, done in ((1.0, 1), (ALPHA, 0)):
        while done < n:
            size = BATCH if alpha > 1 else min(BATCH, done)
            points = order[done:done + size]
            found, _ = beam_search(x, graph, entry, x[points], BUILD_BEAM, n)
            kept = robust_prune(x, points, np.concatenate([found, graph[points]], axis=1), alpha)
            graph[points] = kept
            add_back_edges(x, graph, points, kept, alpha)
            done += len(points)
    return entry, graph


class Shard:
    """The vectors of a shard with their ids, and the graph once the first query comes."""

    def __init__(self, vectors: np.ndarray, members: list):
        self.raw, self.members = vectors.astype(np.float64), members
        self.norms = np.sqrt((self.raw ** 2).sum(axis=1))
        self.unit = (self.raw / self.norms[:, None]).astype(np.float32)
        self.entry, self.graph = build_graph(self.unit)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """(position of the query, id, score) of the nearest k ids found for each query."""
        exact = queries.astype(np.float64)
        norms = np.sqrt((exact ** 2).sum(axis=1))
        found, _ = beam_search(self.unit, self.graph, self.entry, (exact / norms[:, None]).astype(np.float32),
                               max(QUERY_BEAM, 2 * (k + 1)), len(self.unit))
        out = []
        for q, ids in enumerate(found[:, :4 * (k + 1)]):
            ids = ids[ids >= 0]
            scores = self.raw[ids] @ exact[q] / (self.norms[ids] * norms[q])
            pairs = [(-s, m) for i, s in zip(ids, scores, strict=True) for m in self.members[i] if m != query_ids[q]]
            out.extend((q, m, -s) for s, m in sorted(pairs)[:k])
        return out


def search_shards(k: int):
    """Rows of a shard, then the queries to it, both sorted by shard; yields hits."""
    def run(batches):
        import pyarrow as pa

        at, shard, vectors, members = None, None, [], []
        for batch in batches:
            shards, query = batch.column("shard").to_numpy(), batch.column("query_id")
            cuts = np.flatnonzero(np.diff(shards)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(shards)], strict=True):
                if shards[lo] != at:
                    at, shard, vectors, members = shards[lo], None, [], []
                part = batch.slice(lo, hi - lo)
                is_query = np.array(part.column("query_id").is_valid())
                data = np.stack(part.column("embedding").to_numpy(zero_copy_only=False))
                if (~is_query).any():
                    vectors.append(data[~is_query])
                    members += [m for m, q in zip(part.column("members").to_pylist(), is_query, strict=True) if not q]
                for start in range(0, int(is_query.sum()), BATCH):
                    if not vectors:
                        break  # a shard without vectors
                    if shard is None:
                        shard = Shard(np.concatenate(vectors), members)
                    rows = np.flatnonzero(is_query)[start:start + BATCH]
                    ids = part.column("query_id").take(pa.array(rows)).to_numpy()
                    hits = shard.search(ids, data[rows], k)
                    keys = part.column("query_key").take(pa.array(rows)).to_numpy()
                    where = np.array([h[0] for h in hits], int)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[where], pa.int64()), pa.array(keys[where], pa.int64()),
                         pa.array([h[1] for h in hits], pa.int64()),
                         pa.array([float(h[2]) for h in hits], pa.float64())],
                        ["query_id", "query_key", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<float>")
    # The largest float; infinities are beyond it, and a comparison with NaN is settled before.
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= F.lit(3.4028235e38))
    return vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("embedding")).filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", finite) & F.exists("embedding", lambda c: c != 0))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector: str = "embedding",
            shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``."""
    rows = usable(vectors, id_col, vector)
    lowest = Window.partitionBy("embedding").orderBy("vec_id")
    # k + 1 ids of each vector are enough; ranks are cut before the shuffle as well
    few = rows.distinct().withColumn("r", F.row_number().over(lowest)).filter(F.col("r") <= k + 1)
    points = materialize(few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("members")))
    per_length = points.groupBy(F.size("embedding").alias("length")).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).cast("int").alias("shards"))
    first = F.sum("shards").over(Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1))
    plan = materialize(per_length.select("length", "shards", F.coalesce(first, F.lit(0)).cast("int").alias("first")))
    total = plan.agg(F.sum("shards").alias("n")).first().n or 1
    null = F.lit(None).cast("bigint")
    dealt = points.withColumn("length", F.size("embedding")).join(plan, "length").select(
        (F.col("first") + F.pmod(F.xxhash64("embedding"), F.col("shards"))).cast("int").alias("shard"),
        null.alias("query_id"), null.alias("query_key"), "embedding", "members")
    asked = rows.filter(F.col("vec_id") % every == 0).distinct()
    queries = asked.withColumn("length", F.size("embedding")).join(plan, "length").select(
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("shards") - 1)).alias("shard"),
        F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("query_key"), "embedding",
        F.lit(None).cast("array<bigint>").alias("members"))
    streams = (dealt.unionByName(queries).repartitionByRange(int(total), "shard")
               .sortWithinPartitions("shard", F.col("query_id").asc_nulls_first()))
    hits = streams.mapInArrow(search_shards(k), "query_id bigint, query_key bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return (hits.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
