"""Vectors: pooling, similarity joins, topics across meetings."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.plans.graph import connected_components
from colloquy.plans.runtime import materialize

CELL = 1024


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def mean_vectors(units: DataFrame, keys: list[str]) -> DataFrame:
    """A13. Mean of the unit vectors per key, scaled to length one (with 1e-9 in the divisor)."""
    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    means = units.groupBy(*keys).agg(Summarizer.mean(vector).alias("_v"),
                                     F.count(F.lit(1)).alias("units"))
    arrays = means.withColumn("_a", vector_to_array("_v"))
    length = F.sqrt(dot(F.col("_a"), F.col("_a"))) + 1e-9
    return arrays.withColumn("_l", length).select(
        *keys, "units", F.transform("_a", lambda x: x / F.col("_l")).alias("embedding"))


def _cell_pairs(threshold: float, types: dict[str, str], keys: list[str]):
    columns = [*keys, "id_a", "id_b", "cosine"]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        left = pdf[pdf["_blk"] == pdf["_i"]].reset_index(drop=True)
        right = pdf[pdf["_blk"] == pdf["_j"]].reset_index(drop=True)
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        a, b = (np.stack(side["embedding"].to_numpy()).astype("float64") for side in (left, right))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        sims = a @ b.T
        x, y = np.nonzero(sims >= threshold - 1e-9)
        ids_a, ids_b = left["id"].to_numpy()[x], right["id"].to_numpy()[y]
        same_block = bool(pdf["_i"].iloc[0] == pdf["_j"].iloc[0])
        keep = ids_a < ids_b if same_block else ids_a != ids_b
        first, second = ids_a[keep], ids_b[keep]
        swap = first > second
        out = pd.DataFrame({"id_a": np.where(swap, second, first),
                            "id_b": np.where(swap, first, second), "cosine": sims[x, y][keep]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[columns]

    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], f"id_a {types['id']}",
                        f"id_b {types['id']}", "cosine double"])
    return compare, schema


def similar_vectors(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """J13. Pairs of distinct vectors (id_a < id_b) of a group with cosine of at least theta.

    ``rows``: keys, id, embedding. Copies of a vector count once, under their smallest id.
    Groups are cut into blocks of about a thousand vectors and each pair of blocks is one small
    task, so a large group spreads over many tasks and only matching pairs leave a task.
    """
    distinct = rows.groupBy(*keys, "embedding").agg(F.min("id").alias("id"))
    sizes = distinct.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("_nb"))
    placed = distinct.join(sizes, keys).withColumn("_blk", F.pmod(F.xxhash64("id"), F.col("_nb")))
    cells = placed.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                             F.col("_nb").cast("bigint") - 1)))
    cells = (cells.withColumn("_i", F.least("_blk", "_other"))
             .withColumn("_j", F.greatest("_blk", "_other"))
             .select(*keys, "id", "embedding", "_blk", "_i", "_j"))
    compare, schema = _cell_pairs(threshold, dict(rows.dtypes), keys)
    return cells.groupBy(*keys, "_i", "_j").applyInPandas(compare, schema)


def plus_one(vector):
    from pyspark.ml.linalg import Vectors

    return Vectors.dense([x + 1 for x in vector])


def hashed_vectors(texts: DataFrame, size: int = 256) -> DataFrame:
    """M5. A vector per text: hashed term counts weighted by idf, length one."""
    from pyspark.ml.feature import IDF, ElementwiseProduct, HashingTF, Normalizer

    counter = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=size)
    rows = counter.transform(texts.withColumn("_tokens", X.content_words("text")))
    weights = IDF(inputCol="_tf", outputCol="_idf").fit(rows).idf
    # The weight of a term is its idf plus one, so that a term in every text still counts.
    weighted = ElementwiseProduct(inputCol="_tf", outputCol="_idf", scalingVec=plus_one(weights)).transform(rows)
    return (Normalizer(inputCol="_idf", outputCol="_unit", p=2.0).transform(weighted)
            .withColumn("embedding", vector_to_array("_unit", "float32"))
            .drop("_tokens", "_tf", "_idf", "_unit"))


def _rarest_first(sets: DataFrame) -> DataFrame:
    """(id, terms) of sets that have terms, by how many sets hold each term, the rarest first."""
    words = sets.select("id", F.explode("terms").alias("_t"))
    counts = words.groupBy("_t").agg(F.count(F.lit(1)).alias("_c"))
    ordered = F.array_sort(F.collect_list(F.struct("_c", "_t")))
    return words.join(counts, "_t").groupBy("id").agg(F.transform(ordered, lambda x: x["_t"]).alias("terms"))


def term_set_candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of sets (id, terms: rarest first) that may be similar, the smaller set first; a pair may come twice.

    Sets of m and n terms, m <= n, need o = ceil(theta * sqrt(m n)) terms in common, and so share one of the first
    m - o + 1 and n - o + 1 terms in any common order. Keys are (term, m, n): a frequent term brings together only sets
    that have no rarer ones to be found by, of sizes that fit, and is dealt out by the sizes.
    """
    n = F.size("terms")

    def keys(low: Column, high: Column, own_is_small: bool) -> Column:
        def of_size(other: Column) -> Column:
            small, large = (n, other) if own_is_small else (other, n)
            need = F.ceil(threshold * F.sqrt((small * large).cast("double")) - 1e-9).cast("int")
            some = F.slice("terms", F.lit(1), F.greatest(n - need + 1, F.lit(0)))
            return F.transform(some, lambda t: F.struct(t.alias("t"), small.alias("m"), large.alias("n")))

        return F.explode(F.flatten(F.transform(F.sequence(low, F.greatest(low, high)), of_size)))

    share = threshold * threshold
    small = sets.select(F.col("id").alias("a"), keys(n, F.floor(n / share + 1e-9).cast("int"), True).alias("k"))
    large = sets.select(F.col("id").alias("b"), keys(F.greatest(F.ceil(n * share - 1e-9).cast("int"), F.lit(1)), n, False).alias("k"))
    met = small.select("a", "k.*").join(large.select("b", "k.*"), ["t", "m", "n"])
    return met.filter((F.col("m") < F.col("n")) | (F.col("a") < F.col("b"))).select("a", "b")


def similar_term_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (left_id < right_id) of term sets whose cosine |A and B| / sqrt(|A||B|) reaches theta."""
    rows = materialize(_rarest_first(sets))
    pairs = term_set_candidates(rows, threshold).distinct()
    both = (pairs.join(rows.select(F.col("id").alias("a"), F.col("terms").alias("_a")), "a")
            .join(rows.select(F.col("id").alias("b"), F.col("terms").alias("_b")), "b"))
    common = F.size(F.array_intersect("_a", "_b"))
    return (both.filter(common >= threshold * F.sqrt((F.size("_a") * F.size("_b")).cast("double")) - 1e-9)
            .select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id")))


def cross_meeting_topics(topics: DataFrame, threshold: float = 0.68) -> DataFrame:
    """M7. Occurrences of topics in many meetings with the group that their label and keywords put them in.

    ``topics``: meeting_id, topic_id, label, keywords (text). Groups are the connected components
    of the similarity graph, so the outcome does not depend on the order of meetings. Equal
    wordings are one node, however many meetings use them.
    """
    wording = F.concat_ws(" ", "label", "keywords")
    rows = topics.withColumn("terms", F.array_sort(F.array_distinct(X.words(wording))))
    rows = materialize(rows.withColumn("node", F.array_join("terms", " ")))
    nodes = rows.select(F.col("node").alias("id"), "terms").distinct()
    edges = similar_term_sets(nodes, threshold).select(F.col("left_id").alias("src"),
                                                       F.col("right_id").alias("dst"))
    groups = connected_components(edges)
    return rows.join(groups, "node", "left").withColumn(
        "topic_group", F.coalesce("component", "node")).select(*topics.columns, "topic_group")


def topic_groups(occurrences: DataFrame) -> DataFrame:
    """M7, a row per group: label and keywords of its first occurrence, most recurring first."""
    first = F.struct("meeting_id", "topic_id")
    return occurrences.groupBy("topic_group").agg(
        F.count_distinct("meeting_id").alias("meeting_count"),
        F.count(F.lit(1)).alias("occurrences"), F.min_by("label", first).alias("label"),
        F.min_by("keywords", first).alias("keywords")).orderBy(F.desc("meeting_count"), "topic_group")
