"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, pass after pass. A document of a
pass finishes at the virtual time

    (words of its source up to and including it, over all passes) / (target of its source)

and the mix is all documents in order of finish time, cut where their words reach the budget.
Targets come from weights by water-filling: no source gives more than ``cap`` times its words.

At scale: only (row, source, words, shuffle key) move, never texts. Running sums are taken in
blocks of the shuffle key and shifted by the sums of the blocks before, so a source with a third
of all rows is spread over thousands of blocks. The global order is a range sort whose slabs
are counted first; only slab totals are ever ordered in one task.

Cases: a null text has no words; null sources are one source, last in order; rows of no words
take part with 0; a source without words has target 0; an empty table gives an empty result;
equal rows are separate members of the queue; a null doc_id is shuffled as the word "null".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import WORD, fresh, whole_text
from colloquy.plans.runtime import materialize

WEIGHTS = (5, 2, 1)
CAP = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("bigint")


def source_targets(units: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(skey, source_size, target): the share of each source of all words.

    Sources in order of code points, null last, take ``weights`` in turn. With the sources
    sorted by limit / weight, the water level over the k-th is (budget - limits before it) /
    (weights from it on); the first source whose limit is not below its level fixes the level.
    Levels fall from there on, so it is the highest of the levels that hold.
    """
    sources = units.groupBy("skey").agg(F.sum("size").alias("source_size"))
    ordinal = F.row_number().over(Window.orderBy(F.col("skey") == "", "skey")) - 1
    picks = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sources.withColumn("weight", F.element_at(picks, (ordinal % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("limit", F.col("source_size") * F.lit(cap))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "skey")
    earlier = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = Window.partitionBy()
    levels = weighed.withColumn(
        "level", (F.sum("source_size").over(everywhere) - F.coalesce(F.sum("limit").over(earlier), F.lit(0)))
        / F.sum("weight").over(onwards))
    fixed = F.max(F.when(F.col("limit") / F.col("weight") >= F.col("level"), F.col("level")))
    return levels.withColumn("water", fixed.over(everywhere)).select(
        "skey", "source_size",
        F.least(F.col("limit").cast("double"), F.col("water") * F.col("weight")).alias("target"))


def queue_units(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                source: str = "source") -> DataFrame:
    """One narrow row per document: uid, doc_id, skey (source, "" for null), size in words."""
    return materialize(docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("skey"),
        word_count(F.col(text)).alias("size"), F.xxhash64(id_col, source, text).alias("row_key")))


def fair_mix(units: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``units`` with source_size, target and ``passes`` (how often the mix takes the row)."""
    sources = materialize(source_targets(units, weights, cap))
    share = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    copies = units.join(sources, "skey").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.least(share, F.lit(cap - 1)).cast("int"))))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                            F.col("epoch").cast("string")))
    copies = copies.withColumn("key", F.substring(key, 1, 16)).withColumn("block", F.substring("key", 1, 3))
    blocks = copies.groupBy("skey", "epoch", "block").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("skey", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("skey", "epoch", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("skey", "epoch", "block").orderBy("key", "doc_id", "size")
    queued = (copies.withColumn("run", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
              .join(bases, ["skey", "epoch", "block"])
              .withColumn("finish", F.coalesce(
                  (F.col("epoch") * F.col("source_size") + F.col("base") + F.col("run"))
                  / F.nullif(F.col("target"), F.lit(0.0)), F.lit(0.0))))
    order = ["finish", "skey", "epoch", "key", "doc_id", "size"]
    slabs = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(queued.select("uid", "source_size", "target", *order)
                         .repartitionByRange(slabs, *order)
                         .withColumn("slab", F.spark_partition_id()))
    totals = ranged.groupBy("slab").agg(F.sum("size").alias("total"))
    sums = totals.select("slab", F.coalesce(
        F.sum("total").over(Window.orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("base"))
    budget = sources.agg(F.sum("source_size").alias("budget")).first().budget or 0  # one number
    within = Window.partitionBy("slab").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    reached = ranged.withColumn("run", F.sum("size").over(within)).join(sums, "slab")
    chosen = F.when(F.col("base") + F.col("run") <= F.lit(budget), 1).otherwise(0)
    return reached.groupBy("uid", "doc_id", "skey", "size", "source_size", "target").agg(
        F.sum(chosen).alias("passes"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once per pass, with the columns of ``docs``.

    Equal rows share their passes: they are gathered to one (map side first) and written out
    as often as the mix takes them together.
    """
    units = queue_units(docs)
    mixed = fair_mix(units, weights, cap)
    takes = (mixed.join(units.select("uid", "row_key"), "uid").groupBy("row_key")
             .agg(F.sum("passes").alias("passes")).filter("passes > 0"))
    key, times = fresh(docs, "row_key"), fresh(docs, "passes")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "source", "text"))
    single = keyed.groupBy(key).agg(*[F.any_value(c).alias(c) for c in docs.columns])
    taken = takes.select(F.col("row_key").alias(key), F.col("passes").cast("int").alias(times))
    return (single.join(taken, key).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
            .select(*docs.columns))
