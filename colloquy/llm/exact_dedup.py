"""Exact deduplication by content sort, with DataFrame operations only.

Texts are range-partitioned by sampled splitters, sorted externally, and equal texts, now
neighbours, are compared in full (a window over the whole text closes a run where the text
differs from its neighbour's). Splitters are short (the first characters and a hash), so sampling never
carries whole texts to the driver, and texts that share a long beginning still spread.

A group of copies may hold a third of all rows. Its text is found by one counting pass over
hashes (summed on the map side); only texts with more than ``1 / HOT_SHARE`` of all rows are
dealt over as many runs as keep each below that share, and the runs, one row each, are joined at the end.
There are at most ``HOT_SHARE`` such texts, whatever the size of the table.

Cases: a null text is empty; texts are equal only when identical; of equal rows, exactly one
is kept; null ids come last (a group of null ids only has a null keep_id and keeps one row); an
empty table gives an empty result; other columns of the input do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import fresh, whole_text
from colloquy.plans.runtime import materialize

HOT_SHARE = 2048  # texts with over 1/2048 of the rows are split; so there are fewer than 2048
PREFIX = 24  # characters of the text in a splitter


def hot_texts(docs: DataFrame, text: str) -> DataFrame:
    """(h, runs): hashes with too many rows for one run, and over how many to deal them."""
    total = docs.count()
    counts = docs.groupBy(F.xxhash64(whole_text(F.col(text))).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return (counts.filter(F.col("n") * HOT_SHARE > F.lit(total))
            .filter("n > 1")
            .select("h", F.ceil(F.col("n") * HOT_SHARE / F.lit(max(total, 1))).cast("int").alias("runs")))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    ``keep_id`` is the largest id among the rows of the same text.
    """
    hot = F.broadcast(materialize(hot_texts(docs, text)))  # under HOT_SHARE rows of 12 bytes
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(F.col(text)).alias("t"),
                       F.monotonically_increasing_id().alias("uid"))
    rows = rows.withColumn("h", F.xxhash64("t")).join(hot, "h", "left")
    run = F.when(F.col("runs").isNotNull(), F.pmod(F.xxhash64("doc_id", "uid"), F.col("runs"))).otherwise(F.lit(-1))
    rows = rows.select("doc_id", "uid", "t", "h", run.cast("int").alias("run"), F.substring("t", 1, PREFIX).alias("head"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "head", "h", "run")
    same = Window.partitionBy("head", "h", "run", "t")  # satisfied by the range partitioning
    first = same.orderBy(F.col("doc_id").desc_nulls_last(), "uid")
    whole = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = materialize(dealt.select(
        "doc_id", "run", F.sha2("t", 256).alias("text_sha256"), F.row_number().over(first).alias("place"),
        F.first("doc_id").over(whole).alias("best"), F.count(F.lit(1)).over(whole).alias("n")))
    lead = F.struct(F.col("best").isNotNull().alias("has"), F.col("best"), F.col("run"))
    heads = runs.filter("run >= 0 and place = 1").groupBy("text_sha256").agg(
        F.max(lead).alias("top"), F.sum("n").alias("all_n"))
    joined = runs.join(F.broadcast(heads), "text_sha256", "left")  # under HOT_SHARE rows of 100 bytes
    split = F.col("run") >= 0
    return joined.select(
        "doc_id", F.when(split, F.col("top.best")).otherwise(F.col("best")).alias("keep_id"),
        F.when(split, F.col("all_n")).otherwise(F.col("n")).cast("bigint").alias("group_size"),
        ((F.col("place") == 1) & (~split | (F.col("run") == F.col("top.run")))).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; null ids last, ties by row content.

    The same sort, carrying the rows themselves: each run hands on its best row, and only the
    best rows of split texts are compared once more.
    """
    hot = F.broadcast(materialize(hot_texts(docs, text)))
    h, runs, run, head, place, t = (fresh(docs, c) for c in ("_h", "_runs", "_run", "_head", "_place", "_t"))
    rows = docs.withColumn(t, whole_text(F.col(text)))
    rows = rows.withColumn(h, F.xxhash64(t)).join(
        hot.select(F.col("h").alias(h), F.col("runs").alias(runs)), h, "left")
    number = F.pmod(F.xxhash64(id_col, F.monotonically_increasing_id()), F.col(runs))
    rows = rows.withColumn(run, F.coalesce(number, F.lit(-1)).cast("int")).withColumn(
        head, F.substring(t, 1, PREFIX)).drop(runs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, head, h, run)
    best = Window.partitionBy(head, h, run, t).orderBy(F.col(id_col).desc_nulls_last())
    kept = dealt.withColumn(place, F.row_number().over(best)).filter(F.col(place) == 1)
    again = Window.partitionBy(h, t).orderBy(F.col(id_col).desc_nulls_last(), run)
    split = kept.filter(F.col(run) >= 0).withColumn(place, F.row_number().over(again)).filter(F.col(place) == 1)
    return kept.filter(F.col(run) < 0).select(*docs.columns).unionByName(split.select(*docs.columns))
