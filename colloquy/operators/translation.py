"""Display text and translation memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.functions import vocab as V

ROWS_AT_ONCE = 100_000  # of one text; more are dealt over several groups


def display_texts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """P17, first half. Prose fields of each row in long form; ids, numbers and names stay out."""
    shown = [c for c in rows.columns if c in V.DISPLAY_FIELDS and c not in keys]
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("source"))
                      for c in shown])
    return (rows.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.field", "_p.source")
            .filter(F.col("source").isNotNull() & (F.trim("source") != "")
                    & ~F.col("source").rlike(r"^SEG_\d+$")))


def text_key(c: str = "source"):
    return F.sha2(F.concat(F.lit("english-v1\u001f"), F.col(c)), 256)


def translation_work(texts: DataFrame, memory: DataFrame) -> DataFrame:
    """J10. Distinct texts the memory does not hold yet."""
    wanted = texts.select("source").distinct().withColumn("text_key", text_key())
    return wanted.join(memory.select("text_key"), "text_key", "left_anti")


def known_texts(texts: DataFrame, memory: DataFrame, keys: list[str]) -> DataFrame:
    """``texts`` with the ``translation`` of each, null where the memory has none.

    A text of very many rows would be one group of the join. Its rows are dealt over runs of about
    ``ROWS_AT_ONCE``, and its translation is given to each run. Broadcast are only the keys of such texts.
    """
    counts = texts.groupBy("text_key").agg(F.count(F.lit(1)).alias("_n"))
    frequent = F.broadcast(counts.filter(F.col("_n") > F.lit(ROWS_AT_ONCE)).select(
        "text_key", F.ceil(F.col("_n") / F.lit(ROWS_AT_ONCE)).cast("bigint").alias("_runs")))
    runs = F.coalesce("_runs", F.lit(1).cast("bigint"))
    dealt = texts.join(frequent, "text_key", "left").withColumn("_run", F.pmod(F.xxhash64(*keys, "field"), runs))
    given = memory.select("text_key", "translation").join(frequent, "text_key", "left").select(
        "text_key", "translation", F.explode(F.sequence(F.lit(0).cast("bigint"), runs - 1)).alias("_run"))
    return dealt.join(given, ["text_key", "_run"], "left").drop("_run", "_runs")


def apply_translations(rows: DataFrame, keys: list[str], memory: DataFrame) -> DataFrame:
    """P17/J10. Rows with their prose fields replaced where the memory knows them."""
    texts = display_texts(rows, keys).withColumn("text_key", text_key())
    # Texts of a row lie apart, so they are dealt by row unsorted: one sort in a task instead of two.
    known = known_texts(texts, memory, keys).select(*keys, "field", "source", "translation").repartition(*keys)
    shown = [c for c in rows.columns if c in V.DISPLAY_FIELDS and c not in keys]
    wide = known.groupBy(*keys).agg(*[
        F.max(F.when(F.col("field") == c, F.coalesce("translation", "source"))).alias(f"_{c}")
        for c in shown])
    joined = rows.join(wide, keys, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in shown else F.col(c)
                           for c in rows.columns])
