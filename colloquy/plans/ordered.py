"""Ordered computations over transcripts that do not depend on one task per meeting.

A window over ``partitionBy(meeting_id)`` sends a whole meeting to one task. Positions in a
meeting are whole numbers, so every ordered computation here is cut into blocks of ``block``
positions instead: running values are computed inside a block and shifted by the totals of the
blocks before it; bounded frames (lag, lead, "three before, three after") see copies of the
few rows that lie beyond the block's edges. Only one row per block is ever ordered per meeting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 65536


def block_of(pos: str | Column, block: int = BLOCK) -> Column:
    position = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(position / F.lit(block)).cast("bigint")


def running_sum(df: DataFrame, keys: list[str], pos: str, value: Column, out: str,
                inclusive: bool = False, block: int = BLOCK) -> DataFrame:
    """Sum of ``value`` over earlier positions (and this one when ``inclusive``)."""
    rows = df.withColumn("_blk", block_of(pos, block)).withColumn("_rs_val", value)
    totals = rows.groupBy(*keys, "_blk").agg(F.sum("_rs_val").alias("_rs_total"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, "_blk",
                          F.coalesce(F.sum("_rs_total").over(before), F.lit(0)).alias("_rs_base"))
    end = 0 if inclusive else -1
    inside = (Window.partitionBy(*keys, "_blk").orderBy(pos)
              .rowsBetween(Window.unboundedPreceding, end))
    local = rows.withColumn("_rs_local", F.coalesce(F.sum("_rs_val").over(inside), F.lit(0)))
    return (local.join(bases, keys + ["_blk"])
            .withColumn(out, F.col("_rs_base") + F.col("_rs_local"))
            .drop("_blk", "_rs_val", "_rs_base", "_rs_local"))


def dense_position(df: DataFrame, keys: list[str], order: str, out: str,
                   width: int = BLOCK) -> DataFrame:
    """0-based rank of ``order`` within ``keys``; ``order`` is a distinct whole number per key."""
    ranked = running_sum(df, keys, order, F.lit(1).cast("bigint"), out, block=width)
    return ranked.withColumn(out, F.col(out).cast("bigint"))


def with_neighbours(df: DataFrame, keys: list[str], pos: str, before: int, after: int,
                    columns: dict[str, Callable[[WindowSpec], Column]],
                    block: int = BLOCK) -> DataFrame:
    """Add window columns whose frames reach at most ``before``/``after`` positions away.

    Positions must be dense. Each column is a function of the ordered window.
    """
    if max(before, after) > block:
        raise ValueError("a frame must not be wider than a block")
    home = block_of(pos, block)
    offset = F.col(pos) - home * block
    targets = F.array(
        home,
        F.when((offset >= block - before) & F.lit(before > 0), home + 1),
        F.when((offset < after) & (home > 0), home - 1))
    copies = (df.withColumn("_home", home)
              .withColumn("_blk", F.explode(F.filter(targets, lambda t: t.isNotNull()))))
    window = Window.partitionBy(*keys, "_blk").orderBy(pos)
    for name, make in columns.items():
        copies = copies.withColumn(name, make(window))
    return copies.filter(F.col("_blk") == F.col("_home")).drop("_home", "_blk")


def ranged(df: DataFrame, along: list) -> DataFrame:
    """``df`` sorted by range over ``along``, with ``_at``, the place of each row, and ``_part``, its range.

    Rows that are alike in ``along`` are told apart by a number, so they too lie over many ranges.
    """
    from colloquy.plans.runtime import materialize

    order, parts = [*along, "_row"], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *order)
                       .sortWithinPartitions(*order).drop("_row").withColumn("_at", F.monotonically_increasing_id())
                       .withColumn("_part", F.shiftright("_at", 33)))


def carry_last(df: DataFrame, keys: list[str], order: str, tie: str, value: Column, out: str) -> DataFrame:
    """Latest non-null ``value`` at or before each row, in (order, tie) order.

    The as-of building block: rows lie in ranges of that order, however many share a key or a moment; a row
    with no value before it in its own range takes the last one of the ranges before.
    """
    rows = ranged(df.withColumn("_val", value), [*keys, order, tie])
    inside = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(*keys, "_part").agg(F.max_by("_val", F.when(F.col("_val").isNotNull(), F.col("_at"))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_part", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    return (rows.withColumn("_here", F.last("_val", ignorenulls=True).over(inside))
            .join(carried, [*keys, "_part"])
            .withColumn(out, F.coalesce("_here", "_carry"))
            .drop("_at", "_part", "_val", "_here", "_carry"))


def walk(rows: DataFrame, keys: list[str], order: str, step: Callable, schema: str,
         block: int = BLOCK) -> DataFrame:
    """A sequential walk along ``order`` within ``keys``, exact for transcripts of any length.

    ``step(pdf, state)`` walks one stretch of ``block`` positions, in order, from the state (text, or
    None at the beginning) that the stretch before it ends in, and returns (rows, end state). All
    stretches walk at once, first as if each were the beginning; those whose incoming state turns
    out to differ walk again, until none does. Walks that forget (chunks, peaks) settle at
    once; the first stretch not yet settled settles in every round, so the rounds always end.
    """
    from colloquy.plans.runtime import has_rows, materialize

    names = [field.split()[0] for field in schema.split(", ")]
    types = dict(rows.dtypes)
    shape = ", ".join([*[f"{k} {types[k]}" for k in keys], "_blk bigint", "_end string", schema])

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        first = pdf.iloc[0]
        found, end = step(pdf, first["_state"] if isinstance(first["_state"], str) else None)
        # The last row tells the end state; its other columns are empty.
        out = pd.concat([found, pd.DataFrame({"_end": [end]})], ignore_index=True)
        for k in (*keys, "_blk"):
            out[k] = first[k]
        return out[[*keys, "_blk", "_end", *names]]

    cut = rows.withColumn("_blk", block_of(order, block))
    along = Window.partitionBy(*keys).orderBy("_blk")
    chain = materialize(cut.select(*keys, "_blk").distinct().withColumn("_before", F.lag("_blk").over(along)))
    found = materialize(cut.withColumn("_state", F.lit(None).cast("string"))
                        .groupBy(*keys, "_blk").applyInPandas(run, shape))
    used = chain.withColumn("_state", F.lit(None).cast("string"))
    later = chain.filter("_before is not null")
    while has_rows(later):
        ends = found.filter("_end is not null").select(*keys, F.col("_blk").alias("_before"),
                                                      F.col("_end").alias("_now"))
        now = used.join(ends, [*keys, "_before"], "left").withColumn(
            "_same", F.col("_now").eqNullSafe(F.col("_state")))
        now = materialize(now)
        again = now.filter("not _same").select(*keys, "_blk", F.col("_now").alias("_state"))
        if not has_rows(again):
            break
        redone = cut.join(again, [*keys, "_blk"]).groupBy(*keys, "_blk").applyInPandas(run, shape)
        found = materialize(found.join(again.drop("_state"), [*keys, "_blk"], "left_anti").unionByName(redone))
        used = now.select(*keys, "_blk", "_before", F.col("_now").alias("_state"))
    return found.filter("_end is null").drop("_end")


GROUP_LIMIT = 1000  # up to here Spark itself drops lower ranks before the shuffle


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, spread: list[str],
          shards: int = 64) -> DataFrame:
    """First ``k`` rows per key with their ``rank``.

    For small ``k`` the rank filter is applied in every input partition before rows are shuffled.
    For larger ``k`` rows are first cut down inside hash shards of ``spread``, so that a large key
    is spread over many tasks.
    """
    final = Window.partitionBy(*keys).orderBy(*order)
    rows = df
    if k > GROUP_LIMIT:
        local = Window.partitionBy(*keys, "_shard").orderBy(*order)
        rows = (df.withColumn("_shard", F.pmod(F.xxhash64(*spread), F.lit(shards)))
                .withColumn("_rank", F.row_number().over(local)).filter(F.col("_rank") <= k)
                .drop("_shard", "_rank"))
    return rows.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
