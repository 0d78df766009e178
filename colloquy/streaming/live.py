"""Transcripts as they arrive (T1-T3) on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.plans.ordered import with_neighbours


def deduplicated_intake(arrivals: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """T1. Arriving rows once per key; a repeat within the delay is dropped."""
    return arrivals.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """T1. Append to a table in commits of their own; a restart resumes from the checkpoint."""
    return (rows.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def daily_counts(events: DataFrame, time: str, by: list[str], delay: str | None = None
                 ) -> DataFrame:
    """T2. Counts per day and kind; on a stream, rows later than the delay are dropped."""
    rows = events.withWatermark(time, delay) if delay else events
    return rows.groupBy(F.window(time, "1 day"), *by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("day"), *by, "n")


def sessions(events: DataFrame, time: str, by: list[str], gap: str, delay: str | None = None
             ) -> DataFrame:
    """T3. Activity sessions per speaker or user: a gap ends one."""
    rows = events.withWatermark(time, delay) if delay else events
    return rows.groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n")).select(
        *by, F.col("session_window.start").alias("started"),
        F.col("session_window.end").alias("ended"), "n")


def with_clock(arrivals: DataFrame, time: str, base: str) -> DataFrame:
    """A stream that can be closed: beside what arrives, ticks of a table at ``base`` move its watermark on."""
    spark, path = arrivals.sparkSession, f"{base}/clock"
    schema = f"{time} {dict(arrivals.dtypes)[time]}"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return arrivals.unionByName(spark.readStream.schema(schema).parquet(path), allowMissingColumns=True)


def close(arrivals: DataFrame, time: str, base: str) -> None:
    """The last tick: with it every open window and session ends; that of the tick itself never does."""
    end = F.to_timestamp(F.lit("9999-01-01 00:00:00")).cast(dict(arrivals.dtypes)[time])
    arrivals.sparkSession.range(1).select(end.alias(time)).write.mode("append").parquet(f"{base}/clock")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came later than the delay allows, which no window counts."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def drained(arrivals: DataFrame, time: str, base: str, results) -> tuple[DataFrame, int]:
    """All of ``results(stream)`` for what has arrived, up to the last event, and the number of late rows."""
    rows, late = results(with_clock(arrivals, time, base)), 0
    for last in (False, True):
        if last:
            close(arrivals, time, base)
        query = append_stream(rows, f"{base}/t", f"{base}/c")
        query.awaitTermination()
        late += late_rows(query)
    return arrivals.sparkSession.read.schema(rows.schema).parquet(f"{base}/t"), late


TURN_STATE = "last_id long, last_speaker string, settled long, told long, recent string"
HORIZON = 256  # segments of a meeting that stay open for late ones before them


def stateful_turns(segments: DataFrame, horizon: int = HORIZON, idle_ms: int | None = None) -> DataFrame:
    """T3. Change of the number of speaker turns per meeting and batch, and of segments that came too late.

    State per meeting: the newest ``horizon`` segments, which late ones may still come before, the last one
    before them and the turns up to it. A segment older than that one was before its batch is late: it is counted apart and
    changes nothing. While a batch is read, all its segments of a meeting are held.
    A batch touches only the meetings it has rows of. With ``idle_ms`` the state of a meeting that is idle for so long is
    dropped; such a query looks at its timers for ever, so it is for triggers that never end.
    """
    import json

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def starts(speakers: list, before) -> int:
        return sum(s is not None and s != b for s, b in zip(speakers, [before, *speakers], strict=False))

    def update(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last_id, last_speaker, settled, told, recent = state.get if state.exists else (None, None, 0, 0, "{}")
        open_ = {int(k): v for k, v in json.loads(recent).items()}
        late = 0
        for pdf in frames:
            for segment, speaker in zip(pdf["segment_id"], pdf["speaker"], strict=True):
                if last_id is not None and segment <= last_id:
                    late += 1
                else:
                    open_[int(segment)] = None if pd.isna(speaker) else speaker
        # Rows of one batch come in no order, so none of them makes another one late.
        order = sorted(open_)
        for segment in order[:max(0, len(order) - horizon)]:
            speaker = open_.pop(segment)
            settled += starts([speaker], last_speaker)
            last_id, last_speaker = segment, speaker
        total = settled + starts([open_[k] for k in sorted(open_)], last_speaker)
        state.update((last_id, last_speaker, settled, total, json.dumps(open_)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"meeting_id": [key[0]], "turns": [total - told], "late": [late]})

    return segments.groupBy("meeting_id").applyInPandasWithState(
        update, "meeting_id long, turns long, late long", TURN_STATE, "append",
        GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def live_turns(segments: DataFrame, base: str) -> DataFrame:
    """T3. New speaker turns per meeting and micro-batch, as segments arrive in order.

    Between batches only the last segment of each meeting is kept, in a table per batch that a
    retried batch reads again. Inside a batch the turns come from the batch operator, which
    shares out a long meeting over many tasks.
    """
    def count(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("meeting_id", "segment_id", "speaker")
        if epoch > 0:
            rows = rows.withColumn("_new", F.lit(True)).unionByName(
                spark.read.parquet(f"{base}/last/{epoch - 1}").withColumn("_new", F.lit(False)))
        else:
            rows = rows.withColumn("_new", F.lit(True))
        before = with_neighbours(rows, ["meeting_id"], "segment_id", 1, 0, {
            "_before": lambda w: F.lag("speaker").over(w)})
        starts = F.col("speaker").isNotNull() & ~F.col("speaker").eqNullSafe(F.col("_before"))
        (before.filter("_new").groupBy("meeting_id").agg(F.count_if(starts).alias("turns"))
         .write.mode("overwrite").parquet(f"{base}/turns/epoch={epoch}"))
        (rows.groupBy("meeting_id").agg(F.max(F.struct("segment_id", "speaker")).alias("_l"))
         .select("meeting_id", "_l.*").write.mode("overwrite").parquet(f"{base}/last/{epoch}"))

    query = (segments.writeStream.foreachBatch(count)
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return segments.sparkSession.read.parquet(f"{base}/turns")


def run_to_table(rows: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drain what has arrived into a table and read it back."""
    query = append_stream(rows, path, checkpoint)
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
