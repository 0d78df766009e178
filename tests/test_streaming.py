"""Streams in several batches, with restarts and late rows."""

import random

from pyspark.sql import functions as F

from colloquy.plans import catalog
from colloquy.streaming import live

SEGMENT = "meeting_id bigint, segment_id bigint, speaker string"


def turns_by_hand(rows):
    last, turns = {}, {}
    for meeting, _, speaker in sorted(rows, key=lambda r: r[:2]):
        turns[meeting] = turns.get(meeting, 0) + (speaker is not None and speaker != last.get(meeting))
        last[meeting] = speaker
    return turns


def test_turns_with_state_over_batches_and_restarts(spark, tmp_path):
    """Segments out of order, meetings without news in a batch, a new query for every two batches."""
    rng = random.Random(4)
    rows = [(m, s, rng.choice(["Ann", "Bo", None])) for m in range(6) for s in range(30)]
    order = sorted(rows, key=lambda r: r[1] + rng.randrange(5))  # late by a few segments
    late = [(0, -5, "Zed"), (1, -1, "Zed")]
    batches = [order[i:i + 36] for i in range(0, len(order), 36)] + [late]
    seen = []
    for k, batch in enumerate(batches):
        spark.createDataFrame([r for r in batch if r[0] != 5 or k != 1], SEGMENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        seen += [r for r in batch if r[0] != 5 or k != 1]
        if k % 2 == 0 or k == len(batches) - 1:
            stream = spark.readStream.schema(SEGMENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            out = live.run_to_table(live.stateful_turns(stream, horizon=8), f"{tmp_path}/t", f"{tmp_path}/c")
    got = {r.meeting_id: (r.turns, r.late) for r in out.groupBy("meeting_id").agg(
        F.sum("turns").alias("turns"), F.sum("late").alias("late")).collect()}
    want = turns_by_hand([r for r in seen if r[1] >= 0])
    assert got == {m: (want[m], int(m in (0, 1))) for m in want}


def test_segments_of_one_batch_are_never_late_to_each_other(spark, tmp_path):
    """A meeting longer than the horizon, newest first, that reaches the state in several pieces."""
    rows = [(7, s, "ABC"[s // 3 % 3]) for s in range(199, -1, -1)]
    spark.createDataFrame(rows, SEGMENT).coalesce(1).write.parquet(f"{tmp_path}/in")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "25")
    try:
        out = live.run_to_table(live.stateful_turns(spark.readStream.schema(SEGMENT).parquet(f"{tmp_path}/in"), horizon=8),
                                f"{tmp_path}/t", f"{tmp_path}/c").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert [(r.turns, r.late) for r in out] == [(turns_by_hand(rows)[7], 0)]


def test_streams_read_tables_of_several_files(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.meeting_id: r.turns for r in catalog.t3_stateful_turns(spark, str(tmp_path)).collect()}
    assert got == turns_by_hand([(r.conv_id, r.turn, r.role) for r in rows.collect()])


def test_closed_streams_are_complete_and_late_rows_counted(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, event_type string"
    rows = spark.range(48).selectExpr("id AS event_id", "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,cast(id AS int)) AS ts",
                                      "if(id % 2 = 0, 'a', 'b') AS event_type")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    counts = lambda s: live.daily_counts(s, "ts", ["event_type"], "1 hour")
    table, late = live.drained(stream(), "ts", f"{tmp_path}/one", counts)
    assert late == 0 and sorted((str(r.day)[:10], r.event_type, r.n) for r in table.collect()) == [
        ("2024-01-01", "a", 12), ("2024-01-01", "b", 12), ("2024-01-02", "a", 12), ("2024-01-02", "b", 12)]
    for k in (100, 101):  # the watermark of one batch tells what is late in the batch after the next
        rows.filter("event_id = 47").withColumn("event_id", F.lit(k).cast("bigint")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows.filter("event_id < 3").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # a day late
    table, late = live.drained(stream(), "ts", f"{tmp_path}/two", counts)
    assert late > 0 and table.agg(F.sum("n")).first()[0] == 50
    gaps, _ = live.drained(stream(), "ts", f"{tmp_path}/three", lambda s: live.sessions(s, "ts", ["event_type"], "90 minutes", "1 hour"))
    assert gaps.agg(F.sum("n")).first()[0] == 50 and gaps.count() == 48
