"""Question answering over transcripts: context retrieval, history, citations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.functions import vocab as V
from colloquy.operators.chunks import character_chunks
from colloquy.plans.ordered import BLOCK, running_sum, top_k

PIECE, SPREAD, SMALLEST = 400, 20, 50


def _quoted_bytes(c: Column) -> Column:
    """Bytes of a text as a JSON string: quotes, backslashes and control marks grow."""
    escaped = F.length(F.regexp_replace(c, r'[^"\\\n\r\t]', ""))
    return F.octet_length(c) + escaped + 2


def row_bytes() -> Column:
    """Bytes of {"segment_id":"SEG_n","start":..,"end":..,"text":".."}."""
    number = lambda c: F.length(F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return (F.lit(len('{"segment_id":"SEG_","start":,"end":,"text":}'))
            + F.length(F.col("segment_id").cast("string")) + number("start_sec")
            + number("end_sec") + _quoted_bytes(F.col("text")))


def _fill(budget: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ranked = pdf.sort_values(["overlap", "piece_no"], ascending=[False, True]).to_dict("records")
        spread = sorted((r for r in ranked if r["spread_no"] >= 0), key=lambda r: r["spread_no"])
        size, chosen = 2, {}
        for rows, ceiling in ((ranked, budget // 2), (spread, budget), (ranked, budget)):
            for r in rows:
                if r["piece_no"] not in chosen and size + r["cost"] <= ceiling:
                    chosen[r["piece_no"]] = True
                    size += r["cost"]
        keep = pdf[pdf["piece_no"].isin(list(chosen))]
        return keep[["meeting_id", "piece_no"]]
    return run


def retrieve(segments: DataFrame, questions: DataFrame, budget: int = 10000,
             block: int = BLOCK, meetings: DataFrame | None = None) -> DataFrame:
    """K3. Context rows for one question per meeting, at most ``budget`` serialized bytes.

    Short meetings come whole. Else pieces of 400 characters: the best by shared words fill half
    the budget, twenty evenly spaced ones come next, the best again fill the rest. Of pieces with
    equal cost only the first ``budget // cost`` by rank can be taken, so only those (and the
    twenty) are walked through, however long the meeting is.

    ``segments``: meeting_id, segment_id, start_sec, end_sec, text. ``questions``: meeting_id,
    question. ``meetings``: meeting_id, full_text; where a meeting has no segments, its text is segment 0 without times.
    """
    rows = segments.withColumn("text", F.trim("text")).filter("text <> ''")
    if meetings is not None:
        rows = rows.select("meeting_id", "segment_id", "start_sec", "end_sec", "text")
        bare = meetings.join(rows.select("meeting_id").distinct(), "meeting_id", "left_anti").select(
            "meeting_id", F.lit(0).cast("bigint").alias("segment_id"), F.lit(None).cast("double").alias("start_sec"),
            F.lit(None).cast("double").alias("end_sec"), F.trim(F.col("full_text")).alias("text")).filter("text <> ''")
        rows = rows.unionByName(bare)
    total = rows.groupBy("meeting_id").agg((F.sum(row_bytes() + 1) + 1).alias("_bytes"))
    long = total.filter(F.col("_bytes") > budget).join(
        questions.select("meeting_id", X.words("question").alias("_q")), "meeting_id").select(
        "meeting_id", F.array_except("_q", X.words_array(V.CHAT_STOP)).alias("_terms"))
    whole = rows.join(total.filter(F.col("_bytes") <= budget), "meeting_id", "left_semi").join(
        questions.select("meeting_id"), "meeting_id", "left_semi")
    parts = rows.join(long, "meeting_id").withColumn(
        "_pieces", character_chunks(F.col("text"), PIECE)).withColumn("_n", F.size("_pieces"))
    placed = running_sum(parts, ["meeting_id"], "segment_id", F.col("_n"), "_first", block=block)
    pieces = placed.select("meeting_id", "segment_id", "start_sec", "end_sec", "_terms", "_first",
                           F.posexplode("_pieces").alias("_k", "text"))
    pieces = pieces.select(
        "meeting_id", "segment_id", "start_sec", "end_sec", "text",
        (F.col("_first") + F.col("_k")).cast("bigint").alias("piece_no"),
        F.size(F.array_intersect("_terms", X.words("text"))).alias("overlap"))
    pieces = pieces.withColumn("cost", (row_bytes() + 1).cast("bigint"))
    count = placed.groupBy("meeting_id").agg(F.sum("_n").cast("bigint").alias("_count"))
    steps = F.least(F.lit(SPREAD).cast("bigint"), F.col("_count"))
    # Banker's rounding of the evenly spaced positions.
    spots = count.select("meeting_id", F.posexplode(F.transform(
        F.sequence(F.lit(0).cast("bigint"), steps - 1), lambda s: F.bround(
            s * (F.col("_count") - 1) / F.greatest(F.lit(1).cast("bigint"), steps - 1))
        .cast("bigint"))).alias("spread_no", "piece_no"))
    spots = spots.groupBy("meeting_id", "piece_no").agg(F.min("spread_no").alias("spread_no"))
    light = pieces.select("meeting_id", "piece_no", "overlap", "cost")
    best = top_k(light, ["meeting_id", "cost"], [F.desc("overlap"), F.asc("piece_no")],
                 budget // SMALLEST, ["piece_no"])
    best = best.filter(F.col("rank") <= F.floor(F.lit(budget) / F.col("cost")))
    spaced = light.join(spots, ["meeting_id", "piece_no"])
    pool = (best.drop("rank").withColumn("spread_no", F.lit(-1)).unionByName(spaced)
            .groupBy("meeting_id", "piece_no", "overlap", "cost")
            .agg(F.max("spread_no").alias("spread_no")))
    # A bounded pool: budget/cost rows per distinct cost and twenty more.
    chosen = pool.groupBy("meeting_id").applyInPandas(
        _fill(budget), "meeting_id bigint, piece_no bigint")
    columns = ["meeting_id", "segment_id", "piece_no", "start_sec", "end_sec", "text"]
    picked = pieces.join(chosen, ["meeting_id", "piece_no"]).select(*columns)
    return picked.unionByName(whole.select("meeting_id", "segment_id", F.col("segment_id")
                                           .alias("piece_no"), "start_sec", "end_sec", "text"))


def history(turns: DataFrame, last: int = 6, characters: int = 400) -> DataFrame:
    """W9. The last six user and assistant turns per conversation, cut to their last 400 characters."""
    spoken = turns.filter(F.col("role").isin("user", "assistant"))
    recent = top_k(spoken, ["conv_id"], [F.desc("turn")], last, ["turn"]).drop("rank")
    start = F.greatest(F.length("text") - characters + 1, F.lit(1))
    return recent.withColumn("text", F.substr("text", start, F.lit(characters)))


def check_citations(answers: DataFrame, context: DataFrame) -> DataFrame:
    """J9. Answers whose every cited id was supplied, at least one; the rest become "not found".

    ``answers``: answer_id, answer, cited (array). ``context``: answer_id, segment_id.
    """
    cited = answers.select("answer_id", F.posexplode("cited").alias("_i", "segment_id"))
    known = cited.join(context.select("answer_id", "segment_id").distinct(),
                       ["answer_id", "segment_id"], "left_semi")
    counts = known.groupBy("answer_id").agg(F.count(F.lit(1)).alias("_known"))
    rows = answers.join(counts, "answer_id", "left")
    ok = ((F.size("cited") > 0) & (F.coalesce("_known", F.lit(0)) == F.size("cited"))
          & (F.trim("answer") != "") & (F.trim("answer") != V.NOT_FOUND))
    return rows.select(
        "answer_id", F.when(ok, F.trim("answer")).otherwise(V.NOT_FOUND).alias("answer"),
        F.when(ok, F.array_distinct("cited")).otherwise(F.array().cast("array<bigint>"))
        .alias("cited"), ok.alias("grounded"))
