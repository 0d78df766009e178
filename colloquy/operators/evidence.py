"""Evidence: exact transcript support for every extracted record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators.substrings import first_and_unique, occurrences, rows_containing
from colloquy.plans.ordered import BLOCK, carry_last

ID_BLOCK = 1024


def transcript_rows(segments: DataFrame) -> DataFrame:
    """Segments as running text: normalised, blank rows dropped (positions must be dense)."""
    start = F.col("start_sec") if "start_sec" in segments.columns else F.lit(None).cast("double")
    return segments.select(
        "meeting_id", F.col("segment_id").alias("row_id"), X.norm("text").alias("text"),
        F.when(~F.isnan(start) & (start >= 0), start).alias("start_sec"),
        X.norm("speaker").alias("speaker")).filter("text <> ''")


def locate_quotes(quotes: DataFrame, segments: DataFrame, block: int = BLOCK) -> DataFrame:
    """J1. One row per distinct (meeting_id, quote) that occurs verbatim in its transcript.

    Segment ids, time and speaker are known only where the quote occurs exactly once.
    """
    needles = quotes.select("meeting_id", X.norm("quote").alias("needle")).filter("needle <> ''")
    found = first_and_unique(
        occurrences(needles, transcript_rows(segments), ["meeting_id"],
                    ["start_sec", "speaker"], block), ["meeting_id"])
    cover, unique = F.col("cover"), F.col("is_unique")
    speakers = F.array_distinct(F.transform(cover, lambda r: r["speaker"]))
    return found.select(
        "meeting_id", F.col("needle").alias("quote"), "is_unique",
        F.when(unique, cover[0]["row_id"]).alias("seg_from"),
        F.when(unique, F.element_at(cover, -1)["row_id"]).alias("seg_to"),
        F.when(unique, cover[0]["start_sec"]).alias("timestamp"),
        F.when(unique & (F.size(speakers) == 1), X.blank_to_null(speakers[0])).alias("speaker"))


def id_spans(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """Text of the inclusive id range of each distinct (meeting_id, seg_from, seg_to).

    Ranges with an id outside the transcript get no row. The text of a range is one value of
    the result, so its length is that of the range itself.
    """
    rows = transcript_rows(segments).withColumn("_blk", F.floor(F.col("row_id") / ID_BLOCK))
    # What a model cites may be any number: a range is opened only where its end is in the transcript.
    last = rows.groupBy("meeting_id").agg(F.max("row_id").alias("_last"))
    wanted = (spans.select("meeting_id", "seg_from", "seg_to").distinct()
              .filter((F.col("seg_from") >= 0) & (F.col("seg_to") >= F.col("seg_from")))
              .join(last, "meeting_id").filter(F.col("seg_to") <= F.col("_last")).drop("_last")
              .withColumn("_blk", F.explode(F.sequence(
                  F.floor(F.col("seg_from") / ID_BLOCK), F.floor(F.col("seg_to") / ID_BLOCK)))))
    inside = (wanted.join(rows, ["meeting_id", "_blk"])
              .filter(F.col("row_id").between(F.col("seg_from"), F.col("seg_to"))))
    grouped = inside.groupBy("meeting_id", "seg_from", "seg_to").agg(
        F.array_sort(F.collect_list(F.struct("row_id", "text"))).alias("_rows"),
        F.min_by("start_sec", "row_id").alias("span_start"),
        F.min_by("speaker", "row_id").alias("span_speaker"))
    complete = F.size("_rows") == F.col("seg_to") - F.col("seg_from") + 1
    return grouped.filter(complete).select(
        "meeting_id", "seg_from", "seg_to",
        F.array_join(F.transform("_rows", lambda r: r["text"]), " ").alias("span_text"),
        "span_start", X.blank_to_null(F.col("span_speaker")).alias("span_speaker"))


def ground(items: DataFrame, segments: DataFrame, quote: str = "evidence",
           block: int = BLOCK) -> DataFrame:
    """J1 then J2: ground each item by its quote, else by its cited segment ids.

    ``items``: meeting_id, the quote column and, when ids are cited, seg_from and seg_to (their
    lowest and highest). Adds src_evidence, src_from, src_to, src_time, src_speaker and
    src_kind: 'quote', 'ids', 'ambiguous' (real but repeated) or null (unsupported).
    """
    has_ids = "seg_from" in items.columns
    rows = items.withColumn("_quote", X.norm(quote))
    quotes = rows.select("meeting_id", F.col("_quote").alias("quote"))
    located = locate_quotes(quotes, segments, block).select(
        "meeting_id", F.col("quote").alias("_quote"), F.col("is_unique").alias("_unique"),
        F.col("seg_from").alias("_q_from"), F.col("seg_to").alias("_q_to"),
        F.col("timestamp").alias("_q_time"), F.col("speaker").alias("_q_speaker"))
    rows = rows.join(located, ["meeting_id", "_quote"], "left")
    by_quote = F.coalesce("_unique", F.lit(False))
    found = F.col("_unique").isNotNull()
    if has_ids:
        # Only items their quote does not settle need the text of the cited range.
        open_items = rows.filter(~by_quote).select("meeting_id", "seg_from", "seg_to")
        rows = rows.join(id_spans(open_items, segments), ["meeting_id", "seg_from", "seg_to"],
                         "left")
        by_ids = ~by_quote & F.col("span_text").isNotNull()
        span = F.when((F.col("_quote") != "") & F.col("span_text").contains(F.col("_quote")),
                      F.col("_quote")).otherwise(F.col("span_text"))
        columns = {
            "src_evidence": F.when(by_ids, span).when(found, F.col("_quote")),
            "src_from": F.when(by_ids, F.col("seg_from")).otherwise(F.col("_q_from")),
            "src_to": F.when(by_ids, F.col("seg_to")).otherwise(F.col("_q_to")),
            "src_time": F.when(by_ids, F.col("span_start")).otherwise(F.col("_q_time")),
            "src_speaker": F.when(by_ids, F.col("span_speaker")).otherwise(F.col("_q_speaker")),
            "src_kind": F.when(by_quote, "quote").when(by_ids, "ids").when(found, "ambiguous")}
    else:
        columns = {
            "src_evidence": F.when(found, F.col("_quote")), "src_from": F.col("_q_from"),
            "src_to": F.col("_q_to"), "src_time": F.col("_q_time"),
            "src_speaker": F.col("_q_speaker"),
            "src_kind": F.when(by_quote, "quote").when(found, "ambiguous")}
    return rows.withColumns(columns).drop(
        "_quote", "_unique", "_q_from", "_q_to", "_q_time", "_q_speaker", "span_text",
        "span_start", "span_speaker")


def valid_evidence(items: DataFrame, segments: DataFrame) -> DataFrame:
    """J3. Items whose quote stands inside the text of their cited id range."""
    spans = id_spans(items, segments).select("meeting_id", "seg_from", "seg_to", "span_text")
    quote = X.norm("evidence")
    return (items.join(spans, ["meeting_id", "seg_from", "seg_to"])
            .filter((quote != "") & F.col("span_text").contains(quote)).drop("span_text"))


def fuzzy_evidence(quotes: DataFrame, segments: DataFrame, block: int = BLOCK) -> DataFrame:
    """J4. Longest-first edge-trimmed version of each quote that occurs in the transcript.

    Drops up to three words per side; keeps at least 60 % of the words and 15 characters.
    """
    q = (quotes.select("meeting_id", X.norm("quote").alias("quote")).distinct()
         .withColumn("_w", F.split("quote", " ")).filter(F.size("_w") >= 3))
    drops = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(
        F.floor(i / 4).cast("int").alias("drop_left"), (i % 4).cast("int").alias("drop_right")))
    kept = F.size("_w") - F.col("drop_left") - F.col("drop_right")
    trims = (q.select("meeting_id", "quote", "_w", F.explode(drops).alias("_d"))
             .select("meeting_id", "quote", "_w", "_d.drop_left", "_d.drop_right")
             .filter((kept >= 1) & (kept >= F.size("_w") * 0.6))
             .withColumn("needle", F.array_join(
                 F.slice("_w", F.col("drop_left") + 1, kept), " "))
             .filter(F.length("needle") >= 15))
    found = locate_quotes(trims.select("meeting_id", F.col("needle").alias("quote")), segments,
                          block).withColumnRenamed("quote", "needle")
    best = F.min(F.struct("drop_left", "drop_right", F.col("needle").alias("matched"), "seg_from",
                          "seg_to", "timestamp", "speaker")).alias("_best")
    return (trims.join(found, ["meeting_id", "needle"]).groupBy("meeting_id", "quote").agg(best)
            .select("meeting_id", "quote", "_best.*"))


def segment_at(points: DataFrame, segments: DataFrame) -> DataFrame:
    """J7. Point-in-time lookup: containing segment, else latest earlier one, else the first.

    ``points``: meeting_id, point_id, at_sec. Adds segment_id and its start.
    """
    usable = segments.filter(F.col("start_sec").isNotNull() & F.col("end_sec").isNotNull()
                             & (F.col("end_sec") >= F.col("start_sec")))
    rows = usable.select("meeting_id", F.lit(None).cast("bigint").alias("point_id"),
                         F.col("start_sec").alias("_sec"), F.lit(0).alias("_kind"),
                         F.struct("segment_id", "start_sec").alias("_seg"))
    asked = points.select("meeting_id", "point_id", F.col("at_sec").alias("_sec"),
                          F.lit(1).alias("_kind"),
                          F.lit(None).cast(rows.schema["_seg"].dataType).alias("_seg"))
    first = usable.groupBy("meeting_id").agg(
        F.min_by(F.struct("segment_id", "start_sec"), F.struct("start_sec", "segment_id"))
        .alias("_first"))
    merged = rows.unionByName(asked).withColumn(
        "_tie", F.struct("_kind", F.coalesce(F.col("_seg.segment_id"), F.lit(0))))
    hit = carry_last(merged, ["meeting_id"], "_sec", "_tie", F.col("_seg"), "_hit")
    return (hit.filter("_kind = 1").join(first, "meeting_id")
            .withColumn("_hit", F.coalesce("_hit", "_first"))
            .select("meeting_id", "point_id", F.col("_sec").alias("at_sec"), "_hit.segment_id",
                    F.col("_hit.start_sec").alias("seconds")))


def jump_targets(evidence: DataFrame, segments: DataFrame) -> DataFrame:
    """J8. Where a click on evidence leads: cited id, else time, else text either way round.

    ``evidence``: meeting_id, evidence_id, segment_ids, timestamp, evidence.
    """
    known = segments.select("meeting_id", "segment_id", "start_sec")
    timed = evidence.filter(F.col("timestamp").isNotNull()).select(
        "meeting_id", F.col("evidence_id").alias("point_id"), F.col("timestamp").alias("at_sec"))
    by_time = segment_at(timed, segments).select(
        "meeting_id", F.col("point_id").alias("evidence_id"),
        F.col("segment_id").alias("_t_id"), F.col("seconds").alias("_t_sec"))
    cited = (evidence.select("meeting_id", "evidence_id", F.explode("segment_ids").alias("segment_id"))
             .join(known, ["meeting_id", "segment_id"])
             .join(by_time.select("meeting_id", "evidence_id", "_t_id"),
                   ["meeting_id", "evidence_id"], "left")
             .groupBy("meeting_id", "evidence_id")
             # The segment playing at the given time wins when it is among the cited ones.
             .agg(F.min(F.struct((F.col("segment_id") != F.coalesce("_t_id", F.lit(-1))).alias("o"),
                                 "segment_id", "start_sec")).alias("_c")))
    rest = (evidence.filter(X.norm("evidence") != "")
            .join(cited.select("meeting_id", "evidence_id"), ["meeting_id", "evidence_id"],
                  "left_anti")
            .filter(F.col("timestamp").isNull())
            .select("meeting_id", "evidence_id", F.lower(X.norm("evidence")).alias("needle")))
    texts = transcript_rows(segments).select("meeting_id", "row_id",
                                             F.lower("text").alias("text"))
    inside = (rows_containing(rest, texts, ["meeting_id"])
              .groupBy("meeting_id", "needle").agg(F.min("row_id").alias("segment_id")))
    # The other way round: each distinct segment text looked for in the evidence texts.
    firsts = texts.groupBy("meeting_id", F.col("text").alias("needle")).agg(
        F.min("row_id").alias("segment_id"))
    holders = rest.select("meeting_id", F.col("needle").alias("text")).distinct().withColumn(
        "row_id", F.col("text"))
    around = (rows_containing(firsts, holders, ["meeting_id"]).join(firsts, ["meeting_id", "needle"])
              .groupBy("meeting_id", F.col("row_id").alias("needle"))
              .agg(F.min("segment_id").alias("segment_id")))
    by_text = (inside.unionByName(around).groupBy("meeting_id", "needle")
               .agg(F.min("segment_id").alias("segment_id"))
               .join(rest, ["meeting_id", "needle"]).join(known, ["meeting_id", "segment_id"])
               .select("meeting_id", "evidence_id", F.col("segment_id").alias("_x_id"),
                       F.col("start_sec").alias("_x_sec")))
    keys = ["meeting_id", "evidence_id"]
    joined = (evidence.select(*keys, "timestamp").join(cited, keys, "left")
              .join(by_time, keys, "left").join(by_text, keys, "left"))
    return joined.select(
        *keys, F.coalesce("_c.segment_id", "_t_id", "_x_id").alias("segment_id"),
        F.when(F.col("_c").isNotNull(), F.coalesce("_c.start_sec", "timestamp"))
        .when(F.col("_t_id").isNotNull(), F.coalesce("_t_sec", "timestamp"))
        .otherwise(F.col("_x_sec")).alias("seconds"),
        F.when(F.col("_c").isNotNull(), "segment-id").when(F.col("_t_id").isNotNull(), "timestamp")
        .when(F.col("_x_id").isNotNull(), "text").alias("reason"))


def grounding_rate(items: DataFrame, segments: DataFrame, by: list[str]) -> DataFrame:
    """A19. Share of items whose quote is a transcript substring."""
    found = locate_quotes(items.select("meeting_id", F.col("evidence").alias("quote")), segments)
    hit = found.select("meeting_id", F.col("quote").alias("_q"), F.lit(1).alias("_hit"))
    return (items.withColumn("_q", X.norm("evidence")).join(hit, ["meeting_id", "_q"], "left")
            .groupBy(*by).agg(F.count(F.lit(1)).alias("items"), F.count("_hit").alias("grounded"),
                              F.round(F.count("_hit") / F.count(F.lit(1)), 6).alias("rate")))
