"""Every operator as a runnable query over the given tables, under its inventory id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.functions import vocab as V
from colloquy.operators import (chunks, evidence, extract, models, reconcile, records, retrieval,
                                segmentation, stats, summarize, translation, vectors, weights)
from colloquy.plans import fixtures as fx
from colloquy.plans.runtime import fresh_path, materialize, spread
from colloquy.sources import meetings as sources
from colloquy.sources import responses
from colloquy.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
GROUP = ["run_id", "meeting_id", "category"]
CONFIG = {"model": "none", "temperature": "0", "budget": "16384"}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- inputs shared by queries ------------------------------------------------------------------

def meetings(spark, d) -> DataFrame:
    """Orders seen as uploaded meetings."""
    o = fx.table(spark, d, "orders")
    status = (F.when(F.col("o_orderstatus") == "F", "done")
              .when(F.col("o_orderstatus") == "O", "processing").otherwise("uploaded"))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.col("o_orderpriority"), F.lit("-"), F.col("o_orderkey").cast("string"),
                 F.when(F.col("o_orderkey") % 9 == 0, ".pdf").when(F.col("o_orderkey") % 2 == 0, ".mp4")
                 .otherwise(".WAV")).alias("filename"),
        F.when(F.col("o_orderkey") % 13 != 0, F.floor("o_totalprice") / 100)
        .alias("duration_sec"),
        F.when(F.col("o_orderkey") % 3 == 0, "en").when(F.col("o_orderkey") % 3 == 1, "pt_BR")
        .alias("language"), F.col("o_orderdate").alias("uploaded_at"), status.alias("status"))


def sentences(spark, d) -> DataFrame:
    return extract.sentence_table(fx.segments(spark, d))


def validated(spark, d) -> DataFrame:
    """R1 over both runs, the table all record queries start from."""
    segs = materialize(fx.segments(spark, d))
    return materialize(records.validate(materialize(fx.candidates(segs)), segs))


def accepted(spark, d) -> DataFrame:
    return records.number(validated(spark, d).filter("reason is null"), GROUP)


def crowded(spark, d) -> DataFrame:
    """Accepted records with a second one for each source, and some that cite no source."""
    base = validated(spark, d).filter("reason is null")
    second = base.withColumn("text", F.concat(F.lit("Second point on violet harbour lanterns near quiet mills: "), F.col("text")))
    none = F.lit(None).cast("bigint")
    loose = base.filter("seg_from % 5 = 1").withColumn(
        "text", F.concat(F.lit("Loose remark about seven amber kites over tall dunes: "), F.col("text"))).withColumns(
        {"seg_from": none, "seg_to": none, "timestamp": F.lit(None).cast("double")})
    return base.unionByName(second).unionByName(loose)


def runs(spark, d, items: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The records of both runs with their ids, from one validation."""
    rows = materialize(accepted(spark, d) if items is None else items)
    return records.assign_ids(rows.filter("run_id = 1")), records.assign_ids(rows.filter("run_id = 2"))


def run_of(spark, d, run: int) -> DataFrame:
    return runs(spark, d)[run - 1]


def spread_sentences(spark, d) -> DataFrame:
    """The same rows as ``sentences``, split and looked at on all cores."""
    return extract.sentence_table(spread(fx.segments(spark, d), "meeting_id", "segment_id"))


def doc_sentences(spark, d) -> DataFrame:
    return fx.texts(spark, d).select(
        "doc_id", F.posexplode(X.sentences("text")).alias("sentence_no", "sentence"))


def topic_units(spark, d) -> DataFrame:
    """Units with times, text and the topic segment they belong to."""
    units = fx.units(spark, d)
    starts = segmentation.detect_boundaries(units)
    sec = F.col("segment_id") * 7
    rows = units.select("meeting_id", "segment_id", "embedding", sec.cast("double").alias("start_sec"),
                        (sec + 6).cast("double").alias("end_sec"),
                        F.concat(F.lit("unit "), F.col("segment_id").cast("string")).alias("text"))
    return segmentation.unit_topics(rows, starts)


def fixed_units(spark, d) -> DataFrame:
    """Units cut into topic segments of seven units."""
    units = fx.units(spark, d)
    starts = units.filter(F.col("segment_id") % 7 == 0).select("meeting_id", "segment_id")
    sec = F.col("segment_id") * 7
    rows = units.select("meeting_id", "segment_id", "embedding", sec.cast("double").alias("start_sec"),
                        (sec + 6).cast("double").alias("end_sec"),
                        F.concat(F.lit("unit "), F.col("segment_id").cast("string")).alias("text"))
    return segmentation.unit_topics(rows, starts)


def labelled_segments(spark, d) -> DataFrame:
    """Topic segments of the templated transcripts: eight units each, five recurring topics."""
    segs = fx.segments(spark, d)
    indexed = segs.withColumn("segment_index", F.floor(F.col("segment_id") / 8).cast("bigint"))
    return segmentation.topic_segments(indexed).withColumn(
        "canonical_topic_id", F.col("segment_index") % 5)


# --- sources and sinks ----------------------------------------------------------------------------

@query
def s1_scan_meetings(spark, d):
    docs = fx.texts(spark, d)
    nothing = F.lit(None).cast("string")
    as_json = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("filename"),
        F.col("lang").alias("language"), F.col("text").alias("full_text"),
        F.transform(X.sentences("text"), lambda s, i: F.struct(
            (i * 2.0).alias("start"), (i * 2.0 + 1).alias("end"), nothing.alias("speaker"),
            F.concat(F.lit("S"), (i % 3).cast("string")).alias("speaker_id"), s.alias("text"))).alias("segments"))
    path = sources.write_snapshot(as_json, fresh_path(spark, "meetings"), form="json")
    read = sources.explode_segments(sources.read_meetings(spark, path, multi_line=False))
    return read.select(F.col("meeting_id").cast("bigint").alias("meeting_id"), "segment_id",
                       "start_sec", "end_sec", "speaker", F.md5("text").alias("text_md5"))


@query
def s2_snapshot(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    path = sources.write_snapshot(docs, fresh_path(spark, "snapshot"), ["lang"])
    return spark.read.parquet(path).select("doc_id", F.col("lang").cast("string").alias("lang"),
                                           "n_chars")


@query
def s3_meeting_list(spark, d):
    return sources.project_meetings(meetings(spark, d))


@query
def s4_segments_of_meeting(spark, d):
    return sources.segments_of(fx.segments(spark, d), 7)


@query
def s5_append_meetings(spark, d):
    docs = fx.table(spark, d, "documents")
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("filename"), F.transform(
        X.sentences("text"), lambda s: F.struct(none.alias("start"), none.alias("end"),
                                                text.alias("speaker"), text.alias("speaker_id"),
                                                s.alias("text"))).alias("segments"))
    base = fresh_path(spark, "append")
    sources.append_meetings(rows.filter("id % 2 = 0"), f"{base}/m", f"{base}/s")
    sources.append_meetings(rows.filter("id % 2 = 1"), f"{base}/m", f"{base}/s")
    counts = spark.read.parquet(f"{base}/s").groupBy("meeting_id").agg(
        F.count(F.lit(1)).alias("segments"))
    return spark.read.parquet(f"{base}/m").select(F.col("id").alias("meeting_id"), "filename").join(
        counts, "meeting_id", "left").select(
        "meeting_id", "filename", F.coalesce("segments", F.lit(0)).alias("segments"))


@query
def s6_upsert(spark, d):
    o = meetings(spark, d).select("id", "status", "uploaded_at")
    fresh = o.filter("id % 4 = 0 or id % 10 = 3").withColumn("status", F.lit("reanalysed"))
    return reconcile.upsert(o.filter("id % 10 <> 3"), fresh, ["id"])


@query
def s7_labelled_csv(spark, d):
    s = sentences(spark, d)
    label = (F.when(F.col("segment_id") % 4 == 0, "DECISION").when(F.col("segment_id") % 4 == 1,
             "QUESTION").when(F.col("segment_id") % 4 == 2, "NOISE"))
    path = fresh_path(spark, "labelled")
    s.select("sentence", label.alias("label")).write.option("header", True).csv(path)
    return sources.read_labelled(spark, path).groupBy("sentence", "label").agg(
        F.count(F.lit(1)).alias("n"))


@query
def s8_merge_sources(spark, d):
    docs = fx.table(spark, d, "documents").select(
        F.col("doc_id").alias("meeting_id"), F.col("source").alias("filename"),
        (F.col("n_chars") / 10).alias("duration_sec"), F.md5("text").alias("full_text"),
        F.col("n_chars").alias("n_segments"))
    stored = docs.filter("meeting_id % 3 <> 0")
    cached = docs.filter("meeting_id % 2 = 0").select(
        "meeting_id", F.lit("cached").alias("filename"), F.lit(None).cast("double")
        .alias("duration_sec"), "full_text", (F.col("n_segments") % 5).alias("n_segments"))
    return sources.merge_sources(stored, cached)


@query
def s9_normalise_types(spark, d):
    segs = fx.segments(spark, d)
    broken = F.col("segment_id") % 5
    raw = segs.select(
        "meeting_id", F.when(broken != 1, F.col("segment_id").cast("string")).otherwise("SEG").alias("id"),
        F.col("segment_id").alias("position"), F.when(broken != 2, F.col("text")).alias("text"),
        F.when(broken != 3, F.col("start_sec").cast("string")).otherwise("soon").alias("start"),
        F.when(broken != 4, F.col("end_sec").cast("string")).otherwise("-1").alias("end"),
        F.when(broken != 0, F.col("speaker")).otherwise("").alias("speaker"),
        F.lit("S9").alias("speaker_id"))
    return sources.normalise_types(raw)


def _responses(spark, d):
    """Responses with one record each, of all categories, sound and broken in four ways."""
    c = fx.candidates(fx.segments(spark, d))
    ids, is_task = F.array("seg_from"), F.col("category") == "action_items"
    task = F.struct(F.col("item_text").alias("task"), F.lit("Pending").alias("status"), "owner", "deadline",
                    "evidence", ids.alias("segment_ids"))
    follow = is_task & (F.col("seg_from") % 3 == 0)
    body = F.to_json(F.struct(
        F.array().cast("array<string>").alias("summary"),
        F.when(is_task & ~follow, F.array(task)).alias("action_items"), F.when(follow, F.array(task)).alias("follow_ups"),
        F.when(F.col("category") == "questions", F.array(F.struct(
            F.col("item_text").alias("question"), "evidence", ids.alias("segment_ids")))).alias("questions"),
        F.when(F.col("category") == "decisions", F.array(F.struct(
            F.col("item_text").alias("decision"), "evidence", ids.alias("segment_ids")))).alias("decisions")))
    kind = F.col("seg_from") % 4
    content = (F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
               .when(kind == 1, F.concat(F.regexp_replace(body, r"\]\}$", "],}")))
               .when(kind == 2, F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(',"topics":[')))
               .otherwise(F.lit("not json")))
    return c.select("run_id", "meeting_id", "category", "seg_from", content.alias("content"))


@query
def s10_parse_responses(spark, d):
    parsed = responses.parse_responses(_responses(spark, d))
    first = F.coalesce(F.get("parsed.action_items", F.lit(0))["task"], F.get("parsed.follow_ups", F.lit(0))["task"],
                       F.get("parsed.decisions", F.lit(0))["decision"], F.get("parsed.questions", F.lit(0))["question"])
    return parsed.select("run_id", "meeting_id", "category", "seg_from", "salvaged", "rejected", first.alias("item_text"))


@query
def s11_response_schema(spark, d):
    parsed = responses.parse_responses(_responses(spark, d).drop("seg_from", "category"))
    rows = responses.candidate_rows(parsed, ["run_id", "meeting_id"])
    return rows.groupBy("run_id", "category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("seg_from").alias("seg_sum"))


@query
def s12_report_dataset(spark, d):
    heads = fx.segments(spark, d).groupBy("meeting_id").agg(F.max("end_sec").alias("duration_sec"))
    heads = heads.withColumn("filename", F.concat(F.lit("meeting-"), F.col("meeting_id").cast(
        "string"))).withColumn("language", F.when(F.col("meeting_id") % 2 == 0, "en"))
    return sources.report_dataset(heads, accepted(spark, d).filter("run_id = 1"))


@query
def s13_saved_model(spark, d):
    path = models.save_model(_trained(spark, d), fresh_path(spark, "model"))
    rows = spread(sentences(spark, d).select("sentence").distinct())
    return models.classify(models.load_model(path), rows).select("sentence", "model_label")


@query
def s14_previous_run(spark, d):
    path = fresh_path(spark, "runs")
    items = accepted(spark, d).select("meeting_id", "run_id", "category", "seg_from")
    for run in (1, 2):
        part = items.filter((F.col("run_id") == run) & ((F.col("meeting_id") % 3 != 0)
                                                       | (F.lit(run) == 1)))
        sources.append_run(part.drop("run_id"), run, path)
    return sources.previous_run(spark.read.parquet(path), 3).groupBy(
        "meeting_id", "run_id").agg(F.count(F.lit(1)).alias("n"))


# --- text and projections ------------------------------------------------------------------------

def _texts(spark, d):
    return fx.segments(spark, d).select("meeting_id", "segment_id", "text", "start_sec")


@query
def p1_norm(spark, d):
    return fx.texts(spark, d).select("doc_id", F.md5(X.norm("text")).alias("norm_md5"))


@query
def p2_without_fillers(spark, d):
    return _texts(spark, d).select("meeting_id", "segment_id",
                                   X.without_fillers("text").alias("clean"))


@query
def p3_sentences(spark, d):
    return doc_sentences(spark, d).select("doc_id", "sentence_no", F.md5("sentence").alias("md5"))


@query
def p3_units(spark, d):
    return fx.texts(spark, d).select("doc_id", F.posexplode(X.units("text")).alias("unit_no", "unit")).select(
        "doc_id", "unit_no", F.md5("unit").alias("md5"))


@query
def p4_tokens(spark, d):
    return fx.texts(spark, d).select(
        "doc_id", F.size(X.words("text")).alias("words"),
        F.size(X.letter_words("text")).alias("letter_words"),
        F.md5(F.array_join(X.letter_words("text"), " ")).alias("md5"))


@query
def p5_content_tokens(spark, d):
    return _texts(spark, d).select("meeting_id", "segment_id", F.array_join(
        X.content_words("text"), " ").alias("topic_words"), F.array_join(
        X.content_words("text", V.LABEL_STOP), " ").alias("label_words"))


@query
def p6_lemmas(spark, d):
    table = spark.createDataFrame(sorted(V.LEMMAS.items()), "token string, lemma string")
    tokens = _texts(spark, d).select("meeting_id", "segment_id", F.posexplode(
        X.content_words("text")).alias("pos", "token"))
    # The dictionary is a constant of twenty rows.
    return tokens.join(F.broadcast(table), "token", "left").select(
        "meeting_id", "segment_id", "pos", "token", F.coalesce("lemma", "token").alias("lemma"))


@query
def p7_terms(spark, d):
    return _texts(spark, d).select("meeting_id", "segment_id",
                                   F.array_join(X.terms("text"), " ").alias("terms"))


@query
def p8_full_text(spark, d):
    return stats.full_texts(_texts(spark, d)).select("meeting_id", F.md5("full_text").alias("text_md5"),
                                                     F.length("full_text").alias("characters"))


@query
def p9_clock(spark, d):
    m = meetings(spark, d)
    return m.select("id", X.clock(F.col("duration_sec")).alias("clock"),
                    X.duration(F.col("duration_sec")).alias("duration"))


@query
def p10_dates(spark, d):
    iso = F.when(F.col("id") % 7 == 0, "last Tuesday").when(F.col("id") % 7 == 1, "").otherwise(
        F.date_format("uploaded_at", "yyyy-MM-dd'T'HH:mm:ss"))
    return meetings(spark, d).select("id", X.display_date(iso).alias("shown"))


@query
def p11_rounding(spark, d):
    return fx.table(spark, d, "events").select("event_id", F.round(F.col("value") / 7, 3)
                                               .alias("seconds"))


@query
def p12_language(spark, d):
    tag = F.when(F.col("id") % 5 == 0, " not a tag ").otherwise(F.col("language"))
    return meetings(spark, d).select("id", X.language_tag(tag).alias("tag"),
                                     X.primary_language(tag).alias("primary"))


@query
def p13_word_counts(spark, d):
    return fx.conversation_segments(spark, d).groupBy("meeting_id").agg(
        F.sum(X.word_count("text")).alias("words"), F.count(F.lit(1)).alias("segments"))


@query
def p14_highlights(spark, d):
    spots = X.highlights(F.col("text"), F.lit("On"))
    return _texts(spark, d).select("meeting_id", "segment_id", F.size(spots).alias("hits"),
                                   F.array_join(spots.cast("array<string>"), ",").alias("at"))


@query
def p15_digest(spark, d):
    return records.transcript_digest(fx.segments(spark, d))


@query
def p16_compact_evidence(spark, d):
    segs = fx.segments(spark, d)
    ids = F.when(F.col("segment_id") % 3 == 0, F.array("segment_id")).when(
        F.col("segment_id") % 3 == 1, F.sequence("segment_id", F.col("segment_id") + 4)).otherwise(
        F.array(F.col("segment_id"), F.col("segment_id") + 2, F.col("segment_id") + 3))
    rows = segs.select("meeting_id", "segment_id", F.col("text").alias("evidence"),
                       ids.alias("segment_ids"))
    return responses.compact_evidence(rows).select(
        "meeting_id", "segment_id", "evidence",
        F.array_join(F.col("segment_ids").cast("array<string>"), ",").alias("ids"))


@query
def p17_display_text(spark, d):
    rows = _displayed(spark, d)
    memory = _memory(spark, d)
    return translation.apply_translations(rows, DISPLAY_KEYS, memory)


DISPLAY_KEYS = ["run_id", "meeting_id", "category", "seg_from"]


def _displayed(spark, d):
    shown = lambda c: F.when(F.col("category") == c, F.col("item_text"))
    return fx.candidates(fx.segments(spark, d)).select(
        *DISPLAY_KEYS, shown("action_items").alias("task"), shown("decisions").alias("decision"),
        shown("questions").alias("question"), "evidence", "owner", "deadline", F.lit("SEG_1").alias("label"))


def _memory(spark, d):
    known = translation.display_texts(_displayed(spark, d), DISPLAY_KEYS)
    return known.select("source").distinct().filter(F.length("source") % 2 == 0).select(
        translation.text_key().alias("text_key"), F.upper("source").alias("translation"))


# --- predicates ------------------------------------------------------------------------------------

def _flagged(name: str, make: Callable) -> None:
    def run(spark, d):
        rows = sentences(spark, d).select("meeting_id", "segment_id", "sentence_no", "sentence")
        return rows.filter(make("sentence"))
    run.__name__ = name
    query(run)


_flagged("f1_actions", X.is_action)
_flagged("f2_decisions", X.is_decision)
_flagged("f3_open_issues", X.is_open_issue)
_flagged("f4_meaningful_questions", X.is_meaningful_question)


@query
def f5_substantive(spark, d):
    return summarize.summary_candidates(sentences(spark, d)).select("meeting_id", "pos.*", "sentence")


@query
def f6_topic_labels(spark, d):
    label = F.when(F.col("segment_id") % 6 == 0, F.lit(" Okay ")).when(
        F.col("segment_id") % 6 == 1, F.lit("x")).otherwise(F.col("text"))
    rows = _texts(spark, d).select("meeting_id", "segment_id", label.alias("label"))
    return rows.filter(X.is_topic_label("label"))


@query
def f7_whole_word(spark, d):
    c = fx.candidates(fx.segments(spark, d)).filter("owner is not null")
    return c.select("run_id", "meeting_id", "seg_from", "owner",
                    X.contains_word(F.col("item_text"), F.col("owner")).alias("named"),
                    X.contains_word(F.col("item_text"), F.lit("end of week")).alias("week"),
                    X.contains_word(F.col("item_text"), F.lit("repo")).alias("part_of_word"))


@query
def f8_search(spark, d):
    labels = extract.segment_labels(accepted(spark, d))
    return extract.search_segments(fx.segments(spark, d), labels, " RELEASE ", "Decisions").select(
        "meeting_id", "segment_id", "text")


@query
def f9_search_meetings(spark, d):
    return meetings(spark, d).filter(F.lower("filename").contains("urgent-1")).select(
        "id", "filename")


@query
def f10_uploads(spark, d):
    m = meetings(spark, d).select(
        "id", "filename", F.when(F.col("id") % 2 == 0, "Audio/MPEG; q=1").otherwise("text/plain")
        .alias("content_type"), (F.coalesce("duration_sec", F.lit(0.0)) * 150000).cast("bigint")
        .alias("size_bytes"))
    return extract.check_uploads(m).select("id", "extension", "code")


@query
def f11_summary_points(spark, d):
    segs = fx.segments(spark, d)
    point = F.when(F.col("segment_id") == 1, F.lit("We the way forward is clear.")).otherwise(
        F.col("text"))
    points = segs.select("meeting_id", F.col("segment_id").alias("point_no"), point.alias("point"),
                         F.when(F.col("segment_id") % 5 == 4, "Never said.").otherwise(F.col("text"))
                         .alias("quote"))
    # Quotes are matched against the transcript of their own meeting.
    grounded = evidence.locate_quotes(points, segs)
    return extract.summary_points(points, grounded).select("meeting_id", "point_no", "point")


# --- field extraction --------------------------------------------------------------------------------

@query
def x1_owner(spark, d):
    return fx.segments(spark, d).select("meeting_id", "segment_id", X.owner_in(
        F.col("text"), F.col("speaker")).alias("owner")).filter("owner is not null")


@query
def x2_deadline(spark, d):
    return _texts(spark, d).select("meeting_id", "segment_id", X.deadline_in(F.col("text"))
                                   .alias("deadline")).filter("deadline is not null")


@query
def x3_priority(spark, d):
    return _texts(spark, d).select("meeting_id", "segment_id", X.priority_in(F.col("text"))
                                   .alias("priority")).filter("priority is not null")


@query
def x4_status(spark, d):
    given = F.when(F.col("segment_id") % 9 == 0, F.lit(" On  Hold ")).when(
        F.col("segment_id") % 9 == 1, F.lit("odd"))
    return _texts(spark, d).select("meeting_id", "segment_id", X.status_of(
        given, F.col("text")).alias("status"))


@query
def x5_action_table(spark, d):
    return extract.actions(sentences(spark, d))


@query
def x6_decision_table(spark, d):
    return extract.decisions(sentences(spark, d))


@query
def x7_question_table(spark, d):
    return extract.questions(sentences(spark, d))


@query
def x8_tidy_questions(spark, d):
    text = F.concat(F.when(F.col("segment_id") % 2 == 0, "okay, ").otherwise(""), F.col("text"))
    return _texts(spark, d).select("meeting_id", "segment_id", X.tidy_question(text).alias("tidy"))


@query
def x9_gazetteer(spark, d):
    return extract.gazetteer_entities(fx.segments(spark, d))


def _raw_entities(spark, d):
    segs = fx.segments(spark, d)
    first = F.regexp_extract("text", r"^(\w+)", 1)
    label = F.when(F.col("segment_id") % 2 == 0, "PERSON").otherwise("WORK_OF_ART")
    context = F.when(F.col("segment_id") % 4 == 0, F.concat(first, F.lit(", the small company")))
    return segs.select("meeting_id", "segment_id", F.lit(0).cast("bigint").alias("word_no"),
                       first.alias("entity"), label.alias("raw_label"),
                       F.coalesce(context, F.col("text")).alias("context"))


@query
def x10_entity_labels(spark, d):
    return extract.label_entities(_raw_entities(spark, d)).select(
        "meeting_id", "segment_id", "entity", "label")


@query
def x11_valid_entities(spark, d):
    rows = _raw_entities(spark, d).select(
        "meeting_id", "segment_id", "entity", F.when(F.col("segment_id") % 3 == 0, "DATE")
        .when(F.col("segment_id") % 3 == 1, "PERSON").otherwise("TECHNOLOGY").alias("label"))
    return rows.filter(extract.is_valid_entity(F.col("entity"), F.col("label")))


@query
def x12_candidate_entities(spark, d):
    segs = fx.segments(spark, d)
    m = segs.select("meeting_id").distinct()
    pairs = [("people", "Alice"), ("people", "Ali"), ("people", "this"), ("people", "Speaker 1"),
             ("products", "docker"), ("products", "Docker"), ("products", "report"),
             ("products", "machine learning"), ("dates", "end of week"), ("dates", "Sunday")]
    names = m.select("meeting_id", F.explode(F.array(*[
        F.struct(F.lit(g).alias("group_name"), F.lit(n).alias("name")) for g, n in pairs]))
        .alias("_p")).select("meeting_id", "_p.*")
    return extract.validate_entities(names, segs).select("meeting_id", "group_name", "name")


# --- joins --------------------------------------------------------------------------------------------

def _quotes(spark, d, segs: DataFrame):
    """Quotes of one segment, of two neighbouring ones, and of parts of words."""
    after = segs.select("meeting_id", (F.col("segment_id") - 1).alias("segment_id"),
                        F.col("text").alias("_next"))
    rows = segs.join(after, ["meeting_id", "segment_id"], "left")
    kind = F.col("segment_id") % 5
    both = F.concat_ws(" ", "text", "_next")
    quote = (F.when(kind == 0, F.col("text")).when(kind == 1, both)
             .when(kind == 2, F.substr("text", F.lit(3), F.lit(14)))
             .when(kind == 3, F.substr("text", F.lit(2), F.lit(5)))
             .otherwise(F.concat(F.lit("Well, "), F.col("text"))))
    return rows.select("meeting_id", "segment_id", quote.alias("quote"))


@query
def j1_locate_quotes(spark, d):
    segs = materialize(fx.segments(spark, d))
    return evidence.locate_quotes(_quotes(spark, d, segs), segs)


@query
def j2_ground_by_ids(spark, d):
    segs = fx.segments(spark, d)
    items = segs.select("meeting_id", F.col("segment_id").alias("item_no"),
                        F.when(F.col("segment_id") % 2 == 0, "Not a quote").otherwise("release")
                        .alias("evidence"), F.col("segment_id").alias("seg_from"),
                        (F.col("segment_id") + F.col("segment_id") % 4).alias("seg_to"))
    return evidence.ground(items, segs).select(
        "meeting_id", "item_no", "src_evidence", "src_from", "src_to", "src_time", "src_speaker",
        "src_kind")


@query
def j3_valid_evidence(spark, d):
    segs = fx.segments(spark, d)
    items = fx.candidates(segs).withColumn("seg_from", F.greatest(F.col("seg_from") - 1, F.lit(0)))
    return evidence.valid_evidence(items, segs).select("run_id", "meeting_id", "category", "seg_from",
                                                       "seg_to")


@query
def j4_fuzzy_evidence(spark, d):
    segs = fx.segments(spark, d)
    quotes = segs.select("meeting_id", F.concat(
        F.lit("So then "), F.col("text"), F.lit(" indeed")).alias("quote"))
    return evidence.fuzzy_evidence(quotes, segs).select(
        "meeting_id", "quote", "drop_left", "drop_right", "matched")


@query
def j5_related_items(spark, d):
    segs = fx.segments(spark, d).withColumn("segment_index", F.floor(F.col("segment_id") / 8)
                                            .cast("bigint"))
    return segmentation.related_items(segs, accepted(spark, d).filter("run_id = 1"))


@query
def j6_segment_labels(spark, d):
    return extract.segment_labels(accepted(spark, d))


@query
def j7_segment_at(spark, d):
    ts = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    points = fx.table(spark, d, "events").select(
        (F.col("user_id") % fx.MEETINGS).alias("meeting_id"), F.col("event_id").alias("point_id"),
        (ts % 700 - 20).alias("at_sec"))
    return evidence.segment_at(points, fx.segments(spark, d))


@query
def j8_jump_targets(spark, d):
    segs = fx.segments(spark, d)
    kind = F.col("segment_id") % 4
    rows = segs.select(
        "meeting_id", F.col("segment_id").alias("evidence_id"),
        F.when(kind == 0, F.array("segment_id", F.lit(99999999).cast("bigint"))).otherwise(
            F.array().cast("array<bigint>")).alias("segment_ids"),
        F.when(kind == 1, F.col("start_sec") + 2.5).alias("timestamp"),
        F.when(kind == 2, F.concat(F.lit("He said: "), F.col("text"), F.lit(" Right?")))
        .otherwise(F.upper(F.substr("text", F.lit(1), F.lit(20)))).alias("evidence"))
    return evidence.jump_targets(rows, segs)


@query
def j9_citations(spark, d):
    turns = fx.conversation_segments(spark, d)
    key = F.col("meeting_id")
    answers = turns.groupBy(key).agg(F.min("segment_id").alias("lo"), F.max("segment_id").alias("hi"))
    answers = answers.select(
        F.col("meeting_id").alias("answer_id"),
        F.when(key % 6 == 0, F.lit(V.NOT_FOUND)).otherwise(F.lit(" Yes. ")).alias("answer"),
        F.when(key % 3 == 0, F.array("lo", "hi", "lo")).when(key % 3 == 1, F.array(
            F.col("lo"), F.lit(777).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
        .alias("cited"))
    context = turns.select(F.col("meeting_id").alias("answer_id"), "segment_id")
    checked = retrieval.check_citations(answers, context)
    return checked.withColumn("cited", F.array_join(F.col("cited").cast("array<string>"), ","))


@query
def j10_translation_work(spark, d):
    texts = translation.display_texts(_displayed(spark, d), DISPLAY_KEYS)
    return translation.translation_work(texts, _memory(spark, d))


@query
def j11_to_analyse(spark, d):
    current = records.manifest(fx.segments(spark, d), CONFIG)
    m = F.col("meeting_id")
    stored = current.filter(m % 5 != 0).withColumn(
        "input_hash", F.when(m % 5 == 1, "changed").otherwise(F.col("input_hash"))).withColumn(
        "state", F.when(m % 5 == 2, "partial").otherwise("complete"))
    return records.to_analyse(current, stored).select("meeting_id", "config_hash")


@query
def j12_missing_chunks(spark, d):
    keys = chunks.chunk_keys(_packed(spark, d))
    stored = keys.filter("meeting_id % 2 = 0")
    return chunks.missing_chunks(keys, stored)


@query
def j13_similar_vectors(spark, d):
    rows = fx.units(spark, d).withColumnRenamed("segment_id", "id")
    return vectors.similar_vectors(rows, ["meeting_id"], 0.25).withColumn(
        "cosine", F.round("cosine", 5))


@query
def j14_conflicts(spark, d):
    prev, new = runs(spark, d)
    new = new.withColumn("owner", F.when(F.col("seg_from") % 2 == 0, "Zed").otherwise(F.col("owner")))
    return _sources(reconcile.match_pairs(prev, new), prev, new)


def _sources(pairs: DataFrame, prev: DataFrame, new: DataFrame) -> DataFrame:
    """Matched records by what they cite and say instead of their places."""
    side = lambda df, p: df.select(
        "meeting_id", "category", F.col("pos").alias(f"{p}_pos"), F.col("seg_from").alias(f"{p}_from"),
        F.col("text").alias(f"{p}_text"))
    return pairs.join(side(prev, "o"), ["meeting_id", "category", "o_pos"]).join(
        side(new, "n"), ["meeting_id", "category", "n_pos"]).select(
        "meeting_id", "category", "o_from", "o_text", "n_from", "n_text")


# --- aggregations -------------------------------------------------------------------------------------

def _ruled(spark, d):
    label = F.when(F.length("sentence") % 3 == 0, "INFORMATION").otherwise("ACTION ITEM")
    rows = sentences(spark, d).select("meeting_id", "segment_id", "sentence_no", "sentence",
                                      label.alias("model_label"),
                                      (F.length("sentence") % 10 / 10.0).alias("confidence"))
    return rows.withColumn("label", X.rule_label("sentence", F.col("model_label"),
                                                 F.col("confidence")))


@query
def a1_class_counts(spark, d):
    return stats.class_counts(_ruled(spark, d), ["meeting_id"])


@query
def a2_insight_counts(spark, d):
    return stats.insight_counts(accepted(spark, d).filter("run_id = 1"))


@query
def a3_speaker_stats(spark, d):
    return stats.speaker_stats(fx.segments(spark, d))


@query
def a4_speaker_count(spark, d):
    return stats.speaker_count(fx.segments(spark, d))


@query
def a5_history_totals(spark, d):
    return stats.history_totals(meetings(spark, d))


@query
def a6_uploads_per_day(spark, d):
    return stats.uploads_per_day(fx.table(spark, d, "events"))


@query
def a7_entities_by_label(spark, d):
    return stats.entities_by_label(extract.gazetteer_entities(fx.segments(spark, d)))


@query
def a8_topic_summary(spark, d):
    return segmentation.topic_summary(labelled_segments(spark, d))


@query
def a9_topic_evolution(spark, d):
    segs = fx.segments(spark, d).withColumn("segment_index", F.floor(F.col("segment_id") / 8)
                                            .cast("bigint"))
    related = segmentation.related_items(segs, accepted(spark, d).filter("run_id = 1"))
    return segmentation.topic_evolution(labelled_segments(spark, d), related)


@query
def a10_funnel(spark, d):
    rows = validated(spark, d)
    merged = records.deduplicate(records.number(rows.filter("reason is null"), GROUP), GROUP)
    return records.funnel(rows, merged, ["run_id", "category"])


@query
def a11_distribution(spark, d):
    return segmentation.distribution(labelled_segments(spark, d))


@query
def a12_overview(spark, d):
    return segmentation.overview(segmentation.topic_summary(labelled_segments(spark, d)))


@query
def a13_mean_vectors(spark, d):
    rows = vectors.mean_vectors(fixed_units(spark, d), ["meeting_id", "segment_index"])
    return rows.select("meeting_id", "segment_index", "units", F.array_join(F.transform(
        "embedding", lambda x: F.round(x * 10000).cast("bigint").cast("string")),
        ",").alias("vector"))


@query
def a14_keywords(spark, d):
    docs = doc_sentences(spark, d).select("doc_id", "sentence_no", X.content_words("sentence")
                                          .alias("tokens"))
    return weights.keywords(docs, ["doc_id"], "sentence_no", 20, 5000)


@query
def a15_stability(spark, d):
    one, two = runs(spark, d)
    ids = one.unionByName(two).withColumn(
        "id", F.concat_ws("-", "meeting_id", "id"))
    return stats.stability(ids.select("run_id", "category", "id"), 1)


@query
def a16_classification_report(spark, d):
    both = fx.table(spark, d, "labels").join(fx.table(spark, d, "documents"), "doc_id")
    guess = F.when(F.col("n_chars") > 400, 1).otherwise(0)
    return stats.classification_report(both.select(
        F.col("quality").cast("string").alias("label"), guess.cast("string").alias("predicted")))


@query
def a17_boundary_scores(spark, d):
    units = fx.units(spark, d)
    truth = units.filter(F.col("segment_id") % 10 == 5).select("meeting_id", F.col("segment_id")
                                                               .alias("pos"))
    found = segmentation.peaks(segmentation.smooth(segmentation.novelty(units))).select(
        "meeting_id", F.col("segment_id").alias("pos"))
    return stats.boundary_scores(truth, found)


@query
def a18_window_diff(spark, d):
    rows = fx.table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 50).cast("bigint").alias("meeting_id"),
        (F.col("vec_id") % 50).alias("segment_id"), F.col("label").alias("ref"),
        F.floor(F.col("vec_id") % 50 / 6).alias("hyp"))
    return stats.window_diff(rows)


@query
def a19_grounding_rate(spark, d):
    segs = fx.segments(spark, d)
    return evidence.grounding_rate(fx.candidates(segs), segs, ["run_id", "category"])


# --- windows ----------------------------------------------------------------------------------------

@query
def w1_turn_starts(spark, d):
    return stats.turn_starts(fx.conversation_segments(spark, d).withColumns(
        {"start_sec": F.lit(None).cast("double"), "end_sec": F.lit(None).cast("double")})).select(
        "meeting_id", "segment_id", "speaker", "is_turn_start")


@query
def w2_context_windows(spark, d):
    return segmentation.context_windows(fx.conversation_segments(spark, d)).select(
        "meeting_id", "segment_id", F.md5("window_text").alias("window_md5"))


@query
def w3_novelty(spark, d):
    return segmentation.novelty(fx.units(spark, d)).withColumn("novelty", F.round("novelty", 4))


@query
def w4_smooth(spark, d):
    return segmentation.smooth(segmentation.novelty(fx.units(spark, d))).select(
        "meeting_id", "segment_id", F.round("smoothed", 4).alias("smoothed"))


@query
def w5_thresholds(spark, d):
    rows = segmentation.thresholds(segmentation.smooth(segmentation.novelty(fx.units(spark, d))))
    return rows.withColumn("threshold", F.round("threshold", 4))


@query
def w6_peaks(spark, d):
    return segmentation.peaks(segmentation.smooth(segmentation.novelty(fx.units(spark, d)))).select(
        "meeting_id", "segment_id")


@query
def w7_boundaries(spark, d):
    return segmentation.detect_boundaries(fx.units(spark, d))


@query
def w8_topic_segments(spark, d):
    segs = fx.segments(spark, d)
    starts = segs.filter("segment_id % 9 = 0 or segment_id % 5 = 3").select(
        "meeting_id", "segment_id")
    return segmentation.topic_segments(segmentation.unit_topics(segs, starts))


@query
def w9_history(spark, d):
    rows = retrieval.history(fx.table(spark, d, "conversations"))
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query
def w10_relabel(spark, d):
    rows = fx.table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 50).cast("bigint").alias("meeting_id"),
        (F.col("vec_id") % 50).alias("segment_index"), F.col("label").alias("cluster"))
    return segmentation.relabel(rows, "cluster")


# --- sorts and top-k -----------------------------------------------------------------------------------

@query
def k1_newest_first(spark, d):
    return stats.newest_first(sources.project_meetings(meetings(spark, d)))


@query
def k2_discussion_topics(spark, d):
    rows = doc_sentences(spark, d)
    return weights.discussion_topics(rows, ["doc_id"], "sentence_no")


@query
def k3_retrieve(spark, d):
    segs = fx.segments(spark, d)
    asked = segs.select("meeting_id").distinct().withColumn(
        "question", F.lit("Who will prepare the invoice and when is the release?"))
    return retrieval.retrieve(segs, asked, 10000)


@query
def k3_retrieve_texts(spark, d):
    """Meetings of which only the text is known."""
    docs = fx.texts(spark, d).select(F.col("doc_id").alias("meeting_id"), F.col("text").alias("full_text"))
    none = fx.segments(spark, d).limit(0).withColumn("meeting_id", F.col("meeting_id").cast("bigint"))
    asked = docs.select("meeting_id").withColumn("question", F.lit("Which release of the les or the de is in the and?"))
    return retrieval.retrieve(none, asked, 10000, meetings=docs).select(
        "meeting_id", "segment_id", "piece_no", "start_sec", F.md5("text").alias("md5"))


@query
def k4_summary(spark, d):
    return summarize.summarize(sentences(spark, d)).select("meeting_id", "pos.*", "sentence", "round")


@query
def k5_report_order(spark, d):
    return stats.report_order(run_of(spark, d, 1).select("meeting_id", "category", "seg_from",
                                                         "seg_to", "id"))


# --- set operations --------------------------------------------------------------------------------------

@query
def u1_open_questions(spark, d):
    items = accepted(spark, d).filter("run_id = 1")
    follow = items.withColumn("category", F.when(
        (F.col("category") == "action_items") & (F.col("seg_from") % 2 == 0), "follow_ups")
        .otherwise(F.col("category")))
    return stats.open_questions(follow)


@query
def u2_merge_entities(spark, d):
    found = extract.gazetteer_entities(fx.segments(spark, d))
    return stats.merge_entities(found.select("meeting_id", F.col("label").alias("group_name"),
                                             F.col("entity").alias("name")))


@query
def u2_merge_summaries(spark, d):
    rows = sentences(spark, d).select("meeting_id", F.col("sentence").alias("point"), F.floor(
        F.col("segment_id") / 16).cast("bigint").alias("chunk_no"),
        F.col("segment_id").alias("point_no"), F.concat(F.lit("turn "), F.col("segment_id").cast("string"))
        .alias("evidence"))
    return stats.merge_summaries(rows)


@query
def u3_id_overlap(spark, d):
    one, two = (r.select("meeting_id", "id") for r in runs(spark, d))
    return one.intersect(two).withColumn("part", F.lit("both")).unionByName(
        one.union(two).distinct().withColumn("part", F.lit("either"))).groupBy(
        "meeting_id", "part").agg(F.count(F.lit(1)).alias("n"))


@query
def u4_stop_lists(spark, d):
    union = F.array_distinct(F.array_union(X.words_array(V.FUNCTION_WORDS),
                                           X.words_array(V.TOPIC_EXTRA)))
    return _texts(spark, d).select("meeting_id", "segment_id", F.array_join(F.array_sort(
        F.array_except(X.words("text"), union)), " ").alias("rest"))


@query
def u5_legacy_view(spark, d):
    return reconcile.legacy_view(accepted(spark, d).filter("run_id = 1"))


# --- chunking ----------------------------------------------------------------------------------------------

@query
def c1_character_chunks(spark, d):
    return fx.texts(spark, d).select("doc_id", F.posexplode(
        chunks.character_chunks(F.col("text"), 400)).alias("chunk_no", "chunk")).select(
        "doc_id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


@query
def c2_token_windows(spark, d):
    return fx.texts(spark, d).select("doc_id", F.posexplode(
        chunks.token_windows(F.col("text"), 128)).alias("window_no", "window")).select(
        "doc_id", "window_no", F.md5("window").alias("window_md5"))


@query
def c3_sentence_chunks(spark, d):
    return fx.texts(spark, d).select("doc_id", F.posexplode(
        chunks.sentence_chunks(F.col("text"))).alias("chunk_no", "chunk"))


def _packed(spark, d):
    return chunks.pack_units(fx.segments(spark, d), 1500)


@query
def c4_pack_units(spark, d):
    return _packed(spark, d)


@query
def c5_display_batches(spark, d):
    rows = chunks.display_batches(fx.texts(spark, d).select("doc_id", "text"))
    return rows.select("doc_id", "piece_no", "batch", F.length("piece").alias("characters"), F.md5("piece").alias("md5"))


@query
def c6_choose_units(spark, d):
    docs = fx.texts(spark, d).select(F.col("doc_id").alias("meeting_id"), "text")
    segs = docs.select("meeting_id", F.posexplode(X.units("text")).alias("segment_id", "text"))
    segs = segs.withColumn("speaker", F.lit(None).cast("string"))
    stored = docs.select("meeting_id", F.when(F.col("meeting_id") % 2 == 0, F.col("text")).otherwise(
        F.concat(F.col("text"), F.lit(" One more. And more."))).alias("full_text"))
    return chunks.choose_units(stored, segs).select("meeting_id", "unit_no",
                                                    F.md5("text").alias("text_md5"))


@query
def c7_halve_failed(spark, d):
    convs = fx.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_key"), (F.col("doc_id") % 5).cast("int")
        .alias("depth"), F.when(F.col("doc_id") % 2 == 0, X.sentences("text")).otherwise(
            F.array(X.norm("text"))).alias("units"))
    rows = chunks.halve_failed(convs, convs.filter(F.col("chunk_key").cast("bigint") % 3 != 0)
                               .select("chunk_key"))
    return rows.select("parent", "depth", "half", "gave_up", F.size("units").alias("units"),
                       "chunk_key")


# --- models ----------------------------------------------------------------------------------------------------

def _trained(spark, d):
    s = spread_sentences(spark, d)
    label = X.rule_label("sentence", F.when(F.lower("sentence").rlike(r"\b(api|docker|slides|share)\b"), "INFORMATION")
                         .otherwise("DISCUSSION"), F.lit(0.9))  # words tell the classes apart
    return models.train_classifier(s.select("sentence", label.alias("label")))


@query
def m1_train(spark, d):
    rows = spread(sentences(spark, d).select("sentence").distinct())
    return _trained(spark, d).transform(models._grams(rows)).select("sentence", "model_label")


@query
def m2_classify(spark, d):
    rows = spread_sentences(spark, d).select("meeting_id", "segment_id", "sentence_no", "sentence")
    return models.classify(_trained(spark, d), rows)


@query
def m2b_rule_cascade(spark, d):
    return _ruled(spark, d).select("meeting_id", "segment_id", "sentence_no", "model_label", "label")


@query
def m3_lda(spark, d):
    return models.lda_topics(sentences(spark, d), 5, 20)


@query
def m4_nmf(spark, d):
    rows = sentences(spark, d).select(F.concat_ws("/", "meeting_id", "segment_id", "sentence_no").alias("doc"),
                                      "sentence")
    return models.nmf_topics(rows, 5)


@query
def m5_text_vectors(spark, d):
    return vectors.hashed_vectors(fx.texts(spark, d).select("doc_id", "text")).select("doc_id", "embedding")


@query
def m6_canonical_topics(spark, d):
    segs = vectors.mean_vectors(topic_units(spark, d), ["meeting_id", "segment_index"])
    return segmentation.canonical_topics(segs)


def _meeting_topics(spark, d):
    found = extract.gazetteer_entities(fx.segments(spark, d)).groupBy("meeting_id", "entity").agg(
        F.min("segment_id").alias("topic_id"))
    return found.select("meeting_id", "topic_id", F.col("entity").alias("label"),
                        F.when(F.col("entity").contains(" "), F.lit("plan release date"))
                        .otherwise(F.lit("")).alias("keywords"))


@query
def m7_cross_meeting(spark, d):
    return vectors.topic_groups(vectors.cross_meeting_topics(_meeting_topics(spark, d)))


@query
def m7_occurrences(spark, d):
    return vectors.cross_meeting_topics(_meeting_topics(spark, d))


@query
def m8_topic_labels(spark, d):
    return weights.topic_labels(doc_sentences(spark, d), ["doc_id"], "sentence_no")


@query
def m9_vote_labels(spark, d):
    units = fixed_units(spark, d)
    gid = F.floor(F.col("segment_id") / 9).cast("bigint")
    topics = units.filter(F.col("segment_id") % 9 == 4).select(
        "meeting_id", gid.alias("gid"), F.col("segment_id").alias("seg_from"),
        (F.col("segment_id") + 5).alias("seg_to"))
    sides = vectors.mean_vectors(units, ["meeting_id", "segment_index"])
    named = topics.join(units.select("meeting_id", F.col("segment_id").alias("seg_from"),
                                     "embedding"), ["meeting_id", "seg_from"])
    nearest = segmentation.nearest_topics(sides, named)
    return segmentation.vote_labels(units, topics, nearest)


# --- records -----------------------------------------------------------------------------------------------------

@query
def r1_validate(spark, d):
    return validated(spark, d).select(
        *GROUP, "text", "seg_from", "seg_to", "evidence", "timestamp", "speaker", "owner",
        "deadline", "priority", "status", "reason")


@query
def r2_question_status(spark, d):
    segs = fx.segments(spark, d)
    rows = fx.candidates(segs).filter("category = 'questions'").drop("owner", "deadline")
    kind = F.col("seg_from") % 4
    asked = rows.withColumns({
        "status": F.when(kind == 3, "maybe").otherwise("RESOLVED"),
        "answer": F.when(kind == 1, F.lit(" ")).otherwise(F.lit("Next week.")),
        "answer_evidence": F.when(kind == 2, "Nobody said this").otherwise(F.col("evidence"))})
    return records.validate(asked, segs).select(
        *GROUP, "seg_from", "status", "answer", "answer_evidence", "unproven_answer")


@query
def r3_issues(spark, d):
    segs = fx.segments(spark, d)
    rows = fx.candidates(segs).withColumn("item_text", F.when(
        (F.col("meeting_id") % 2 == 0) & (F.col("category") == "decisions"), " ").otherwise(
        F.col("item_text"))).withColumn("seg_to", F.when(
            (F.col("meeting_id") % 3 == 0) & (F.col("seg_from") % 17 == 0),
            F.lit(99999999).cast("bigint")).otherwise(F.col("seg_to")))
    return records.issues(records.validate(rows, segs), ["run_id", "meeting_id"])


@query
def r4_deduplicate(spark, d):
    return records.deduplicate(records.number(crowded(spark, d), GROUP), GROUP).select(
        *GROUP, "pos", "text", "evidence", "owner", "deadline", "priority", "status", "merged")


@query
def r5_merge_chunks(spark, d):
    both = crowded(spark, d).withColumn("chunk_no", F.col("run_id"))
    return records.merge_chunks(both, ["meeting_id", "category"]).select(
        "meeting_id", "category", "pos", "text", "evidence", "owner", "deadline", "merged")


@query
def r5_extraction_audit(spark, d):
    rows = validated(spark, d).withColumn("chunk_no", F.col("run_id"))
    kept, by = rows.filter("reason is null"), ["meeting_id", "category"]
    chunks_of = records.funnel(rows, kept, ["chunk_no", *by])
    return records.merged_audit(chunks_of, records.merge_chunks(kept, by), by)


@query
def r6_stable_ids(spark, d):
    tied = accepted(spark, d).filter("run_id = 1").withColumn(
        "seg_to", F.col("seg_from") - F.col("seg_from") % 3).withColumn("seg_from", F.col("seg_to"))
    return records.assign_ids(tied).select("meeting_id", "category", "seg_from", "text", "id")


@query
def r7_manifest(spark, d):
    return records.manifest(fx.segments(spark, d), CONFIG)


@query
def r8_user_edits(spark, d):
    rows = fx.candidates(fx.segments(spark, d)).filter("run_id = 1")
    entries = lambda owner: F.map_filter(F.create_map(
        F.lit("owner"), owner, F.lit("task"), F.col("item_text"), F.lit("id"),
        F.col("seg_from").cast("string")), lambda k, v: v.isNotNull())
    seg = F.col("seg_from")
    none = F.lit(None).cast("map<string,string>")
    rows = rows.withColumns({
        "current": entries(F.coalesce("edited_owner", "owner")),
        "ai_fields": F.when(seg % 5 != 0, entries(F.coalesce("owner", F.lit("nobody")))).otherwise(none),
        "user_edits": F.when(seg % 3 == 0, F.create_map(F.lit("status"), F.lit("Done"))).otherwise(none),
        "confirmed": F.when(seg % 4 == 0, F.lit(True)), "user_edited": F.when(seg % 6 < 2, seg % 6 == 1)})
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("edits"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"]))), ";")
    return reconcile.user_edits(rows).select("meeting_id", "category", "seg_from", shown.alias("edits"))


@query
def r9_matches(spark, d):
    prev, new = runs(spark, d, records.number(crowded(spark, d), GROUP))
    return _sources(reconcile.match_records(prev, new), prev, new)


def _reconciled(spark, d, items: DataFrame | None = None):
    segs = materialize(fx.segments(spark, d))
    previous, candidate = runs(spark, d, items)
    seg = F.col("seg_from")
    previous = previous.withColumn("edits", F.map_filter(F.create_map(
        F.lit("owner"), F.col("edited_owner"), F.lit("deadline"), F.when((seg % 11 == 3) | (seg % 10 == 4), F.lit("Edited day")),
        F.lit("status"), F.when(seg % 13 == 5, F.lit("Done"))), lambda k, v: v.isNotNull()))
    current = records.manifest(segs, CONFIG)
    stored = current.withColumn("config_hash", F.when(F.col("meeting_id") % 4 == 0, "old").otherwise(
        F.col("config_hash")))
    return reconcile.reconcile(previous, candidate, segs, reconcile.same_pipeline(stored, current))


@query
def r10_reconcile(spark, d):
    rows = _reconciled(spark, d, records.number(crowded(spark, d), GROUP))
    return rows.select("meeting_id", "category", "id", "seg_from", "text", "owner", "deadline", "status",
                       "edited", "reconciliation")


@query
def r11_review_queue(spark, d):
    return reconcile.review_queue(_reconciled(spark, d)).select(
        "meeting_id", "category", "id", "owner", "deadline", "status", "reason")


@query
def r12_kept_answers(spark, d):
    old, new = _answered(spark, d)
    segs = fx.segments(spark, d)
    same = segs.select("meeting_id").distinct().withColumn("compatible", F.lit(True))
    return reconcile.reconcile(old, new, segs, same).select(
        "meeting_id", "id", "status", "answer", "reconciliation")


def _answered(spark, d):
    one, two = (r.filter("category = 'questions'") for r in runs(spark, d))
    quote = F.when(F.col("seg_from") % 4 == 1, "Nobody said this").otherwise(F.col("evidence"))
    old = one.withColumns({"status": F.lit("Resolved"), "answer": F.lit("Soon."), "answer_evidence": quote,
                           "edits": F.lit(None).cast("map<string,string>")})
    return old, two.withColumn("status", F.lit("Unresolved"))


@query
def r13_renamed_ids(spark, d):
    segs = fx.segments(spark, d)
    # Half of the new wordings are unrelated to the old ones, so their ids collide with kept ids.
    old, new = runs(spark, d)
    old = old.withColumn("edits", F.lit(None).cast("map<string,string>"))
    new = new.withColumn("text", F.when(
        F.col("seg_from") % 2 == 0, F.concat(F.lit("Unrelated topic "), F.col("seg_from").cast(
            "string"))).otherwise(F.col("text")))
    same = segs.select("meeting_id").distinct().withColumn("compatible", F.lit(True))
    return reconcile.reconcile(old, new, segs, same).filter(
        "reconciliation = 'new'").select("meeting_id", "category", "seg_from", "id")


@query
def r14_migrate(spark, d):
    segs = fx.segments(spark, d)
    old = fx.candidates(segs).filter("run_id = 1").withColumn("status", F.when(
        F.col("seg_from") % 4 == 0, "Done").otherwise("Pending"))
    checked = records.validate(old, segs).filter("reason is null")
    return reconcile.migrate(old, checked).select("meeting_id", "category", "seg_from", "status",
                                                  "edited_status")


@query
def r15_reconcile_audit(spark, d):
    return reconcile.reconcile_audit(_reconciled(spark, d))


@query
def r16_takeaway(spark, d):
    segs = fx.segments(spark, d)
    first = segs.filter("segment_id = 0").select(
        "meeting_id", F.concat(F.lit("Old: "), F.col("text")).alias("takeaway"),
        F.when(F.col("meeting_id") % 3 == 0, "Never said").otherwise(F.col("text")).alias("evidence"),
        F.col("segment_id").alias("seg_from"), F.col("segment_id").alias("seg_to"))
    new = segs.filter("segment_id = 1").select(
        "meeting_id", F.concat(F.lit("New: "), F.col("text")).alias("takeaway"),
        F.col("text").alias("evidence"))
    same = segs.select("meeting_id").distinct().withColumn("compatible", F.col("meeting_id") % 5 != 0)
    return reconcile.keep_takeaway(first, new, same, segs)


def _edited_tasks(spark, d):
    c = fx.candidates(fx.segments(spark, d)).filter("run_id = 1 and category = 'action_items'")
    items = c.select("meeting_id", F.col("seg_from").alias("item_index"), F.col("item_text")
                     .alias("task"), F.lit("t1").alias("analyzed_at"), "owner", "deadline")
    kind = F.col("item_index") % 4
    edits = items.select(
        "meeting_id", F.when(kind == 0, F.col("item_index") + 100000000).otherwise(
            F.col("item_index")).alias("item_index"),
        F.when(kind == 1, "Other").otherwise(F.col("task")).alias("task"),
        F.when(kind == 2, "t0").otherwise(F.lit("t1")).alias("analyzed_at"),
        F.lit(" Eve ").alias("owner"), F.lit(" ").alias("deadline"))
    return items, edits


@query
def r17_apply_edits(spark, d):
    return reconcile.apply_edits(*_edited_tasks(spark, d))


@query
def r17_edit_outcomes(spark, d):
    return reconcile.edit_outcomes(*_edited_tasks(spark, d))


@query
def r18_carry_edits(spark, d):
    one, two = (r.filter("category = 'action_items'") for r in runs(spark, d))
    old = one.withColumn(
        "manually_edited", F.col("seg_from") % 7 == 0).withColumn("owner", F.lit("User owner"))
    return reconcile.carry_edits(two, old).select("meeting_id", "seg_from", "owner", "deadline",
                                                  "manually_edited")


@query
def r19_notes(spark, d):
    items = reconcile.note_key(run_of(spark, d, 1))
    seg = F.col("seg_from")
    notes = items.filter(seg % 2 == 0).select("note_key", F.lit("first").alias("note"))
    changes = items.filter(seg % 3 == 0).select("note_key", F.when(seg % 6 == 0, "  ").otherwise(
        " second ").alias("note"))
    return reconcile.save_notes(notes, changes)


# --- streaming ------------------------------------------------------------------------------------------------------

def _stream(spark, d, name):
    schema = fx.table(spark, d, name).schema
    # A pattern may stand for a file or a folder of files; a plain path of a stream must be a folder.
    rows = spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


@query
def t1_stream_intake(spark, d):
    base = fresh_path(spark, "intake")
    rows = live.deduplicated_intake(_stream(spark, d, "events"), ["event_id"], "ts", "1 hour")
    return live.run_to_table(rows.select("event_id", "user_id", "event_type"), f"{base}/t",
                             f"{base}/c")


@query
def t2_daily_counts(spark, d):
    return live.daily_counts(fx.table(spark, d, "events"), "ts", ["event_type"])


@query
def t2_daily_counts_stream(spark, d):
    base = fresh_path(spark, "daily")
    return live.drained(_stream(spark, d, "events"), "ts", base,
                        lambda rows: live.daily_counts(rows, "ts", ["event_type"], "10 days"))[0]


@query
def t3_sessions(spark, d):
    return live.sessions(fx.table(spark, d, "events"), "ts", ["user_id"], "30 minutes")


@query
def t3_sessions_stream(spark, d):
    base = fresh_path(spark, "sessions")
    return live.drained(_stream(spark, d, "events"), "ts", base,
                        lambda rows: live.sessions(rows, "ts", ["user_id"], "30 minutes", "10 days"))[0]


@query
def t3_live_turns(spark, d):
    base = fresh_path(spark, "turns")
    return live.live_turns(_live_segments(spark, d), base).groupBy("meeting_id").agg(F.sum("turns").alias("turns"))


def _live_segments(spark, d) -> DataFrame:
    return _stream(spark, d, "conversations").select(
        F.col("conv_id").alias("meeting_id"), F.col("turn").alias("segment_id"), F.col("role").alias("speaker"))


@query
def t3_stateful_turns(spark, d):
    base = fresh_path(spark, "stateful")
    changes = live.run_to_table(live.stateful_turns(_live_segments(spark, d)), f"{base}/t", f"{base}/c")
    return changes.groupBy("meeting_id").agg(F.sum("turns").alias("turns"), F.sum("late").alias("late"))
