"""Rule-based extraction from sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.functions import vocab as V
from colloquy.operators.weights import ngrams
from colloquy.plans.ordered import top_k


def sentence_table(segments: DataFrame) -> DataFrame:
    """P3. One row per sentence with its place in the meeting."""
    return segments.select("meeting_id", "segment_id", "speaker",
                           F.posexplode(X.sentences("text")).alias("sentence_no", "sentence"))


def first_of_each(rows: DataFrame, keys: list[str], position: list[str]) -> DataFrame:
    """Earliest row per key; an aggregate, so copies shrink before they are shuffled."""
    others = [c for c in rows.columns if c not in keys and c not in position]
    first = F.min_by(F.struct(*position, *others), F.struct(*position)).alias("_f")
    return rows.groupBy(*keys).agg(first).select(*keys, "_f.*")


def actions(sentences: DataFrame) -> DataFrame:
    """X5. Commitments and requests with owner, deadline and status, one per wording."""
    rows = sentences.filter(X.is_action("sentence")).select(
        "meeting_id", F.lower(F.trim("sentence")).alias("_key"), "segment_id", "sentence_no",
        F.trim("sentence").alias("task"), X.owner_in(F.col("sentence")).alias("owner"),
        X.deadline_in(F.col("sentence")).alias("deadline"),
        X.status_in(F.col("sentence")).alias("status"))
    return first_of_each(rows, ["meeting_id", "_key"], ["segment_id", "sentence_no"]).drop("_key")


def decisions(sentences: DataFrame) -> DataFrame:
    """X6."""
    rows = sentences.filter(X.is_decision("sentence")).select(
        "meeting_id", F.lower(F.trim("sentence")).alias("_key"), "segment_id", "sentence_no",
        F.trim("sentence").alias("statement"))
    return first_of_each(rows, ["meeting_id", "_key"], ["segment_id", "sentence_no"]).drop("_key")


def questions(sentences: DataFrame) -> DataFrame:
    """X7."""
    rows = sentences.filter(X.is_meaningful_question("sentence")).select(
        "meeting_id", F.lower(F.trim("sentence")).alias("_key"), "segment_id", "sentence_no",
        F.trim("sentence").alias("question"), X.is_open_issue("sentence").alias("is_action_required"),
        F.when(X.is_open_issue("sentence"), "Marked open in this excerpt")
        .otherwise("Not assessed").alias("resolution_status"))
    return first_of_each(rows, ["meeting_id", "_key"], ["segment_id", "sentence_no"]).drop("_key")


def gazetteer_entities(segments: DataFrame) -> DataFrame:
    """X9. Known technologies by name and numbered projects, wherever they occur.

    Sequences of words are looked up inside the row; only hits leave it.
    """
    rows = segments.select("meeting_id", "segment_id", F.regexp_extract_all(
        "text", F.lit(V.WORD), 0).alias("_t")).filter(F.size("_t") > 0)

    project = "^(" + "|".join(V.PROJECT_WORDS) + r") [0-9]+$"

    def label(gram: Column, n: int) -> Column:
        if n == 1:
            return F.when(gram.isin(V.TECH_WORDS), "TECHNOLOGY")
        known = F.when(F.lower(gram).isin(V.TECH_PHRASES), "TECHNOLOGY")
        return known.when(F.lower(gram).rlike(project), "PROJECT") if n == 2 else known

    def hits(n: int) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size("_t") - n, F.lit(0)))
        grams = F.transform(places, lambda i: F.struct((i + 1).alias("i"), F.concat_ws(
            " ", *[F.get("_t", i + k) for k in range(n)]).alias("g")))
        named = F.transform(grams, lambda p: F.struct(p["i"].alias("i"), p["g"].alias("g"), label(p["g"], n).alias("l")))
        return F.when(F.size("_t") >= n, F.filter(named, lambda p: p["l"].isNotNull()))

    none = F.array().cast("array<struct<i:int,g:string,l:string>>")
    found = F.concat(*[F.coalesce(hits(n), none) for n in (1, 2, 3)])
    return rows.select("meeting_id", "segment_id", F.explode(found).alias("_p")).select(
        "meeting_id", "segment_id", F.col("_p.i").alias("word_no"), F.col("_p.g").alias("entity"),
        F.col("_p.l").alias("label"))


def label_entities(spans: DataFrame) -> DataFrame:
    """X10. Raw (meeting_id, segment_id, word_no, entity, raw_label, context) to shown labels.

    A description such as "Acme, a small company" makes an organisation of a name.
    """
    mapped = F.coalesce(X.lookup(V.ENTITY_LABELS, F.col("raw_label")), F.col("raw_label"))
    pattern = F.concat(F.lit(r"(?i)\Q"), F.col("entity"), F.lit(r"\E" + V.APPOSITIVE))
    described = F.regexp_like("context", pattern)
    label = F.when((mapped == "PERSON") & described, "ORG").otherwise(mapped)
    rows = spans.select("meeting_id", F.lower(F.trim("entity")).alias("entity_key"),
                        label.alias("label"), "segment_id", "word_no",
                        F.trim("entity").alias("entity"))
    rows = rows.filter(F.col("label").isin(sorted(set(V.ENTITY_LABELS.values()))))
    return first_of_each(rows, ["meeting_id", "entity_key", "label"], ["segment_id", "word_no"])


def is_valid_entity(entity: Column, label: Column) -> Column:
    """X11. Lexical evidence an entity must show beyond its predicted label."""
    tokens = F.regexp_extract_all(entity, F.lit(V.WORD), 0)
    vacuous = F.forall(tokens, lambda t: F.lower(t).isin(V.TOPIC_STOP))
    name_like = F.exists(tokens, lambda t: t.rlike(r"^\p{Lu}|[^\x00-\x7F]"))
    all_names = F.forall(tokens, lambda t: t.rlike(r"^\p{Lu}|[^\x00-\x7F]|^s$"))
    odd = F.exists(tokens, lambda t: F.lower(t).isin(V.NEVER_NAMES))
    named = (F.when(label.isin("PERSON", "ORG", "LOCATION"), ~odd & name_like)
             .otherwise(F.lit(True)))
    person = F.when(label == "PERSON", all_names).otherwise(F.lit(True))
    dated = F.when(label.isin("DATE", "TIME"), entity.rlike(V.DATE_WORDS)).otherwise(F.lit(True))
    return ((F.size(tokens) > 0) & (F.length(F.trim(entity)) >= 2) & ~vacuous & named & person
            & dated)


def validate_entities(names: DataFrame, segments: DataFrame) -> DataFrame:
    """X12. Candidate names (meeting_id, group_name, name) that the transcript really holds.

    Whole-word presence is decided on the transcript's word sequences: a name of n words joins
    the n-word sequences of its own meeting, case-folded.
    """
    wanted = names.select("meeting_id", "group_name", X.norm("name").alias("name")).filter(
        "name <> ''").withColumn("name_key", F.lower("name"))
    words = wanted.withColumn("_gram", F.array_join(
        F.regexp_extract_all("name_key", F.lit(V.WORD), 0), " "))
    grams = (segments.select("meeting_id", X.words("text").alias("_t"))
             .select("meeting_id", F.explode(ngrams(F.col("_t"), (1, 2, 3, 4))).alias("_gram"))
             .distinct())
    speakers = (segments.filter(F.col("speaker").isNotNull())
                .select("meeting_id", F.lower(X.norm("speaker")).alias("name_key"),
                        X.norm("speaker").alias("_exact")).distinct())
    spoken = (words.join(grams, ["meeting_id", "_gram"], "left_semi")
              .unionByName(words.join(speakers.select("meeting_id", "name_key"),
                                      ["meeting_id", "name_key"], "left_semi")).distinct())
    introduced = (segments.select("meeting_id", F.explode(F.regexp_extract_all(
        F.lower(X.norm("text")),
        F.lit(r"(?:my name is|named|called) ([\p{L}\p{N}_]+)"), 1)).alias("name_key"))
        .distinct().withColumn("_introduced", F.lit(True)))
    exact = speakers.select("meeting_id", F.col("_exact").alias("name")).withColumn(
        "_speaks", F.lit(True))
    rows = (spoken.join(introduced, ["meeting_id", "name_key"], "left")
            .join(exact, ["meeting_id", "name"], "left"))
    established = F.coalesce("_introduced", F.lit(False)) | F.coalesce("_speaks", F.lit(False))
    common = (F.col("group_name") == "people") & F.col("name_key").isin(V.COMMON_PEOPLE)
    generic = (F.col("group_name") == "products") & F.col("name_key").isin(V.GENERIC_PRODUCTS)
    kept = rows.filter(~((common | generic) & ~established))
    return kept.groupBy("meeting_id", "group_name", "name_key").agg(F.min("name").alias("name"))


def summary_points(points: DataFrame, grounded: DataFrame) -> DataFrame:
    """F11. The first six points per meeting that are short, well formed, supported and new.

    ``points``: meeting_id, point_no, point, quote. ``grounded``: meeting_id, quote (located).
    """
    first = top_k(points, ["meeting_id"], [F.col("point_no")], 6, ["point_no"]).drop("rank")
    text = X.norm("point")
    ok = first.withColumn("point", text).withColumn("quote", X.norm("quote")).filter(
        (F.col("point") != "") & (X.word_count("point") <= 32)
        & ~F.col("point").rlike(V.MALFORMED_POINT))
    held = ok.join(grounded.select("meeting_id", "quote").distinct(), ["meeting_id", "quote"],
                   "left_semi")
    return first_of_each(held.select("meeting_id", "point", "point_no", "quote"),
                         ["meeting_id", "point"], ["point_no"])


def search_segments(segments: DataFrame, labels: DataFrame, query: str, label: str | None
                    ) -> DataFrame:
    """F8. Segments holding the text, optionally only those with a label."""
    hits = segments.filter(F.lower("text").contains(query.strip().lower()))
    if label is None:
        return hits
    tagged = labels.filter(F.col("label") == label).select("meeting_id", "segment_id").distinct()
    return hits.join(tagged, ["meeting_id", "segment_id"], "left_semi")


def segment_labels(items: DataFrame) -> DataFrame:
    """J6. (meeting_id, segment_id, label) for every segment an item cites."""
    label = (F.when(F.col("category") == "action_items", "Actions")
             .when(F.col("category") == "decisions", "Decisions")
             .when(F.col("category") == "questions", "Questions"))
    return (items.filter(F.col("seg_from").isNotNull()).withColumn("label", label)
            .filter(F.col("label").isNotNull())
            .select("meeting_id", F.explode(F.sequence("seg_from", "seg_to")).alias("segment_id"),
                    "label").distinct())


def check_uploads(uploads: DataFrame) -> DataFrame:
    """F10. Accept (200), unsupported type (415) or too large (413) for each upload."""
    ext = F.lower(F.regexp_extract("filename", r"(\.[^./\\]+)$", 1))
    mime = F.trim(F.split_part(F.lower(F.coalesce("content_type", F.lit(""))), F.lit(";"), F.lit(1)))
    known, by_type = ext.isin(V.MEDIA_EXTENSIONS), X.lookup(V.MEDIA_TYPES, mime)
    code = (F.when(~known & by_type.isNull(), 415)
            .when(F.col("size_bytes") > V.MAX_UPLOAD_BYTES, 413).otherwise(200))
    chosen = F.when(known, ext).when(by_type != "", by_type).otherwise(ext)
    return uploads.withColumn("extension", F.when(code != 415, chosen)).withColumn("code", code)
