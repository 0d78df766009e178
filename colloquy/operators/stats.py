"""Counts, shares and quality measures (A1-A7, A11, A12, A15, A16, A18, W1, K1, K5, U*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.plans.ordered import BLOCK, walk, with_neighbours


def class_counts(classified: DataFrame, by: list[str]) -> DataFrame:
    """A1."""
    return classified.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))


def insight_counts(items: DataFrame) -> DataFrame:
    """A2. Counts per category and status with subtotals and the grand total per meeting."""
    return (items.withColumn("status", F.coalesce("status", F.lit("-")))
            .groupingSets([["meeting_id", "category", "status"], ["meeting_id", "category"],
                           ["meeting_id"]], "meeting_id", "category", "status")
            .agg(F.count(F.lit(1)).alias("n"))
            .select("meeting_id", F.coalesce("category", F.lit("(all)")).alias("category"),
                    F.coalesce("status", F.lit("(all)")).alias("status"), "n"))


def _seconds() -> Column:
    usable = (F.col("start_sec").isNotNull() & F.col("end_sec").isNotNull()
              & (F.col("end_sec") >= F.col("start_sec")))
    return F.when(usable, F.col("end_sec") - F.col("start_sec")).otherwise(F.lit(0.0))


def turn_starts(segments: DataFrame, block: int = BLOCK) -> DataFrame:
    """W1. Labelled segments flagged where a speaker's turn begins; unlabelled rows end a turn."""
    rows = with_neighbours(segments.select("meeting_id", "segment_id", "speaker", "start_sec",
                                           "end_sec"), ["meeting_id"], "segment_id", 1, 0,
                           {"_before": lambda w: F.lag("speaker").over(w)}, block)
    new = F.col("speaker").isNotNull() & ~F.col("speaker").eqNullSafe(F.col("_before"))
    return rows.withColumn("is_turn_start", new).drop("_before")


def speaker_stats(segments: DataFrame, block: int = BLOCK) -> DataFrame:
    """A3/W1. Seconds, turns and share of all time per speaker, coverage of labelled time."""
    rows = turn_starts(segments, block).withColumn("_sec", _seconds())
    total = rows.groupBy("meeting_id").agg(
        F.sum("_sec").alias("_total"),
        F.sum(F.when(F.col("speaker").isNotNull(), F.col("_sec")).otherwise(0.0)).alias("_covered"))
    return (rows.filter(F.col("speaker").isNotNull()).groupBy("meeting_id", "speaker")
            .agg(F.sum("_sec").alias("seconds"), F.count_if("is_turn_start").alias("turns"))
            .join(total, "meeting_id")
            .select("meeting_id", "speaker", "seconds", "turns",
                    F.round(F.try_divide(F.col("seconds"), F.col("_total")) * 100, 6)
                    .alias("percentage"),
                    F.round(F.try_divide(F.col("_covered"), F.col("_total")), 6)
                    .alias("coverage")))


def speaker_count(segments: DataFrame) -> DataFrame:
    """A4. Distinct labelled speakers, null when none is labelled."""
    return segments.groupBy("meeting_id").agg(F.nullif(
        F.count_distinct("speaker"), F.lit(0)).alias("speaker_count"))


def history_totals(meetings: DataFrame) -> DataFrame:
    """A5."""
    length = F.coalesce("duration_sec", F.lit(0.0))
    return meetings.agg(F.count(F.lit(1)).alias("meetings"), F.round(F.sum(length), 2).alias("total"),
                        F.round(F.avg(length), 6).alias("average"),
                        F.count_if(F.col("status") == "done").alias("done"),
                        F.count_if(F.col("status") != "done").alias("pending"))


def uploads_per_day(events: DataFrame, days: int = 14) -> DataFrame:
    """A6. Counts of the last days on which anything was uploaded."""
    daily = events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return daily.orderBy(F.desc("day")).limit(days)


def entities_by_label(entities: DataFrame) -> DataFrame:
    """A7. Distinct entity names per label, sorted and joined to one text."""
    names = entities.select("meeting_id", "label", "entity").distinct()
    return names.groupBy("meeting_id", "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_list("entity")), ", ").alias("names"))


def stability(items: DataFrame, base_run: int) -> DataFrame:
    """A15/U3. Jaccard overlap of each run's ids with the first run's, and the minimum.

    ``items``: run_id, category, id.
    """
    ids = items.select("run_id", "category", "id").distinct()
    base = ids.filter(F.col("run_id") == base_run).select("category", "id").withColumn(
        "_base", F.lit(1))
    size = base.groupBy("category").agg(F.count(F.lit(1)).alias("_n"))
    runs = (ids.join(base, ["category", "id"], "left").groupBy("run_id", "category")
            .agg(F.count("_base").alias("common"), F.count(F.lit(1)).alias("_m"))
            .join(size, "category", "left"))
    either = F.col("_m") + F.coalesce("_n", F.lit(0)) - F.col("common")
    return runs.select("run_id", "category", "common", either.alias("either"),
                       F.round(F.try_divide(F.col("common"), either), 6).alias("jaccard"))


def classification_report(scored: DataFrame) -> DataFrame:
    """A16. Precision, recall, F1 and support per class, with macro and weighted rows.

    ``scored``: label, predicted. Only the confusion counts are looked at after one aggregation.
    """
    confusion = scored.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    actual = confusion.groupBy("label").agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    guessed = confusion.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("given"))
    per = actual.join(guessed, "label", "left").select(
        "label", F.coalesce(F.try_divide("tp", "given"), F.lit(0.0)).alias("precision"),
        F.try_divide("tp", "support").alias("recall"), "support")
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                 F.col("precision") + F.col("recall")), F.lit(0.0))
    per = per.withColumn("f1", f1)
    measures = ("precision", "recall", "f1")
    macro = per.agg(*[F.avg(m).alias(m) for m in measures],
                    F.sum("support").alias("support")).withColumn("label", F.lit("macro"))
    weighted = per.agg(*[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m)
                         for m in measures], F.sum("support").alias("support")).withColumn(
        "label", F.lit("weighted"))
    return (per.unionByName(macro).unionByName(weighted)
            .select("label", *[F.round(m, 6).alias(m) for m in measures], "support"))


def window_diff(truth: DataFrame, k: int = 3, block: int = BLOCK) -> DataFrame:
    """A18. WindowDiff: share of windows of k steps whose boundary counts differ.

    ``truth``: meeting_id, segment_id, ref, hyp (segment labels by position).
    """
    flags = with_neighbours(truth, ["meeting_id"], "segment_id", 1, 0, {
        "_r": lambda w: (F.col("ref") != F.lag("ref").over(w)).cast("int"),
        "_h": lambda w: (F.col("hyp") != F.lag("hyp").over(w)).cast("int")}, block)
    ahead = {f"{c}{s}": (lambda w, c=c: F.sum(c).over(w.rowsBetween(1, k))) for c in ("_r", "_h")
             for s in ("s",)}
    ahead["_far"] = lambda w: F.lead("segment_id", k).over(w)
    sums = with_neighbours(flags, ["meeting_id"], "segment_id", 0, k, ahead, block)
    return sums.filter(F.col("_far").isNotNull()).groupBy("meeting_id").agg(
        F.round(F.avg((F.col("_rs") != F.col("_hs")).cast("double")), 6).alias("window_diff"))


def boundary_scores(reference: DataFrame, found: DataFrame, tolerance: int = 2,
                    block: int = BLOCK) -> DataFrame:
    """A17. Precision, recall and F1 of boundaries, each matched at most once within tolerance.

    Both: meeting_id, pos. Boundary 0 is always there and does not count; a side without boundaries
    scores 1. Boundaries are met in order of position, each taking the earliest open one of the
    other side that is near enough, which matches as many as can be matched.
    """
    def side(df: DataFrame, flag: str) -> DataFrame:
        return df.filter("pos > 0").select("meeting_id", "pos").distinct().withColumn(flag, F.lit(1))

    every = reference.select("meeting_id").union(found.select("meeting_id")).distinct()
    both = side(reference, "is_ref").join(side(found, "is_found"), ["meeting_id", "pos"], "full_outer").fillna(0)
    hits = walk(both, ["meeting_id"], "pos", _match_line(tolerance), "matched bigint", block)
    counts = both.groupBy("meeting_id").agg(F.sum("is_ref").alias("_ref"), F.sum("is_found").alias("_found"))
    total = hits.groupBy("meeting_id").agg(F.sum("matched").alias("_hits"))
    rows = every.join(counts, "meeting_id", "left").join(total, "meeting_id", "left").fillna(0)
    share = lambda of: F.when(F.col(of) > 0, F.col("_hits") / F.col(of)).otherwise(1.0)
    scored = rows.select("meeting_id", share("_found").alias("precision"), share("_ref").alias("recall"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                 F.col("precision") + F.col("recall")), F.lit(0.0))
    return scored.withColumn("f1", f1)


def _match_line(tolerance: int):
    import json

    import pandas as pd

    def step(pdf: pd.DataFrame, state: str | None):
        open_sides, matched = json.loads(state) if state else [[], []], 0
        for row in pdf.itertuples(index=False):
            near = [[p for p in side if p >= row.pos - tolerance] for side in open_sides]
            for own, other, here in ((0, 1, row.is_ref), (1, 0, row.is_found)):
                if here and near[other]:
                    near[other].pop(0)
                    matched += 1
                elif here:
                    near[own].append(int(row.pos))
            open_sides = near
        return pd.DataFrame({"matched": [matched]}), json.dumps(open_sides)

    return step


def full_texts(segments: DataFrame, block: int = 1024) -> DataFrame:
    """P8. The whole text of each meeting, put together from blocks of segments.

    A meeting's text is one value of the result; only the blocks' texts are gathered for it.
    """
    rows = segments.select("meeting_id", "segment_id", X.norm("text").alias("_t")).filter("_t <> ''")
    parts = rows.groupBy("meeting_id", F.floor(F.col("segment_id") / block).alias("_blk")).agg(
        F.array_sort(F.collect_list(F.struct("segment_id", "_t"))).alias("_rows"))
    texts = parts.select("meeting_id", "_blk", F.array_join(F.col("_rows._t"), " ").alias("_part"))
    return texts.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("_blk", "_part"))).alias("_p")).select(
        "meeting_id", F.array_join(F.col("_p._part"), " ").alias("full_text"))


def newest_first(meetings: DataFrame, sort: str = "uploaded_at") -> DataFrame:
    """K1."""
    if sort == "filename":
        return meetings.orderBy(F.asc("filename"), "id")
    return meetings.orderBy(F.desc_nulls_last(sort), "id")


def report_order(items: DataFrame) -> DataFrame:
    """K5."""
    return items.orderBy("meeting_id", "category", "seg_from", "seg_to", "id")


def open_questions(items: DataFrame) -> DataFrame:
    """U1. Unresolved questions together with follow-ups shown as questions."""
    asked = items.filter((F.col("category") == "questions") & (F.col("status") != "Resolved"))
    follow = items.filter(F.col("category") == "follow_ups")
    columns = ["meeting_id", "seg_from", F.col("text").alias("question"), "evidence"]
    return (asked.select(*columns, F.lit("question").alias("kind"))
            .unionByName(follow.select(*columns, F.lit("follow_up").alias("kind"))))


def merge_entities(chunks: DataFrame) -> DataFrame:
    """U2. Entity names over all chunks of a meeting, each once."""
    return chunks.select("meeting_id", "group_name", "name").distinct()


def merge_summaries(points: DataFrame) -> DataFrame:
    """U2. Summary points over all chunks in order, each wording once, with the evidence it came with."""
    return points.groupBy("meeting_id", "point").agg(
        F.min(F.struct("chunk_no", "point_no", "evidence")).alias("_at")).select(
        "meeting_id", "point", "_at.chunk_no", "_at.point_no", "_at.evidence")
