"""Reconciling a new analysis with the previous one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.functions import vocab as V
from colloquy.operators.evidence import locate_quotes, valid_evidence
from colloquy.operators.records import PIPELINE, _conflict, _prefix, record_id
from colloquy.plans.runtime import has_rows, materialize

GROUP = ["meeting_id", "category"]
SPAN = 16
FLAGS = ("confirmed", "user_edited")
FIXED = ["id", "segment_ids", "evidence_segment_ids"]


def user_edits(items: DataFrame) -> DataFrame:
    """R8. What people changed: explicit edits, fields that left the machine's value, flags.

    ``items`` has map columns current, ai_fields, user_edits and the nullable flags confirmed and user_edited.
    """
    flags = [F.col(c) if c in items.columns else F.lit(None).cast("boolean") for c in FLAGS]
    fixed = X.words_array(FIXED)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    ai = F.coalesce("ai_fields", empty)
    changed = F.map_filter("current", lambda k, v: F.map_contains_key(ai, k)
                           & ~v.eqNullSafe(F.try_element_at(ai, k))
                           & ~F.array_contains(fixed, k))
    everything = F.map_filter("current", lambda k, v: k != "id")
    own = F.when(F.size(F.map_keys(ai)) > 0, changed).when(
        F.greatest(*[F.coalesce(f, F.lit(False)) for f in flags]), everything).otherwise(empty)
    flag = F.map_filter(F.create_map(*[x for c, f in zip(FLAGS, flags, strict=True) for x in (F.lit(c), f.cast("string"))]),
                        lambda k, v: v.isNotNull())
    return items.withColumn("edits", _overlay(_overlay(F.coalesce("user_edits", empty), own), flag))


def _overlay(base: Column, top: Column) -> Column:
    """Entries of both maps; those of ``top`` win."""
    rest = F.map_filter(base, lambda k, v: ~F.map_contains_key(top, k))
    return F.map_concat(rest, top)


def _nested(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def match_pairs(previous: DataFrame, candidate: DataFrame) -> DataFrame:
    """R9/J14. Possible (old, new) matches; different known owners or deadlines never match.

    Both sides: meeting_id, category, pos, text, evidence, seg_from, seg_to, owner, deadline.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        ties = df.groupBy(*GROUP, "seg_from", "seg_to").agg(F.count(F.lit(1)).alias(f"{p}n"))
        rows = df.filter("seg_from is not null").join(ties, GROUP + ["seg_from", "seg_to"])
        return rows.select(*GROUP, "seg_from", "seg_to", f"{p}n",
                           *[F.col(c).alias(f"{p}{c}") for c in
                             ("pos", "text", "evidence", "owner", "deadline")],
                           X.terms("text").alias(f"{p}terms"))

    old, new = side(previous, "o_"), side(candidate, "n_")
    is_task = F.col("category").isin("action_items", "follow_ups")
    clash = is_task & (_conflict(F.col("o_owner"), F.col("n_owner"))
                       | _conflict(F.col("o_deadline"), F.col("n_deadline")))
    nested = _nested(X.norm("o_evidence"), X.norm("n_evidence"))
    overlap = X.jaccard(F.col("o_terms"), F.col("n_terms"))
    wordless = (F.size("o_terms") == 0) | (F.size("n_terms") == 0)
    picked = [*GROUP, "o_pos", "n_pos"]

    # One record on each side for the very same source: half of the wording is enough.
    single = (old.filter("o_n = 1").join(new.filter("n_n = 1"), GROUP + ["seg_from", "seg_to"])
              .filter(nested & ~clash & ~wordless & (overlap >= V.SAME_SOURCE_JACCARD))
              .select(*picked))

    # Otherwise the two must look like one event: shared rare term, overlapping sources.
    def keyed(df: DataFrame, p: str) -> DataFrame:
        return (df.withColumnRenamed("seg_from", f"{p}from").withColumnRenamed("seg_to", f"{p}to")
                .withColumn("_term", F.explode(_prefix(F.col(f"{p}terms"), V.SAME_EVENT_JACCARD)))
                .withColumn("_blk", F.explode(F.sequence(F.floor(F.col(f"{p}from") / SPAN),
                                                         F.floor(F.col(f"{p}to") / SPAN)))))

    same_source = ((F.col("o_from") == F.col("n_from")) & (F.col("o_to") == F.col("n_to"))
                   & (F.col("o_n") == 1) & (F.col("n_n") == 1))
    loose = (keyed(old, "o_").join(keyed(new, "n_"), GROUP + ["_term", "_blk"])
             .filter((F.col("o_from") <= F.col("n_to")) & (F.col("n_from") <= F.col("o_to")))
             .filter(~same_source & nested & ~clash & (overlap >= V.SAME_EVENT_JACCARD))
             .select(*picked).distinct())
    return single.unionByName(loose)


def first_free(pairs: DataFrame) -> DataFrame:
    """One-to-one from ``pairs`` (meeting_id, category, o_pos, n_pos), as if the old ones, in order, each took the
    first new one that is left.

    In rounds: every old record asks for its first option, every new one holds the first that asks and turns down
    all later ones, now and for good: who was turned down asks for the next. A new record only ever changes
    to an earlier old one, so what is turned down could never have been taken, and the rounds end
    where no two ask for the same. Pairs are dealt by record, never by cluster.
    """
    old, new = [*GROUP, "o_pos"], [*GROUP, "n_pos"]
    left = pairs
    while True:
        asked = left.groupBy(*old).agg(F.min("n_pos").alias("n_pos"))
        held = materialize(asked.groupBy(*new).agg(F.min("o_pos").alias("_holder"), F.count(F.lit(1)).alias("_n")))
        if not has_rows(held.filter("_n > 1")):
            return held.select(*GROUP, F.col("_holder").alias("o_pos"), "n_pos")
        left = materialize(left.join(held.select(*new, "_holder"), new, "left")
                           .filter(F.col("_holder").isNull() | (F.col("o_pos") <= F.col("_holder"))).drop("_holder"))


def match_records(previous: DataFrame, candidate: DataFrame) -> DataFrame:
    """R9. One-to-one: old records in order take the first new record not yet taken."""
    return first_free(materialize(match_pairs(previous, candidate)))


def same_pipeline(old: DataFrame, new: DataFrame) -> DataFrame:
    """(meeting_id, compatible): stored and current manifest agree; two gaps are equal."""
    o = old.select("meeting_id", *[F.col(c).alias(f"_o_{c}") for c in PIPELINE])
    equal = F.lit(True)
    for c in PIPELINE:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return new.join(o, "meeting_id").select("meeting_id", equal.alias("compatible"))


def reconcile(previous: DataFrame, candidate: DataFrame, segments: DataFrame,
              compatible: DataFrame) -> DataFrame:
    """R10-R13. Every record of either version with its fate and its lasting id.

    Stable: matched, keeps the old id. Retained: omitted by the new run but still supported and
    made the same way. Removed: the rest of the old (``review`` marks those people had edited).
    New: the rest of the new, with a new id when the old one is taken. Topics stay out.
    ``previous`` and ``candidate`` carry id, pos, status, answer, answer_evidence; ``previous`` also
    ``edits``, the map of fields that people set (R8), which win over either version's values.
    """
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    edits = F.coalesce("edits", empty)
    old = previous.filter(F.col("category") != "topics")
    new = candidate.filter(F.col("category") != "topics")
    grounded = valid_evidence(old, segments).select(*GROUP, "pos").withColumn("_ok", F.lit(True))
    usable = old.join(grounded, GROUP + ["pos"], "left_semi")
    matches = match_records(usable, new)
    fields = ["id", "text", "evidence", "seg_from", "seg_to", "owner", "deadline", "status",
              "answer", "answer_evidence"]
    # An answer stays only while the transcript still holds what it was taken from.
    quoted = old.filter("answer is not null").select("meeting_id", F.col("answer_evidence").alias("quote"))
    proven = locate_quotes(quoted, segments).select("meeting_id", F.col("quote").alias("_proof")).withColumn(
        "_proven", F.lit(True))
    old = old.withColumn("_proof", X.norm("answer_evidence")).join(proven, ["meeting_id", "_proof"], "left")
    o = old.join(grounded, GROUP + ["pos"], "left").join(compatible, "meeting_id", "left").select(
        *GROUP, F.col("pos").alias("o_pos"), "_ok", "compatible", edits.alias("edits"), "_proven",
        *[F.col(c).alias(f"o_{c}") for c in fields])
    n = new.select(*GROUP, F.col("pos").alias("n_pos"),
                   *[F.col(c).alias(f"n_{c}") for c in fields])
    both = (o.join(matches, GROUP + ["o_pos"], "left")
            .join(n, GROUP + ["n_pos"], "full_outer"))
    matched = F.col("o_pos").isNotNull() & F.col("n_pos").isNotNull()
    kept = F.coalesce("compatible", F.lit(False)) & F.coalesce("_ok", F.lit(False))
    fate = (F.when(matched, "stable").when(F.col("o_pos").isNull(), "new")
            .when(kept, "retained").otherwise("removed"))
    # A resolved question does not become open again.
    regressed = (matched & (F.col("category") == "questions") & (F.col("o_status") == "Resolved")
                 & (F.col("n_status") != "Resolved") & F.col("o_answer").isNotNull()
                 & F.coalesce("_proven", F.lit(False)))
    def own(field: str, value: Column) -> Column:
        return F.coalesce(F.try_element_at("edits", F.lit(field)), value).alias(field)

    rows = both.withColumn("reconciliation", fate).select(
        *GROUP, "reconciliation", F.coalesce("o_id", "n_id").alias("id"),
        *[F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in ("evidence", "seg_from", "seg_to")],
        own("text", F.coalesce("n_text", "o_text")),
        own("deadline", F.coalesce("n_deadline", "o_deadline")),
        own("owner", F.when(F.col("n_pos").isNotNull(), F.col("n_owner")).otherwise(F.col("o_owner"))),
        own("status", F.when(regressed, F.col("o_status")).otherwise(F.coalesce("n_status", "o_status"))),
        own("answer", F.when(regressed, F.col("o_answer")).otherwise(F.coalesce("n_answer", "o_answer"))),
        F.coalesce("edits", empty).alias("edits"),
        (F.size(F.map_keys(F.coalesce("edits", empty))) > 0).alias("edited"))
    taken = (rows.filter(F.col("reconciliation").isin("stable", "retained"))
             .select(*GROUP, "id").distinct().withColumn("_taken", F.lit(True)))
    settled = rows.join(taken, GROUP + ["id"], "left")
    renamed = (F.col("reconciliation") == "new") & F.coalesce("_taken", F.lit(False))
    return settled.withColumn("id", F.when(renamed, record_id(F.lower(X.norm("text"))))
                              .otherwise(F.col("id"))).drop("_taken")


def review_queue(reconciled: DataFrame) -> DataFrame:
    """R11. Edited records that no longer have support."""
    return (reconciled.filter((F.col("reconciliation") == "removed") & F.col("edited"))
            .withColumn("reason", F.lit("source_or_pipeline_changed")))


def reconcile_audit(reconciled: DataFrame) -> DataFrame:
    """R15. Counts of each fate per category."""
    fate = F.col("reconciliation")
    return reconciled.groupBy(*GROUP).agg(
        *[F.count_if(fate == name).alias(name) for name in ("stable", "retained", "new", "removed")],
        F.count_if(fate != "removed").alias("persisted"))


def migrate(old: DataFrame, validated: DataFrame) -> DataFrame:
    """R14. Unversioned records after validation, with a status people set kept as an edit."""
    before = (old.groupBy("meeting_id", "category", F.col("item_text").alias("text"))
              .agg(F.min_by("status", F.struct("seg_from", "seg_to")).alias("old_status")))
    default = F.col("old_status").isin("Pending", "Unresolved", "Not assessed", "Resolved")
    edited = F.when(F.col("old_status").isNotNull() & ~default, F.col("old_status"))
    return (validated.join(before, ["meeting_id", "category", "text"], "left")
            .withColumn("edited_status", edited)
            .withColumn("status", F.coalesce("edited_status", "status")).drop("old_status"))


def keep_takeaway(previous: DataFrame, current: DataFrame, compatible: DataFrame,
                  segments: DataFrame) -> DataFrame:
    """R16. The old takeaway stays while its evidence holds and nothing else changed."""
    valid = valid_evidence(previous, segments).select(
        "meeting_id", F.col("takeaway").alias("_old"), F.col("evidence").alias("_old_evidence"))
    rows = (current.join(compatible, "meeting_id", "left").join(valid, "meeting_id", "left"))
    keep = F.coalesce("compatible", F.lit(False)) & F.col("_old").isNotNull()
    return rows.select("meeting_id", F.when(keep, F.col("_old")).otherwise(F.col("takeaway"))
                       .alias("takeaway"),
                       F.when(keep, F.col("_old_evidence")).otherwise(F.col("evidence"))
                       .alias("evidence"), keep.alias("kept"))


def edit_outcomes(items: DataFrame, edits: DataFrame) -> DataFrame:
    """R17. What becomes of each edit: accepted, not_found, or conflict with a newer analysis.

    ``items`` and ``edits``: meeting_id, item_index, task, analyzed_at, owner, deadline; ``edits`` may have their order
    as edit_no.
    """
    order = [c for c in edits.columns if c == "edit_no"]
    found = items.select("meeting_id", "item_index", F.col("task").alias("_task"),
                         F.col("analyzed_at").alias("_at"))
    rows = edits.join(found, ["meeting_id", "item_index"], "left")
    outcome = (F.when(F.col("_task").isNull(), "not_found")
               .when((F.col("_task") != F.col("task")) | ~F.col("_at").eqNullSafe(F.col("analyzed_at")),
                     "conflict").otherwise("accepted"))
    return rows.select("meeting_id", "item_index", "task", X.blank_to_null(F.trim("owner"))
                       .alias("owner"), X.blank_to_null(F.trim("deadline")).alias("deadline"),
                       outcome.alias("outcome"), *order)


def apply_edits(items: DataFrame, edits: DataFrame) -> DataFrame:
    """R17. The items after the accepted edits; edited ones are marked for R18.

    Of several edits of an item the last counts: by edit_no, without one by owner and deadline.
    """
    accepted = edit_outcomes(items, edits).filter("outcome = 'accepted'")
    last = F.struct(*[c for c in ("edit_no",) if c in accepted.columns], "owner", "deadline")
    done = accepted.groupBy("meeting_id", "item_index").agg(F.max(last).alias("_e")).select(
        "meeting_id", "item_index", F.col("_e.owner").alias("_owner"), F.col("_e.deadline").alias("_deadline"),
        F.lit(True).alias("_done"))
    rows = items.join(done, ["meeting_id", "item_index"], "left")
    hit = F.coalesce("_done", F.lit(False))
    return (rows.withColumn("owner", F.when(hit, F.col("_owner")).otherwise(F.col("owner")))
            .withColumn("deadline", F.when(hit, F.col("_deadline")).otherwise(F.col("deadline")))
            .withColumn("manually_edited", hit).drop("_owner", "_deadline", "_done"))


def carry_edits(items: DataFrame, old: DataFrame) -> DataFrame:
    """R18. Manual owner/deadline move on where exactly one old edited row has task and quote."""
    edited = (old.filter("manually_edited").groupBy("meeting_id", "text", "evidence")
              .agg(F.count(F.lit(1)).alias("_n"), F.min("owner").alias("_owner"),
                   F.min("deadline").alias("_deadline")).filter("_n = 1").drop("_n")
              .withColumn("_hit", F.lit(True)))
    hit = F.coalesce("_hit", F.lit(False))
    return (items.join(edited, ["meeting_id", "text", "evidence"], "left")
            .withColumn("owner", F.when(hit, F.col("_owner")).otherwise(F.col("owner")))
            .withColumn("deadline", F.when(hit, F.col("_deadline")).otherwise(F.col("deadline")))
            .withColumn("manually_edited", hit).drop("_owner", "_deadline", "_hit"))


def note_key(items: DataFrame) -> DataFrame:
    """R19. Key of a personal note on a record."""
    return items.withColumn("note_key", X.digest(
        F.col("meeting_id"), F.coalesce("text", F.lit("")), F.coalesce("evidence", F.lit("")),
        F.col("seg_from"), F.col("seg_to")))


def save_notes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """R19. Notes after the changes; a blank note deletes."""
    fresh = changes.select("note_key", F.trim("note").alias("note"))
    return upsert(notes.select("note_key", "note"), fresh, ["note_key"]).filter("note <> ''")


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """S6. Stored rows replaced by fresh ones with the same key; fresh rows added."""
    return fresh.unionByName(stored.join(fresh.select(*keys), keys, "left_anti"),
                             allowMissingColumns=True)


def legacy_view(items: DataFrame) -> DataFrame:
    """U5. One row per record in the older names of its category."""
    task = F.col("category") == "action_items"
    decision, question = F.col("category") == "decisions", F.col("category") == "questions"
    return items.filter(F.col("category").isin("action_items", "decisions", "questions")).select(
        "meeting_id", "category", "seg_from", F.when(task, F.col("owner")).alias("person"),
        F.when(task, F.col("text")).alias("task"), F.when(decision, F.col("text")).alias("statement"),
        F.when(question, F.col("text")).alias("question"),
        F.when(question, F.col("status")).alias("resolution_status"),
        F.col("evidence").alias("original"))
