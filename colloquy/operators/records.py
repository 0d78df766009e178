"""Validated records: R1-R3 validation, R4/R5 same-event merging, R6 identity, R7 manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.functions import vocab as V
from colloquy.operators.evidence import ground, locate_quotes
from colloquy.operators.substrings import rows_containing
from colloquy.plans.ordered import BLOCK, block_of, ranged
from colloquy.plans.runtime import has_rows, materialize

DETAILS = ("owner", "deadline", "priority")
OPTIONAL = ("owner", "deadline", "priority", "status", "answer", "owner_evidence",
            "deadline_evidence", "priority_evidence", "answer_evidence")


def _with_optional(items: DataFrame) -> DataFrame:
    for name in OPTIONAL:
        if name not in items.columns:
            items = items.withColumn(name, F.lit(None).cast("string"))
    return items


def validate(items: DataFrame, segments: DataFrame, block: int = BLOCK) -> DataFrame:
    """R1/R2. Ground each candidate and its fields; ``reason`` says why a row is rejected.

    ``items``: meeting_id, category, item_text, evidence, optionally seg_from/seg_to and the
    detail columns. Owner and deadline survive only when their evidence names them; priority
    needs evidence of its own; what is missing is inferred from the evidence text or left null.
    """
    extra_columns = [f"{d}_evidence" for d in (*DETAILS, "answer")]
    has_extras = [c for c in extra_columns if c in items.columns]
    rows = ground(_with_optional(items), segments, "evidence", block)
    if has_extras:
        quotes = items.select("meeting_id", F.explode(F.array_compact(F.array(
            *[F.col(c) for c in has_extras]))).alias("quote"))
        known = locate_quotes(quotes, segments, block).select("meeting_id", "quote")
    for column in extra_columns:
        found = f"_{column}"
        if column in has_extras:
            rows = (rows.withColumn("_q", X.norm(column))
                    .join(known.withColumnRenamed("quote", "_q").withColumn("_hit", F.lit(1)),
                          ["meeting_id", "_q"], "left")
                    .withColumn(found, F.when(F.col("_hit") == 1, F.col("_q"))).drop("_q", "_hit"))
        else:
            rows = rows.withColumn(found, F.lit(None).cast("string"))
    speaker, is_task = F.col("src_speaker"), F.col("category").isin("action_items", "follow_ups")
    fields: dict[str, Column] = {}
    for detail in DETAILS:
        extra = F.col(f"_{detail}_evidence")
        support = F.concat_ws(" ", "src_evidence", extra)
        given = X.norm(detail)
        given = F.when(F.lower(given).isin(V.NULL_WORDS), F.lit("")).otherwise(given)
        if detail == "owner":
            holds = X.contains_word(support, given) | ((given != "") & (given == F.coalesce(
                speaker, F.lit(""))))
            inferred = X.owner_in(support, speaker)
        elif detail == "deadline":
            holds, inferred = X.contains_word(support, given), X.deadline_in(support)
        else:
            holds = given.isin("high", "medium", "low") & extra.isNotNull()
            inferred = X.priority_in(support)
            fields["_support"] = support
        fields[f"_{detail}"] = F.when(is_task, F.when(holds, given).otherwise(inferred))
    rows = rows.withColumns(fields)
    asked = F.initcap(X.norm("status"))
    asked = F.when(asked.isin("Resolved", "Unresolved"), asked).otherwise("Not assessed")
    answered = (X.norm("answer") != "") & F.col("_answer_evidence").isNotNull()
    question_status = F.when((asked == "Resolved") & ~answered, "Not assessed").otherwise(asked)
    status = (F.when(is_task, X.status_of(F.col("status"), F.col("_support")))
              .when(F.col("category") == "questions", question_status))
    keeps_answer = (F.col("category") == "questions") & (asked == "Resolved") & answered
    reason = (F.when(X.norm("item_text") == "", "missing_text")
              .when(F.col("src_evidence").isNull(), "unmatched_evidence")
              .when((F.col("category") == "topics") & ~X.is_topic_label("item_text"),
                    "generic_label")
              .when(F.col("_priority").isNotNull() & ~F.col("_priority").isin(
                  "high", "medium", "low"), "schema_validation"))
    keys = [c for c in items.columns if c not in
            (*OPTIONAL, "meeting_id", "category", "item_text", "evidence", "seg_from", "seg_to")]
    return rows.select(
        *keys, "meeting_id", "category", X.norm("item_text").alias("text"),
        F.col("src_from").alias("seg_from"), F.col("src_to").alias("seg_to"),
        F.col("src_evidence").alias("evidence"), F.col("src_time").alias("timestamp"),
        F.col("src_speaker").alias("speaker"), F.col("_owner").alias("owner"),
        F.col("_deadline").alias("deadline"), F.col("_priority").alias("priority"),
        status.alias("status"),
        F.when(keeps_answer, X.norm("answer")).alias("answer"),
        F.when(keeps_answer, F.col("_answer_evidence")).alias("answer_evidence"),
        ((F.col("category") == "questions") & (asked == "Resolved") & ~answered)
        .alias("unproven_answer"), reason.alias("reason"))


def issues(validated: DataFrame, by: list[str]) -> DataFrame:
    """R3. Sorted issue names and the state of each analysis."""
    named = F.array_compact(F.array(
        F.when(F.col("reason").isNotNull(), F.col("category")),
        F.when(F.col("unproven_answer"), F.lit("questions.answer"))))
    rows = validated.select(*by, F.explode_outer(named).alias("issue"),
                            F.col("reason").isNull().alias("_ok"))
    # At most one name per category: the set is small by construction.
    grouped = rows.groupBy(*by).agg(F.array_sort(F.collect_set("issue")).alias("_issues"),
                                    F.max("_ok").alias("_any"))
    return grouped.select(
        *by, F.array_join("_issues", ",").alias("issues"),
        F.when(F.size("_issues") > 0, "partial").when(F.col("_any"), "complete")
        .otherwise("empty").alias("state"))


def number(items: DataFrame, group: list[str], order: tuple[str, ...] = ("seg_from", "seg_to", "text", "evidence")
           ) -> DataFrame:
    """``items`` with ``pos``: their dense place in the group, unique also where sources tie or are unknown.

    Records without segment ids come last. The rows are sorted by range, so a group of any size and any tie lies over
    many tasks; a place is that within the range and the rows of the group in the ranges before.
    """
    placed = ranged(items, [*group, *[F.asc_nulls_last(c) for c in order]])
    sizes = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (placed.join(bases, [*group, "_part"])
            .withColumn("pos", (F.col("_base") + F.col("_at") - F.col("_first")).cast("bigint"))
            .drop("_at", "_part", "_base", "_first"))


def _prefix(terms: Column, threshold: float) -> Column:
    """Terms of which two sets with the given Jaccard must share one (longest words first)."""
    ordered = F.array_sort(F.transform(terms, lambda w: F.struct((-F.length(w)).alias("l"),
                                                                 w.alias("w"))))
    keep = F.size(terms) - F.ceil(F.size(terms) * F.lit(threshold) - 1e-9).cast("int") + 1
    picked = F.transform(F.slice(ordered, F.lit(1), F.greatest(keep, F.lit(1))), lambda s: s["w"])
    return F.when(F.size(terms) == 0, F.array(F.lit(""))).otherwise(picked)


def _conflict(a: Column, b: Column) -> Column:
    return F.coalesce(a != b, F.lit(False))


def shared_keys(items: DataFrame, group: list[str]) -> DataFrame:
    """(node, key) for records that could describe one event with another: same key, maybe same event.

    Keys hold both a shared (container) evidence text and a shared rare term, so neither a
    common quote nor a common wording alone brings a large group together.
    """
    quotes = items.select(*group, F.col("evidence").alias("needle")).distinct()
    holders = quotes.withColumnRenamed("needle", "text").withColumn("row_id", F.col("text"))
    inside = rows_containing(quotes, holders, group).select(
        *group, F.col("needle").alias("evidence"), F.col("row_id").alias("_box"))
    keyed = (items.join(inside, group + ["evidence"])
             .withColumn("_term", F.explode(_prefix(F.col("_terms"), V.SAME_EVENT_JACCARD)))
             .select("node", F.xxhash64(*group, "_box", "_term").alias("key")))
    keyed = materialize(keyed)
    several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key")
    return materialize(keyed.join(several, "key"))


def similar_to(leaders: DataFrame, keyed: DataFrame, nodes: DataFrame, group: list[str]) -> DataFrame:
    """(leader, node, ...) for each later record of the group that is worded like one of ``leaders``."""
    ours = keyed.join(leaders, "node").select(F.col("node").alias("leader"), "key")
    met = ours.join(keyed, "key").filter(F.col("node") > F.col("leader")).select("leader", "node").distinct()
    first = nodes.select(F.col("node").alias("leader"), F.col("_terms").alias("_lt"),
                         *[F.col(g).alias(f"_l_{g}") for g in group])
    same = F.lit(True)
    for g in group:  # keys are hashes
        same = same & F.col(g).eqNullSafe(F.col(f"_l_{g}"))
    small, large = F.least(F.size("_lt"), F.size("_terms")), F.greatest(F.size("_lt"), F.size("_terms"))
    return (met.join(first, "leader").join(nodes, "node")
            .filter(same & (small >= large * V.SAME_EVENT_JACCARD - 1e-9))
            .filter(X.jaccard(F.col("_lt"), F.col("_terms")) >= V.SAME_EVENT_JACCARD)
            .select("leader", "node", "is_task", "evidence", "owner", "deadline"))


def leader_states(members: DataFrame) -> DataFrame:
    """What each leader holds after which record: first known owner and deadline, and each longest quote so far.

    ``members``: leader, node (the leader itself too), evidence, owner, deadline.
    """
    known = members.groupBy("leader").agg(
        *[F.min_by(F.struct("node", c), F.when(F.col(c).isNotNull(), F.col("node"))).alias(f"_{c}")
          for c in ("owner", "deadline")])
    # Distinct quotes only; a quote is adopted where it is longer than all before it.
    quotes = members.groupBy("leader", "evidence").agg(F.min("node").alias("node"))
    earlier = Window.partitionBy("leader").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    adopted = (quotes.withColumn("_longest", F.max(F.length("evidence")).over(earlier))
               .filter(F.col("_longest").isNull() | (F.length("evidence") > F.col("_longest"))))
    history = adopted.groupBy("leader").agg(F.array_sort(F.collect_list(F.struct("node", "evidence"))).alias("_quotes"))
    return known.join(history, "leader")


def first_leaders(pairs: DataFrame, states: DataFrame) -> DataFrame:
    """(node, leader): the first of its leaders whose state before the record lets it in."""
    quote = F.element_at(F.filter("_quotes", lambda q: q["node"] < F.col("node")), -1)["evidence"]
    clash = F.lit(False)
    for c in ("owner", "deadline"):
        held = F.when(F.col(f"_{c}")["node"] < F.col("node"), F.col(f"_{c}")[c])
        clash = clash | _conflict(held, F.col(c))
    nested = quote.contains(F.col("evidence")) | F.col("evidence").contains(quote)
    return (pairs.join(states, "leader").filter(nested & ~(F.col("is_task") & clash))
            .groupBy("node").agg(F.min("leader").alias("leader")))


FIRST_LEADERS = 8  # of the records that share a key; more of them make fewer rounds and more comparisons


def ordered_merge(nodes: DataFrame, group: list[str]) -> DataFrame:
    """(node, leader) of the records that merge into an earlier one, as a walk in order of ``node`` would have it.

    A record joins the first leader before it that is worded alike, has a nested quote and no other owner or deadline, all
    as the leader is when its turn comes: gaps filled and the longest quote adopted from the records that joined
    before. A record that joins none is a leader.

    In rounds: what leaders hold at each place follows from who joined them in the round before; with that all records
    choose anew, until nothing changes. That is the walk's outcome: the first record's choice is right
    from the beginning, and each further one once those before it are. Records not yet a leader or a member
    become leaders some at a time, the first of those that share a key (four times as many each round); so a record is only
    compared with leaders, never with all records that are like it.
    """
    keyed = shared_keys(nodes, group)
    open_nodes = keyed.select("node").distinct()
    if not has_rows(open_nodes):
        return nodes.select("node", F.col("node").alias("leader")).limit(0)
    known = materialize(nodes.join(open_nodes, "node"))
    chosen = known.select("node", F.lit(None).cast("bigint").alias("leader")).limit(0)
    led: DataFrame | None = None
    pairs: DataFrame | None = None
    pending, width = open_nodes, FIRST_LEADERS
    while True:
        grown = has_rows(pending)
        if grown:
            queue = Window.partitionBy("key").orderBy("node")
            fresh = materialize(keyed.join(pending, "node").withColumn("_place", F.row_number().over(queue))
                                .filter(F.col("_place") <= width).select("node").distinct())
            found = similar_to(fresh, keyed, known, group)
            led = fresh if led is None else materialize(led.unionByName(fresh))
            pairs = materialize(found if pairs is None else pairs.unionByName(found))
            width *= 4
        leaders = led.join(chosen, "node", "left_anti")
        member = leaders.select(F.col("node").alias("leader"), "node").unionByName(chosen.select("leader", "node"))
        states = leader_states(member.join(known.select("node", "evidence", "owner", "deadline"), "node"))
        standing = pairs.join(leaders.select(F.col("node").alias("leader")), "leader")
        new = materialize(first_leaders(standing, states))
        moved = new.join(chosen, ["node", "leader"], "left_anti")
        left = chosen.join(new, ["node", "leader"], "left_anti")
        settled = not grown and not has_rows(moved) and not has_rows(left)
        chosen = new
        if settled:
            return chosen
        pending = materialize(open_nodes.join(chosen, "node", "left_anti").join(led, "node", "left_anti"))


def assign_keepers(items: DataFrame, group: list[str]) -> DataFrame:
    """R4, first half: the record each record merges into (itself when it survives).

    Copies (same wording, quote, owner, deadline) are one record from the start.
    """
    same = ["text", "evidence", "owner", "deadline"]
    safe = [F.coalesce(F.col(c), F.lit("")).alias(f"_k_{c}") for c in same]
    copies = materialize(items.select(*group, "pos", F.col("category").alias("_of"), *safe)
                         .groupBy(*group, *[f"_k_{c}" for c in same])
                         .agg(F.min("pos").alias("first_pos"), F.min_by("_of", "pos").alias("_of")))
    nodes = copies.select(
        *group, F.col("first_pos").alias("pos"), X.terms("_k_text").alias("_terms"),
        F.col("_of").isin("action_items", "follow_ups").alias("is_task"), F.col("_k_evidence").alias("evidence"),
        *[F.nullif(F.col(f"_k_{c}"), F.lit("")).alias(c) for c in ("owner", "deadline")])
    # Numbers in order of places within each group.
    nodes = materialize(nodes.repartitionByRange(*group, "pos").sortWithinPartitions(*group, "pos")
                        .withColumn("node", F.monotonically_increasing_id()))
    folded = (ordered_merge(nodes, group)
              .join(nodes.select("node", *group, F.col("pos").alias("first_pos")), "node")
              .join(nodes.select(F.col("node").alias("leader"), F.col("pos").alias("keeper")), "leader")
              .select(*group, "first_pos", "keeper"))
    member = items.select(*group, "pos", *safe).join(
        copies, group + [f"_k_{c}" for c in same]).select(*group, "pos", "first_pos")
    return (member.join(folded, group + ["first_pos"], "left")
            .select(*group, "pos", F.coalesce("keeper", "first_pos").alias("keeper")))


def deduplicate(items: DataFrame, group: list[str]) -> DataFrame:
    """R4. One row per event: first record kept, gaps filled in order, longest quote adopted,
    a later resolved answer adopted."""
    keepers = assign_keepers(items, group)
    rows = items.join(keepers, group + ["pos"])
    order = F.col("pos")
    size = F.struct((-F.length("evidence")).alias("l"), order.alias("p"))
    solved = F.when((F.col("category") == "questions") & (F.col("status") == "Resolved"), order)

    def filled(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), order)).alias(name)

    merged = rows.groupBy(*group, F.col("keeper").alias("pos")).agg(
        F.min_by("text", order).alias("text"),
        *[F.min_by(c, size).alias(c)
          for c in ("evidence", "seg_from", "seg_to", "timestamp", "speaker")],
        *[filled(c) for c in ("owner", "deadline", "priority")],
        F.coalesce(F.max_by("status", solved), F.min_by("status", order)).alias("status"),
        F.coalesce(F.max_by("answer", solved), F.min_by("answer", order)).alias("answer"),
        F.count(F.lit(1)).alias("merged"))
    return merged


def merge_chunks(items: DataFrame, group: list[str]) -> DataFrame:
    """R5. Records of several chunks as one report: ordered by source and wording, then R4."""
    return deduplicate(number(items, group, ("seg_from", "seg_to", "text", "chunk_no", "evidence")), group)


STAGES = ("generated", "parsed", "evidence_matched", "validated")


def merged_audit(chunks: DataFrame, merged: DataFrame, by: list[str]) -> DataFrame:
    """R5. The extraction audit of a merged report: the stages of all its chunks summed, and what is left after merging."""
    sums = chunks.groupBy(*by).agg(*[F.sum(c).alias(c) for c in STAGES])
    kept = merged.groupBy(*by).agg(F.count(F.lit(1)).alias("deduplicated"))
    return sums.join(kept, by, "left").fillna(0, ["deduplicated"])


def assign_ids(items: DataFrame) -> DataFrame:
    """R6. Stable ids from (meeting, category, source ids); wording only where sources tie."""
    keys = ["meeting_id", "category", "seg_from", "seg_to"]
    # One row per source range, pre-aggregated; the join splits a hot range at run time.
    ties = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    same = [items[k].eqNullSafe(ties[k]) for k in keys]
    joined = items.join(ties, same[0] & same[1] & same[2] & same[3]).drop(*[ties[k] for k in keys])
    suffix = F.when(F.col("_n") > 1, F.lower(X.norm("text")))
    return joined.withColumn("id", record_id(suffix)).drop("_n")


def record_id(suffix: Column) -> Column:
    return F.substring(X.digest(F.col("meeting_id"), F.col("category"), F.col("seg_from"),
                                F.col("seg_to"), suffix), 1, 24)


def transcript_digest(segments: DataFrame, block: int = 16384) -> DataFrame:
    """P15. Content hash per meeting: a hash over the hashes of its blocks of segments."""
    row = F.concat_ws("\u001f", F.col("segment_id").cast("string"),
                      F.coalesce("speaker", F.lit("\u0002")), X.norm("text"))
    blocks = (segments.select("meeting_id", "segment_id", row.alias("_row"))
              .groupBy("meeting_id", block_of("segment_id", block).alias("_blk"))
              .agg(F.array_sort(F.collect_list(F.struct("segment_id", "_row"))).alias("_rows")))
    hashed = blocks.select("meeting_id", "_blk", F.sha2(F.array_join(
        F.transform("_rows", lambda r: r["_row"]), "\u001e"), 256).alias("_hash"))
    root = F.array_sort(F.collect_list(F.struct("_blk", "_hash")))
    return hashed.groupBy("meeting_id").agg(root.alias("_all")).select(
        "meeting_id", F.sha2(F.array_join(F.transform("_all", lambda r: r["_hash"]), "\u001e"),
                             256).alias("input_hash"))


def manifest(segments: DataFrame, config: dict[str, str]) -> DataFrame:
    """R7. What an analysis was made from: versions, configuration hash, input hash."""
    text = ";".join(f"{k}={config[k]}" for k in sorted(config))
    return transcript_digest(segments).select(
        "meeting_id", F.lit(V.ANALYSIS_VERSION).alias("analysis_version"),
        F.lit(V.PROMPT_VERSION).alias("prompt_version"),
        F.sha2(F.lit(text), 256).alias("config_hash"), "input_hash")


PIPELINE = ("analysis_version", "prompt_version", "config_hash", "input_hash")


def to_analyse(current: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """J11. Meetings whose stored analysis is missing, unfinished or made from something else."""
    if force:
        return current
    done = stored.filter(F.col("state") == "complete")
    same = [current[c].eqNullSafe(done[c]) for c in PIPELINE]
    condition = current["meeting_id"] == done["meeting_id"]
    for equal in same:
        condition = condition & equal
    return current.join(done, condition, "left_anti")


def funnel(validated: DataFrame, merged: DataFrame, by: list[str]) -> DataFrame:
    """A10. How many records each stage of extraction let through."""
    stages = validated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("generated"), F.count(F.lit(1)).alias("parsed"),
        F.count_if(F.col("reason").isNull() | ~F.col("reason").isin(
            "missing_text", "unmatched_evidence")).alias("evidence_matched"),
        F.count_if(F.col("reason").isNull()).alias("validated"))
    kept = merged.groupBy(*by).agg(F.count(F.lit(1)).alias("deduplicated"))
    return stages.join(kept, by, "left").fillna(0, ["deduplicated"])
