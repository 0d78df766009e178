"""Raw model responses to typed candidate rows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVIDENCE = "evidence: string, segment_ids: array<bigint>"
DETAILS = ", ".join(f"{d}: string, {d}_evidence: string" for d in ("owner", "deadline", "priority"))
# S11. The fields a response may hold; what is computed here (times, speakers) is not asked for.
RESPONSE_SCHEMA = (
    "summary array<string>, summary_evidence array<struct<" + EVIDENCE + ">>, "
    "key_takeaway string, takeaway_evidence struct<" + EVIDENCE + ">, "
    "action_items array<struct<task: string, status: string, " + DETAILS + ", " + EVIDENCE + ">>, "
    "follow_ups array<struct<task: string, status: string, " + DETAILS + ", " + EVIDENCE + ">>, "
    "decisions array<struct<decision: string, " + EVIDENCE + ">>, "
    "questions array<struct<question: string, status: string, answer: string, "
    "answer_evidence: struct<" + EVIDENCE + ">, " + EVIDENCE + ">>, "
    "topics array<struct<label: string, keywords: array<string>, " + EVIDENCE + ">>, "
    "entities struct<people: array<string>, organizations: array<string>, dates: array<string>, "
    "locations: array<string>, products: array<string>>")
RECOGNISED = ["summary", "action_items", "decisions", "questions", "topics"]
# Strings are matched first and kept, so only commas outside them can go.
LOOSE_COMMA = r'(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+")|,(?=\s*[}\]])'


def complete_part(content: str) -> str | None:
    """The object up to its last complete field: cut at commas between fields, from the last one back."""
    depth, quoted, skip, commas = 0, False, False, []
    for at, c in enumerate(content):
        if skip or (quoted and c not in '"\\'):
            skip = False
        elif quoted:
            quoted, skip = c != '"', c == "\\"
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
        elif c == "," and depth == 1:
            commas.append(at)
    for cut in [len(content), *reversed(commas)]:
        closed = content[:cut] + "}"
        try:
            json.loads(closed)
        except ValueError:
            continue
        return closed
    return None


def _recognised(c: str):
    """Whether a text is a sound object with a known field."""
    return F.coalesce(F.arrays_overlap(F.json_object_keys(c), F.array(*[F.lit(k) for k in RECOGNISED])), F.lit(False))


def parse_responses(raw: DataFrame, column: str = "content") -> DataFrame:
    """S10. Adds ``parsed`` (typed), ``salvaged`` and ``rejected`` to each response.

    Sound JSON is read by the engine; only objects it cannot read go through the repair step.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(column), r"(?i)^```(?:json)?\s*", ""),
                            r"\s*```$", "")

    @F.pandas_udf("string")
    def repair(values: pd.Series) -> pd.Series:
        return values.map(complete_part, na_action="ignore")

    rows = raw.withColumn("_clean", F.regexp_replace(bare, LOOSE_COMMA, "$1"))
    rows = rows.withColumn("_sound", F.coalesce(F.json_object_keys("_clean").isNotNull(), F.lit(False)))
    # One pass: only broken objects go to the repair step, the others as nulls.
    broken = ~F.col("_sound") & F.coalesce(F.col("_clean").startswith("{"), F.lit(False))
    read = rows.withColumn("salvaged", broken).withColumn("_mended", repair(F.when(F.col("salvaged"), F.col("_clean"))))
    read = read.withColumn("_json", F.when(F.col("_sound"), F.col("_clean")).otherwise(F.col("_mended")))
    read = read.withColumn("rejected", ~_recognised("_json"))
    return (read.withColumn("parsed", F.when(~F.col("rejected"), F.from_json("_json", RESPONSE_SCHEMA)))
            .withColumn("salvaged", F.col("salvaged") & ~F.col("rejected")).drop("_clean", "_sound", "_mended", "_json"))


def candidate_rows(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Typed responses as one candidate row per record, ready for validation."""
    good = parsed.filter(~F.col("rejected"))
    none = F.lit(None).cast("string")

    def records(category: str, field: str):
        task, asked = field == "task", category == "questions"

        def record(i, pos):
            return F.struct(
                pos.alias("pos"), F.lit(category).alias("category"), i[field].alias("item_text"),
                i["evidence"].alias("evidence"), F.array_min(i["segment_ids"]).alias("seg_from"),
                F.array_max(i["segment_ids"]).alias("seg_to"),
                *[(i[c] if task else none).alias(c) for c in (
                    "owner", "owner_evidence", "deadline", "deadline_evidence", "priority", "priority_evidence")],
                (i["status"] if task or asked else none).alias("status"),
                (i["answer"] if asked else none).alias("answer"),
                (i["answer_evidence"]["evidence"] if asked else none).alias("answer_evidence"))

        return F.transform(F.col(f"parsed.{category}"), record)

    # All categories from one reading of each response; a missing one holds no records.
    found = F.flatten(F.array_compact(F.array(*[records(category, field) for category, field in (
        ("action_items", "task"), ("follow_ups", "task"), ("decisions", "decision"), ("questions", "question"),
        ("topics", "label"))])))
    return good.select(*keys, F.explode(found).alias("_r")).select(*keys, "_r.*")


def compact_evidence(items: DataFrame) -> DataFrame:
    """P16. A run of more than two ids as its two ends; the quote is left out where ids say it."""
    ids = F.col("segment_ids")
    run = (F.size(ids) > 2) & (ids == F.sequence(F.element_at(ids, 1), F.element_at(ids, -1)))
    return items.withColumns({
        "evidence": F.when(F.size(ids) > 0, F.lit("")).otherwise(F.col("evidence")),
        "segment_ids": F.when(run, F.array(F.element_at(ids, 1), F.element_at(ids, -1)))
        .otherwise(ids)})
