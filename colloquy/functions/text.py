"""Text expressions: everything here is a Column made of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions import vocab as V


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of a constant table, null where the key is missing."""
    entries = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), key)


def words_array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def norm(c: str | Column) -> Column:
    """Runs of whitespace become one space; ends trimmed; null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(_col(c), V.SPACE, " ")), F.lit(""))


def without_fillers(c: str | Column) -> Column:
    return norm(F.regexp_replace(_col(c), V.FILLER, ""))


def sentences(c: str | Column) -> Column:
    """Array of sentences: cut at whitespace after . ! ?"""
    marked = F.regexp_replace(F.trim(_col(c)), V.SENTENCE_END, "$1\u0001")
    parts = F.transform(F.split(marked, "\u0001"), lambda s: norm(s))
    return F.filter(parts, lambda s: s != "")


def units(c: str | Column) -> Column:
    """Array of units of a text without segments: sentences, which also end at line breaks."""
    lines = F.split(_col(c), "\n+")
    return F.flatten(F.transform(lines, sentences))


def words(c: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(V.WORD), 0)


def letter_words(c: str | Column) -> Column:
    """Lower-case words of at least two characters that start with a letter, no underscore."""
    return F.filter(words(c), lambda w: w.rlike(V.LETTER_WORD))


def content_words(c: str | Column, stop: list[str] = V.TOPIC_STOP) -> Column:
    # isin becomes a hash lookup, unlike a search through an array.
    return F.filter(letter_words(c), lambda w: ~w.isin(list(stop)))


def space_words(c: str | Column) -> Column:
    return F.filter(F.split(norm(c), " "), lambda w: w != "")


def word_count(c: str | Column) -> Column:
    return F.size(space_words(c))


def terms(c: str | Column) -> Column:
    """Sorted distinct comparison terms of a record's text."""
    folded = F.regexp_replace(F.lower(norm(c)), r"\bdocs?\b", "documentation")
    tokens = F.regexp_extract_all(folded, F.lit(V.WORD), 0)
    renamed = F.transform(tokens, lambda w: F.coalesce(lookup(V.TERM_ALIASES, w), w))
    return F.array_sort(F.array_except(F.array_distinct(renamed), words_array(V.TERM_DROP)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common terms; 1 when both are empty, 0 when one is."""
    common = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - common
    return F.when(either == 0, F.lit(1.0)).otherwise(common / F.nullif(either, F.lit(0)))


def contains_word(context: Column, value: Column) -> Column:
    """Whole-word, case-folded containment; false for an empty value."""
    edge = r"[^\p{L}\p{N}_]"
    quoted = F.concat(F.lit(r"\Q"), F.replace(F.lower(value), F.lit(r"\E"), F.lit("")),
                      F.lit(r"\E"))
    pattern = F.concat(F.lit(f"(^|{edge})"), quoted, F.lit(f"({edge}|$)"))
    folded = F.lower(norm(context))
    present = folded.contains(F.lower(value)) & (value != "")
    return F.coalesce(F.when(present, F.regexp_like(folded, pattern)), F.lit(False))


def clock(seconds: Column) -> Column:
    """hh:mm:ss, mm:ss below one hour; a fixed phrase where no usable time is known."""
    usable = seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0)
    whole = F.floor(seconds).cast("bigint")
    h, m, s = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60

    def two(c: Column) -> Column:
        text = c.cast("string")
        return F.when(F.length(text) < 2, F.concat(F.lit("0"), text)).otherwise(text)

    body = F.concat(F.when(h > 0, F.concat(two(h), F.lit(":"))).otherwise(F.lit("")),
                    two(m), F.lit(":"), two(s))
    return F.when(usable, body).otherwise(F.lit("Time unavailable"))


def duration(seconds: Column) -> Column:
    """"1h 02m 03s", "2m 03s", or a dash for missing and zero."""
    whole = F.floor(seconds).cast("bigint")
    h, m, s = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60

    def two(c: Column) -> Column:
        return F.lpad(c.cast("string"), 2, "0")

    long = F.concat(h.cast("string"), F.lit("h "), two(m), F.lit("m "), two(s), F.lit("s"))
    short = F.concat(m.cast("string"), F.lit("m "), two(s), F.lit("s"))
    return F.when(F.coalesce(seconds, F.lit(0.0)) == 0, F.lit("—")).when(h > 0, long).otherwise(short)


def display_date(iso: Column) -> Column:
    parsed = F.try_to_timestamp(iso)
    shown = F.concat(F.date_format(parsed, "dd MMM yyyy, HH:mm"), F.lit(" UTC"))
    return F.when(F.coalesce(iso, F.lit("")) == "", F.lit("—")).otherwise(F.coalesce(shown, iso))


def language_tag(c: Column) -> Column:
    tag = F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("_"), F.lit("-"))
    return F.when(tag.rlike(r"^[a-z]{2,3}(?:-[a-z0-9]{2,8})*$"), tag).otherwise(F.lit(""))


def primary_language(c: Column) -> Column:
    return F.split_part(language_tag(c), F.lit("-"), F.lit(1))


def highlights(text: Column, query: Column) -> Column:
    """0-based starts of non-overlapping, case-folded occurrences of ``query``."""
    folded, needle = F.lower(text), F.lower(query)
    # The pieces between occurrences give the positions: a running sum of their lengths.
    quoted = F.concat(F.lit(r"\Q"), needle, F.lit(r"\E"))
    pieces = F.split(folded, quoted)
    step = F.length(needle)
    walk = F.aggregate(
        F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda acc, piece: F.struct(
            (acc["at"] + F.length(piece) + step).alias("at"),
            F.concat(acc["found"], F.array(acc["at"] + F.length(piece))).alias("found")),
        lambda acc: acc["found"])
    return F.when(needle == "", F.array().cast("array<int>")).otherwise(walk)


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a unit separator; a missing part is kept apart from ''."""
    safe = [F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts]
    return F.sha2(F.concat_ws("\u001f", *safe), 256)


# --- rules -----------------------------------------------------------------------------------

def is_action(c: str | Column) -> Column:
    text = F.replace(_col(c), F.lit("\u2019"), F.lit("'"))
    asked = text.rlike(V.ACTION_REQUEST) | text.rlike(V.ACTION_PREFIX)
    # A question is no commitment, whatever it asks about; only a request may be one.
    committed = text.rlike(V.ACTION_MATCH) & text.rlike(V.SUBJECT_GATE) & ~text.contains("?")
    return ~text.rlike(V.ACTION_HEDGE) & (asked | committed)


def is_decision(c: str | Column) -> Column:
    text = F.trim(_col(c))
    before = F.regexp_extract(text, V.DECISION_SPLIT, 1)
    verb = F.regexp_extract(text, V.DECISION_SPLIT, 2)
    after = F.regexp_extract(text, V.DECISION_SPLIT, 3)
    near = F.slice(F.reverse(space_words(before)), 1, 5)
    negated = F.exists(near, lambda w: w.rlike(V.NEGATION))
    # Verb, not noun: no article right before it, and it says what was decided.
    verbal = ~before.rlike(V.AFTER_ARTICLE) & (
        after.rlike(r"^\s+\w") | before.rlike(V.AFTER_PASSIVE))
    return ((verb != "") & ~text.contains("?") & ~text.rlike(V.DECISION_HEDGE) & ~negated & verbal)


def is_open_issue(c: str | Column) -> Column:
    return _col(c).rlike(V.OPEN_ISSUE)


def is_meaningful_question(c: str | Column) -> Column:
    text = F.lower(F.trim(_col(c)))
    skip = sorted(set(V.TOPIC_STOP) | set(V.NOT_A_SUBJECT))
    has_subject = F.size(F.filter(letter_words(text), lambda w: ~w.isin(skip))) > 0
    return (~text.rlike(V.RHETORICAL) & has_subject & (F.size(words(text)) >= 4)
            & (text.contains("?") | is_open_issue(text)))


def is_substantive(c: str | Column) -> Column:
    text = _col(c)
    return ((word_count(text) >= 5) & ~text.rlike(V.FRAGMENT_OPENER) & ~text.endswith("?"))


def is_topic_label(c: str | Column) -> Column:
    label = norm(c)
    return ~F.lower(label).isin(V.GENERIC_TOPICS) & (F.length(label) >= 2)


# --- field extraction ---------------------------------------------------------------------------

def owner_in(evidence: Column, speaker: Column | None = None) -> Column:
    text = norm(evidence)
    named = F.coalesce(blank_to_null(F.regexp_extract(text, V.OWNER, 1)),
                       blank_to_null(F.regexp_extract(text, V.OWNER, 2)))
    named = F.when(~F.lower(named).isin(V.PRONOUNS), named)
    if speaker is None:
        return named
    return F.when(speaker.isNotNull() & (speaker != "") & text.rlike(V.FIRST_PERSON), speaker
                  ).otherwise(named)


def deadline_in(evidence: Column) -> Column:
    return blank_to_null(F.trim(F.regexp_extract(norm(evidence), V.DEADLINE, 1)))


def priority_in(evidence: Column) -> Column:
    text = norm(evidence)
    signal = F.lower(F.coalesce(blank_to_null(F.regexp_extract(text, V.PRIORITY, 1)),
                                blank_to_null(F.regexp_extract(text, V.PRIORITY, 2))))
    return F.coalesce(lookup(V.PRIORITY_MAP, signal), signal)


def status_in(evidence: Column) -> Column:
    text = norm(evidence)
    result = None
    for pattern, status in V.STATUS_RULES:
        hit = text.rlike(pattern)
        result = F.when(hit, status) if result is None else result.when(hit, status)
    return result.otherwise("Pending")


def status_of(given: Column, evidence: Column) -> Column:
    return F.coalesce(lookup(V.STATUS_VALUES, F.lower(norm(given))), status_in(evidence))


def tidy_question(c: str | Column) -> Column:
    clean = F.trim(F.regexp_replace(_col(c), V.OPENER, ""))
    asked = F.when(clean.endswith("?"), clean).otherwise(F.concat(clean, F.lit("?")))
    return F.when(clean == "", _col(c)).otherwise(
        F.concat(F.upper(F.substring(asked, 1, 1)), F.substr(asked, F.lit(2))))


def rule_label(c: str | Column, model_label: Column, confidence: Column) -> Column:
    """Decision, then action, then question; weak or unsupported model labels are discussion."""
    text = _col(c)
    return (F.when(is_decision(text), "DECISION").when(is_action(text), "ACTION ITEM")
            .when(text.contains("?") | is_open_issue(text), "QUESTION")
            .when(model_label.isin("ACTION ITEM", "DECISION", "QUESTION") | (confidence < 0.55),
                  "DISCUSSION").otherwise(model_label))
