"""Evidence location against brute force, with blocks small enough to matter."""

import random

from pyspark.sql import functions as F

from colloquy.operators import evidence, records
from colloquy.operators.substrings import rows_containing

SEGMENTS = ("meeting_id bigint, segment_id bigint, start_sec double, end_sec double, speaker string, "
            "text string")


def segments(spark, texts, speakers=None, meeting=1):
    rows = [(meeting, i, float(5 * i), float(5 * i + 5), speakers[i] if speakers else None, t)
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SEGMENTS)


def test_cross_segment_quote_and_zero_time(spark):
    segs = segments(spark, ["Alice will send", "the budget by Friday."])
    quotes = spark.createDataFrame([(1, "Alice will send the budget by Friday."), (1, "Fake task")],
                                   "meeting_id bigint, quote string")
    rows = evidence.locate_quotes(quotes, segs).collect()
    assert len(rows) == 1
    assert (rows[0]["seg_from"], rows[0]["seg_to"], rows[0]["timestamp"]) == (0, 1, 0.0)


def test_repeated_quote_is_settled_by_its_id_only(spark):
    segs = segments(spark, ["I will test it.", "I will test it."])
    items = spark.createDataFrame([(1, "I will test it.", 1, 1), (1, "I will test it.", None, None)],
                                  "meeting_id bigint, evidence string, seg_from bigint, seg_to bigint")
    rows = {r["seg_from"]: r for r in evidence.ground(items, segs).collect()}
    assert (rows[1]["src_from"], rows[1]["src_time"], rows[1]["src_kind"]) == (1, 5.0, "ids")
    assert (rows[None]["src_from"], rows[None]["src_kind"]) == (None, "ambiguous")


def test_disjoint_ids_include_what_lies_between(spark):
    texts = ["Let's use PostgreSQL.", "It supports our requirements.", "Agreed."]
    items = spark.createDataFrame([(1, "", 0, 2), (1, "nothing", 0, 99)],
                                  "meeting_id bigint, evidence string, seg_from bigint, seg_to bigint")
    rows = {r["seg_to"]: r for r in evidence.ground(items, segments(spark, texts)).collect()}
    assert rows[2]["src_evidence"] == " ".join(texts)
    assert rows[99]["src_evidence"] is None


def brute(texts, quote):
    full = " ".join(texts)
    if quote not in full:
        return None
    if full.count(quote) != 1:
        return (False, None, None)
    start, at, hit = full.index(quote), 0, []
    for i, t in enumerate(texts):
        if at < start + len(quote) and at + len(t) > start:
            hit.append(i)
        at += len(t) + 1
    return (True, hit[0], hit[-1])


def test_locate_equals_brute_force(spark):
    rng = random.Random(7)
    meetings, quotes = {}, []
    for m in range(6):
        words = ["ab", "a", "ba", "abab", "c.", "bcb", "aa"]
        texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(40)]
        meetings[m] = texts
        full = " ".join(texts)
        for _ in range(60):
            a = rng.randrange(len(full) - 1)
            quotes.append((m, " ".join(full[a:a + rng.randint(1, 30)].split())))
        quotes += [(m, "zzz"), (m, "ab c"), (m, "a ba ab b")]
    rows = [(m, i, 0.0, 1.0, "S", t) for m, texts in meetings.items() for i, t in enumerate(texts)]
    segs = spark.createDataFrame(rows, SEGMENTS)
    asked = {(m, q) for m, q in quotes if q}
    found = evidence.locate_quotes(spark.createDataFrame(sorted(asked), "meeting_id bigint, quote string"),
                                   segs, block=8).collect()
    got = {(r["meeting_id"], r["quote"]): (r["is_unique"], r["seg_from"], r["seg_to"]) for r in found}
    want = {k: brute(meetings[k[0]], k[1]) for k in asked}
    assert got == {k: v for k, v in want.items() if v}


def test_rows_containing_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["red", "redo", "re", "x", "do it"]) for _ in range(rng.randint(1, 7)))
             for _ in range(50)]
    needles = sorted({" ".join(t[a:a + 9].split()) for t in texts for a in (0, 2, 5)} - {""})
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "g int, row_id int, text string")
    asked = spark.createDataFrame([(1, n) for n in needles], "g int, needle string")
    got = {(r["needle"], r["row_id"]) for r in rows_containing(asked, rows, ["g"]).collect()}
    assert got == {(n, i) for n in needles for i, t in enumerate(texts) if n in t}


def test_validation_infers_only_what_the_evidence_says(spark):
    segs = segments(spark, ["I'll send the report tomorrow.", "Bob is working on the slides urgently."],
                    ["Speaker 2", None])
    items = spark.createDataFrame(
        [(1, "action_items", "Send report", "I'll send the report tomorrow.", "Speaker 2", "Friday", "high"),
         (1, "action_items", "Work on the slides", "Bob is working on the slides urgently.", None, None, None),
         (1, "action_items", "Invented", "Alice will send it.", None, None, None)],
        "meeting_id bigint, category string, item_text string, evidence string, owner string, "
        "deadline string, priority string")
    rows = {r["text"]: r for r in records.validate(items, segs).collect()}
    first, second = rows["Send report"], rows["Work on the slides"]
    assert (first["owner"], first["deadline"], first["priority"]) == ("Speaker 2", None, None)
    assert (second["owner"], second["priority"], second["status"]) == ("Bob", "high", "In Progress")
    assert rows["Invented"]["reason"] == "unmatched_evidence"


def test_point_lookup_across_stretches(spark):
    segs = segments(spark, ["one", "two", "three"])
    points = spark.createDataFrame([(1, i, t) for i, t in enumerate([-3.0, 0.0, 7.0, 14.9, 900.0])],
                                   "meeting_id bigint, point_id int, at_sec double")
    rows = evidence.segment_at(points, segs).orderBy("point_id").collect()
    assert [r["segment_id"] for r in rows] == [0, 0, 1, 2, 2]


def test_evidence_click_prefers_the_segment_playing(spark):
    segs = segments(spark, ["We need authentication before release.",
                            "Use the temporary method for the demo."])
    asked = spark.createDataFrame([(1, 0, [0, 1], 6.0, "x"), (1, 1, [], None, "the temporary METHOD")],
                                  "meeting_id bigint, evidence_id int, segment_ids array<bigint>, "
                                  "timestamp double, evidence string")
    rows = evidence.jump_targets(asked, segs).orderBy("evidence_id").collect()
    assert [(r["segment_id"], r["reason"]) for r in rows] == [(1, "segment-id"), (1, "text")]
    assert rows[0]["seconds"] == 5.0


def test_ordered_helpers_do_not_depend_on_the_block(spark):
    from colloquy.plans.ordered import dense_position, running_sum, with_neighbours

    rng = random.Random(1)
    data = [(k, i * 3, rng.randint(0, 9)) for k in range(3) for i in range(50)]
    df = spark.createDataFrame(data, "k int, o bigint, v int")
    dense = dense_position(df, ["k"], "o", "pos", width=10)
    total = running_sum(dense, ["k"], "pos", F.col("v"), "s", True, block=7)
    near = with_neighbours(total, ["k"], "pos", 2, 3, {
        "before": lambda w: F.lag("v", 2).over(w),
        "ahead": lambda w: F.sum("v").over(w.rowsBetween(1, 3))}, block=7)
    for k in range(3):
        vs = [v for kk, _, v in data if kk == k]
        rows = near.filter(F.col("k") == k).orderBy("pos").collect()
        assert [r["pos"] for r in rows] == list(range(50))
        assert [r["s"] for r in rows] == [sum(vs[:i + 1]) for i in range(50)]
        assert [r["before"] for r in rows] == [None, None] + vs[:-2]
        assert [r["ahead"] or 0 for r in rows] == [sum(vs[i + 1:i + 4]) for i in range(50)]


def test_all_rows_in_one_second(spark):
    """A meeting whose segments and points share a moment lies over several ranges, with the same result."""
    from colloquy.plans.ordered import ranged

    segs = [(1, k, 5.0, 9.0) for k in range(400)] + [(2, k, float(k), k + 0.5) for k in range(20)]
    asked = [(1, k, 5.0 if k % 2 else 4.0) for k in range(300)] + [(2, k, k / 2) for k in range(60)]
    s = spark.createDataFrame(segs, "meeting_id bigint, segment_id bigint, start_sec double, end_sec double").repartition(4)
    p = spark.createDataFrame(asked, "meeting_id bigint, point_id bigint, at_sec double").repartition(4)
    got = {(r["meeting_id"], r["point_id"]): r["segment_id"] for r in evidence.segment_at(p, s).collect()}
    want = {(1, k): 399 if k % 2 else 0 for k in range(300)} | {(2, k): min(k // 2, 19) for k in range(60)}
    assert got == want
    parts = ranged(s, ["meeting_id", "start_sec"]).filter("meeting_id = 1").groupBy("_part").count()
    assert parts.count() > 1
