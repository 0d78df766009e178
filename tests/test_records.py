"""Merging, identity and reconciliation: named cases and brute force."""

import random
import re

from pyspark.sql import functions as F

from colloquy.functions.vocab import TERM_ALIASES, TERM_DROP
from colloquy.operators import reconcile, records

ITEM = ("meeting_id bigint, category string, pos bigint, text string, evidence string, seg_from bigint, "
        "seg_to bigint, timestamp double, speaker string, owner string, deadline string, priority string, "
        "status string, answer string, answer_evidence string")


def item(pos, text, quote, owner=None, deadline=None, seg=0, category="action_items"):
    return (1, category, pos, text, quote, seg, seg, 0.0, None, owner, deadline, None, "Pending", None, None)


def word_set(text):
    text = re.sub(r"\bdocs?\b", "documentation", text.lower())
    return {TERM_ALIASES.get(w, w) for w in re.findall(r"\w+", text)} - set(TERM_DROP)


def one_by_one(items):
    kept, home = [], {}
    for _, category, pos, text, quote, *rest in items:
        owner, due = rest[4], rest[5]
        for k in kept:
            clash = category == "action_items" and any(
                a and b and a != b for a, b in ((owner, k["owner"]), (due, k["due"])))
            a, b = word_set(text), k["words"]
            if not clash and (quote in k["quote"] or k["quote"] in quote) and (
                    a == b or (a and b and len(a & b) / len(a | b) >= .72)):
                home[pos] = k["pos"]
                k["owner"], k["due"] = k["owner"] or owner, k["due"] or due
                k["quote"] = quote if len(quote) > len(k["quote"]) else k["quote"]
                break
        else:
            kept.append({"pos": pos, "words": word_set(text), "quote": quote, "owner": owner, "due": due})
            home[pos] = pos
    return home


def test_greedy_merge_equals_one_by_one(spark):
    rng = random.Random(11)
    items = []
    for pos in range(120):
        text = " ".join(rng.sample(["send", "report", "budget", "team", "docs", "plan", "draft", "to"],
                                   rng.randint(3, 5)))
        quote = rng.choice(["alpha beta gamma delta epsilon", "beta gamma delta epsilon", "zeta eta theta",
                            "alpha beta gamma delta epsilon zeta eta theta", "gamma"])
        items.append(item(pos, text, quote, rng.choice([None, "Ann", "Bo"]), rng.choice([None, None, "Friday"])))
    keepers = records.assign_keepers(spark.createDataFrame(items, ITEM), ["meeting_id", "category"])
    got = {r["pos"]: r["keeper"] for r in keepers.collect()}
    assert got == one_by_one(items)


def test_merge_in_rounds_on_random_clusters(spark):
    """Many small clusters, nested quotes, gaps that fill late: the outcome of the walk in order."""
    rng = random.Random(12)
    words = ["send", "report", "budget", "team", "docs", "plan", "draft", "to"]
    quotes = [" ".join("alpha beta gamma delta epsilon zeta eta theta".split()[a:b]) for a in range(4) for b in range(a + 3, 9)]
    rows, want = [], {}
    for meeting in range(40):
        items = []
        for pos in range(rng.randrange(2, 30)):
            row = item(pos, " ".join(rng.sample(words[:rng.choice([5, 8])], rng.randint(4, 5))), rng.choice(quotes),
                       rng.choice([None, None, "Ann", "Bo"]), rng.choice([None, None, "Friday", "Monday"]),
                       category=rng.choice(["action_items"] * 3 + ["decisions"]))
            items.append((meeting, *row[1:]))
        rows += items
        for category in ("action_items", "decisions"):
            home = one_by_one([i for i in items if i[1] == category])
            want |= {(meeting, category, pos): keeper for pos, keeper in home.items()}
    keepers = records.assign_keepers(spark.createDataFrame(rows, ITEM).repartition(4), ["meeting_id", "category"])
    assert {(r["meeting_id"], r["category"], r["pos"]): r["keeper"] for r in keepers.collect()} == want


def test_a_cluster_of_very_many_records(spark):
    """100,000 records of one meeting that are all alike: one leader, compared with each once."""
    rows = spark.range(100_000).selectExpr(
        "1 AS meeting_id", "'decisions' AS category", "id AS pos",
        "concat('keep the violet harbour lanterns near quiet mills over tall dunes number ', id) AS text",
        "'All agreed on the lanterns of the harbour.' AS evidence", "id AS seg_from", "id AS seg_to",
        "0D AS timestamp", "CAST(null AS string) AS speaker", "CAST(null AS string) AS owner",
        "CAST(null AS string) AS deadline", "CAST(null AS string) AS priority", "'x' AS status",
        "CAST(null AS string) AS answer", "CAST(null AS string) AS answer_evidence")
    keepers = records.assign_keepers(rows, ["meeting_id", "category"])
    assert keepers.filter("keeper = 0").count() == 100_000


def test_three_rows_become_two_and_gaps_are_filled(spark):
    items = [item(0, "Fix the login bug", "Bob will fix the login bug."),
             item(1, "Repair login issue", "Bob will fix the login bug.", owner="Bob"),
             item(2, "Update documentation", "Alice will update docs.", owner="Alice")]
    rows = records.deduplicate(spark.createDataFrame(items, ITEM), ["meeting_id", "category"]).orderBy("pos").collect()
    assert [(r["text"], r["owner"], r["merged"]) for r in rows] == [
        ("Fix the login bug", "Bob", 2), ("Update documentation", "Alice", 1)]


def test_different_owners_never_merge(spark):
    items = [item(0, "Test release", "Both will test the release.", owner="Alice"),
             item(1, "Test release", "Both will test the release.", owner="Bob")]
    rows = records.deduplicate(spark.createDataFrame(items, ITEM), ["meeting_id", "category"]).collect()
    assert len(rows) == 2


def test_ids_use_wording_only_when_sources_tie(spark):
    items = [item(0, "Test login", "q", seg=3), item(1, "Update docs", "q", seg=3), item(2, "Other", "r", seg=4)]
    one = {r["pos"]: r["id"] for r in records.assign_ids(spark.createDataFrame(items, ITEM)).collect()}
    reworded = items[:2] + [item(2, "Reworded", "r", seg=4)]
    two = {r["pos"]: r["id"] for r in records.assign_ids(spark.createDataFrame(reworded, ITEM)).collect()}
    assert len(set(one.values())) == 3 and one == two


def reconciled(spark, old, new, texts, same=True, edited=None):
    segs = spark.createDataFrame([(1, i, float(i), float(i + 1), None, t) for i, t in enumerate(texts)],
                                 "meeting_id bigint, segment_id bigint, start_sec double, end_sec double, "
                                 "speaker string, text string")
    prev = records.assign_ids(spark.createDataFrame(old, ITEM)).withColumn(
        "edits", F.create_map(*[F.lit(x) for pair in (edited or {}).items() for x in pair])
        if edited else F.lit(None).cast("map<string,string>"))
    cand = records.assign_ids(spark.createDataFrame(new, ITEM))
    flags = spark.createDataFrame([(1, same)], "meeting_id bigint, compatible boolean")
    ids = {r["pos"]: r["id"] for r in prev.collect()}
    return ids, reconcile.reconcile(prev, cand, segs, flags).collect()


TURN = "Alice will prepare the wireframes by Friday."


def test_reworded_item_keeps_its_id_and_edit(spark):
    ids, rows = reconciled(spark, [item(0, "Prepare the wireframes", TURN)],
                           [item(0, "Create revised wireframes", TURN)], [TURN], edited={"owner": "User owner"})
    assert [(r["id"], r["reconciliation"], r["owner"]) for r in rows] == [(ids[0], "stable", "User owner")]


def test_every_edited_field_stays(spark):
    edits = {"deadline": "Sunday", "status": "Completed", "text": "Own words"}
    _, rows = reconciled(spark, [item(0, "Prepare the wireframes", TURN)], [item(0, "Prepare wireframes", TURN)],
                         [TURN], edited=edits)
    assert [(r["reconciliation"], r["deadline"], r["status"], r["text"], r["edited"]) for r in rows] == [
        ("stable", "Sunday", "Completed", "Own words", True)]


def test_several_records_of_a_turn_and_records_without_source(spark):
    turn = "Alice will send the report and delete the backup."
    items = [item(9, "Send report", turn), item(9, "Delete backup", turn), item(9, "Delete the backup", turn)]
    loose = [(*x[:5], None, None, *x[7:]) for x in (item(9, "Hire a designer", turn), item(9, "Hire a cook", turn))]
    rows = spark.createDataFrame([x[:2] + x[3:] for x in items + loose], ", ".join(
        f for f in ITEM.split(", ") if not f.startswith("pos ")))
    numbered = records.number(rows, ["meeting_id", "category"])
    assert sorted(r["pos"] for r in numbered.collect()) == [0, 1, 2, 3, 4]
    kept = records.deduplicate(numbered, ["meeting_id", "category"]).collect()
    assert sorted((r["text"], r["merged"]) for r in kept) == [
        ("Delete backup", 2), ("Hire a cook", 1), ("Hire a designer", 1), ("Send report", 1)]


def test_a_citation_beyond_the_transcript_is_no_support(spark):
    segs = spark.createDataFrame([(1, 0, 0.0, 1.0, None, TURN)], "meeting_id bigint, segment_id bigint, "
                                 "start_sec double, end_sec double, speaker string, text string")
    rows = spark.createDataFrame([(1, "decisions", "Something", "Not said", 0, 10 ** 15)],
                                 "meeting_id bigint, category string, item_text string, evidence string, "
                                 "seg_from bigint, seg_to bigint")
    assert [r["reason"] for r in records.validate(rows, segs).collect()] == ["unmatched_evidence"]


def test_distinct_tasks_of_one_turn_do_not_match(spark):
    turn = "Alice will send the report and delete the backup."
    ids, rows = reconciled(spark, [item(0, "Send report", turn, owner="Alice")],
                           [item(0, "Delete backup", turn, owner="Alice")], [turn])
    assert sorted(r["reconciliation"] for r in rows) == ["new", "retained"]
    assert len({r["id"] for r in rows}) == 2


def test_unsupported_or_changed_source_is_removed_and_reviewed(spark):
    _, rows = reconciled(spark, [item(0, "Old promise", "Unsupported promise", seg=0)],
                         [item(0, "Other", TURN, seg=0)], [TURN])
    assert sorted(r["reconciliation"] for r in rows) == ["new", "removed"]
    _, rows = reconciled(spark, [item(0, "Prepare the wireframes", TURN)], [item(0, "Unlike", TURN)],
                         [TURN], same=False, edited={"deadline": "Never"})
    gone = [r for r in rows if r["reconciliation"] == "removed"]
    assert len(gone) == 1 and gone[0]["edited"]


def test_contested_matches_go_to_the_first_in_order(spark):
    old = [item(0, "Send the report", TURN, seg=0), item(1, "Send report now", TURN, seg=0)]
    new = [item(0, "Send report", TURN, seg=0), item(1, "Send the report now", TURN, seg=0)]
    pairs = reconcile.match_records(spark.createDataFrame(old, ITEM), spark.createDataFrame(new, ITEM))
    assert {(r["o_pos"], r["n_pos"]) for r in pairs.collect()} == {(0, 0), (1, 1)}


def test_first_free_equals_the_walk_on_random_graphs(spark):
    rng = random.Random(13)
    pairs = {(g, "x", rng.randrange(n), rng.randrange(n)) for g in range(60) for n in [rng.randrange(2, 14)]
             for _ in range(rng.randrange(1, 4 * n))}
    pairs |= {(99, "y", o, n) for o in range(12) for n in range(12)}  # all want the same
    want, taken, served = set(), set(), set()
    for g, c, o, n in sorted(pairs):
        if (g, c, o) not in served and (g, c, n) not in taken:
            served.add((g, c, o))
            taken.add((g, c, n))
            want.add((g, c, o, n))
    table = spark.createDataFrame(sorted(pairs), "meeting_id bigint, category string, o_pos bigint, n_pos bigint")
    got = reconcile.first_free(table.repartition(4)).collect()
    assert {(r["meeting_id"], r["category"], r["o_pos"], r["n_pos"]) for r in got} == want and len(got) == len(want)


def test_places_over_many_ranges(spark):
    """A group of many equal rows without sources, and one in order: dense places in every group."""
    rows = [(1, "decisions", "same", "q", None, None)] * 300 + [(2, "decisions", f"t{k % 7}", "q", k % 5, k % 5) for k in range(200)]
    df = spark.createDataFrame(rows, "meeting_id bigint, category string, text string, evidence string, seg_from bigint, seg_to bigint")
    got = records.number(df.repartition(5), ["meeting_id", "category"]).collect()
    assert sorted(r["pos"] for r in got if r["meeting_id"] == 1) == list(range(300))
    two = sorted((r["pos"], r["seg_from"], r["text"]) for r in got if r["meeting_id"] == 2)
    assert [r[0] for r in two] == list(range(200)) and [r[1:] for r in two] == sorted(r[1:] for r in two)


def test_the_last_of_several_edits_of_an_item_counts(spark):
    items = spark.createDataFrame([(1, 0, "Task", "t1", None, None)],
                                  "meeting_id bigint, item_index bigint, task string, analyzed_at string, owner string, deadline string")
    edits = spark.createDataFrame([(1, 0, "Task", "t1", "Zoe", "Friday", 1), (1, 0, "Task", "t1", "Ann", " ", 2), (1, 0, "Task", "t0", "Bo", "", 3)],
                                  "meeting_id bigint, item_index bigint, task string, analyzed_at string, owner string, deadline string, edit_no int")
    rows = reconcile.apply_edits(items, edits).collect()
    assert [(r["owner"], r["deadline"], r["manually_edited"]) for r in rows] == [("Ann", None, True)]
    assert reconcile.apply_edits(items, edits.drop("edit_no")).count() == 1


def test_components_of_a_long_chain(spark):
    from colloquy.plans.graph import connected_components

    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40) if i != 20]
    rows = connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()
    groups = {r["node"]: r["component"] for r in rows}
    assert {groups[f"n{i:03d}"] for i in range(21)} == {"n000"}
    assert {groups[f"n{i:03d}"] for i in range(21, 41)} == {"n021"}
