"""Named acceptance cases of the rules, as small tables."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import extract


def judge(spark, rule, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, sentence string")
    return [r["v"] for r in rows.select("i", rule("sentence").alias("v")).orderBy("i").collect()]


def table(spark, texts, make):
    rows = spark.createDataFrame([(1, i, 0, t) for i, t in enumerate(texts)],
                                 "meeting_id bigint, segment_id bigint, sentence_no int, sentence string")
    return make(rows).orderBy("segment_id").collect()


def test_decisions_keep_negation_and_reject_proposals(spark):
    texts = ["They have not confirmed the venue.", "If we selected that venue, guests would complain.",
             "We should cancel the tour.", "We agreed not to print on Tuesday.", "We cancelled the second tour."]
    found = [r["statement"] for r in table(spark, texts, extract.decisions)]
    assert found == texts[-2:]


def test_noun_use_is_no_decision(spark):
    noun = ("The guide explained how the approved and the rejected stamps differ "
            "in colour and size.")
    plain = "The garden club decides not to plant the old hedge."
    assert judge(spark, X.is_decision, [noun, plain]) == [False, True]


def test_forecasts_suggestions_and_questions_are_no_tasks(spark):
    texts = ["The concert will start at nine.", "We should check the lights.",
             "Dora will never deliver the chairs.", "Unless it rains, Dora will deliver the chairs.",
             "Did Emil say he will deliver the chairs?"]
    assert judge(spark, X.is_action, texts) == [False] * 5


def test_action_fields(spark):
    texts = ["I will deliver the keys to Dora by Sunday.",
             "Dora will deliver the painted chairs to Emil by Sunday.",
             "Emil, can you arrange the lights by Saturday?",
             "Dora said Emil will deliver the keys by Sunday.",
             "I will write the guide by listing the rooms."]
    rows = table(spark, texts, extract.actions)
    assert [r["owner"] for r in rows] == [None, "Dora", "Emil", "Emil", None]
    assert [r["deadline"] for r in rows] == ["Sunday", "Sunday", "Saturday", "Sunday", None]
    assert "to Emil" in rows[1]["task"]


def test_questions(spark):
    rows = table(spark, ["Which hall has the better stage?", "Does that make sense?", "Yes?", "Ok?",
                         "How are you?"], extract.questions)
    assert [r["question"] for r in rows] == ["Which hall has the better stage?"]
    assert rows[0]["resolution_status"] == "Not assessed"


@pytest.mark.parametrize("seconds,shown", [(42.0, "00:42"), (154.0, "02:34"), (3737.0, "01:02:17"),
                                           (0.0, "00:00"), (None, "Time unavailable")])
def test_clock(spark, seconds, shown):
    row = spark.createDataFrame([(seconds,)], "s double").select(X.clock(F.col("s")).alias("c")).first()
    assert row["c"] == shown


def test_entities_are_not_parts_of_names(spark):
    segs = spark.createDataFrame([(1, 0, None, "Petersen praised the limit in front of the developer.")],
                                 "meeting_id bigint, segment_id bigint, speaker string, text string")
    names = spark.createDataFrame([(1, "people", n) for n in ("Peter", "Petersen", "limit", "developer")],
                                  "meeting_id bigint, group_name string, name string")
    assert [r["name"] for r in extract.validate_entities(names, segs).collect()] == ["Petersen"]


def test_deadline_grammar(spark):
    rows = spark.createDataFrame([("Dora will test the stage by end of month.",),
                                  ("Emil will submit the plan before launch.",)], "t string")
    got = [r["d"] for r in rows.select(X.deadline_in(F.col("t")).alias("d")).collect()]
    assert got == ["end of month", "launch"]
