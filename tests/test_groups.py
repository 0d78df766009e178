"""Terms and phrases of whole groups equal those of the joins that larger groups go through."""

import random

from pyspark.sql import functions as F

from colloquy.operators import groups, weights


def talk(spark, seed=5):
    """Groups of very different size, one sentence twice, empty sentences, capitals, a null key."""
    rng = random.Random(seed)
    pool = ["Customer", "customer", "feedback", "the", "Plan", "plan", "users", "navigation", "Äther", "sprint", "ok", "river", "Ox"]
    rows = [(f"g{g}", i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) + rng.choice([".", ", yes.", "", " owner team"]))
            for g, n in enumerate([1, 2, 3, 40, 90, 7]) for i in range(n)]
    rows += [rows[8], (None, 0, "quiet river plan"), ("words", 0, "..."), ("short", 0, "a")]
    return spark.createDataFrame(rows, "g string, i int, sentence string").repartition(3)


def test_keywords_of_whole_groups(spark):
    docs = talk(spark).select("g", "i", F.split(F.lower(F.regexp_replace("sentence", "[^\\p{L} ]", "")), " +").alias("tokens"))
    docs = docs.withColumn("tokens", F.filter("tokens", lambda t: t != ""))
    for top, most, skip in ((5, 5000, None), (3, 6, None), (4, 9, ["plan", "river plan"])):
        one, other = (weights.keywords(docs, ["g"], "i", top, most, skip, whole).collect() for whole in (groups.WHOLE, 0))
        assert sorted(map(tuple, one)) == sorted(map(tuple, other)) and len(one) > 10


def test_phrases_and_labels_of_whole_groups(spark):
    rows = talk(spark, 6)
    for head in (3, 64):
        one, other = (weights.discussion_topics(rows, ["g"], "i", 5, head, whole).collect() for whole in (groups.WHOLE, 0))
        assert sorted(map(tuple, one)) == sorted(map(tuple, other)) and len(one) > 10
    one, other = (weights.topic_labels(rows, ["g"], "i", whole).collect() for whole in (groups.WHOLE, 0))
    assert sorted(map(str, one)) == sorted(map(str, other)) and len(one) == 9


def test_groups_that_lie_over_batches_stay_whole():
    import pyarrow as pa

    batches = [pa.record_batch({"g": g, "tokens": [["a"] * 3] * len(g)}) for g in ([1, 1], [1, 2], [], [2, 3], [4, 4], [4])]
    tables = [t.column("g").to_pylist() for t in groups.whole_groups(batches, ["g"], "tokens", 7)]
    assert tables == [[1, 1, 1], [2, 2], [3], [4, 4, 4]]


def test_terms_are_written_to_disk_once(spark, capsys):
    """Each term of each sentence went through three shuffles; now its sentence goes through one, and few terms leave."""
    weights.keywords(talk(spark).select("g", "i", F.split("sentence", " ").alias("tokens")), ["g"], "i", 5).explain()
    plan = capsys.readouterr().out.split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
