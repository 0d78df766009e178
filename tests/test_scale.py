"""What keeps figures in bounds on larger tables."""

from pyspark.sql import functions as F

from colloquy.operators import chunks, models, translation
from colloquy.plans.runtime import materialize, spread
from colloquy.sources import meetings, responses


def test_large_written_tables_are_not_broadcast(spark, capsys):
    """Compressed files of well under a MB that hold some 15 MB of rows."""
    def joined(rows):
        table = materialize(spark.range(rows).select((F.col("id") % 7000).alias("k"), F.repeat(F.lit("ab "), 80).alias("text")))
        both = spark.range(500_000).withColumnRenamed("id", "k").join(table.filter("k > 3"), "k")
        both.explain()
        return capsys.readouterr().out, both.count()

    plan, rows = joined(70_000)
    assert "Broadcast" not in plan and "SortMergeJoin" in plan and rows == 69_960
    plan, rows = joined(700)
    assert "BroadcastHashJoin" in plan and rows == 696


def test_responses_are_read_once_for_all_categories(spark, tmp_path, capsys):
    body = ('{"action_items":[{"task":"t","owner":"Ann","segment_ids":[4,2]},null],"decisions":[{"decision":"d"}],'
            '"questions":[{"question":"q","status":"open","answer":"a","answer_evidence":{"evidence":"e"}}],"topics":[{"label":"l"}]')
    spark.createDataFrame([(1, body + "}"), (2, body + ',"summary":['), (3, "no"), (4, None)], "run_id int, content string").write.parquet(
        f"{tmp_path}/raw")
    parsed = responses.parse_responses(spark.read.parquet(f"{tmp_path}/raw"))
    rows = responses.candidate_rows(parsed, ["run_id"])
    rows.explain()
    assert capsys.readouterr().out.count("FileScan") == 1
    assert {(r.run_id, r.salvaged, r.rejected) for r in parsed.collect()} == {
        (1, False, False), (2, True, False), (3, False, True), (4, False, True)}
    got = sorted((r.run_id, r.category, r.pos, r.item_text or "", r.owner or "", r.seg_from, r.seg_to, r.status, r.answer, r.answer_evidence)
                 for r in rows.collect())
    assert got == [(k, *x) for k in (1, 2) for x in (
        ("action_items", 0, "t", "Ann", 2, 4, None, None, None), ("action_items", 1, "", "", None, None, None, None, None),
        ("decisions", 0, "d", "", None, None, None, None, None), ("questions", 0, "q", "", None, None, "open", "a", "e"),
        ("topics", 0, "l", "", None, None, None, None, None))]


def test_segments_of_a_document_take_linear_time(spark):
    """20,000 segments in one document: each looked up among all others was 400 million steps."""
    import time

    rows = spark.range(1).select(F.lit("m").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: F.struct(
        i.cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.lit("A").alias("speaker"),
        F.lit(None).cast("string").alias("speaker_id"), F.when(i % 2 == 0, F.lit("some  words")).otherwise(F.lit(" ")).alias("text"))).alias("segments"))
    began = time.time()
    total = meetings.explode_segments(rows).agg(F.count(F.lit(1)).alias("n"), F.sum("raw_index").alias("r"), F.max("segment_id").alias("m")).first()
    assert (total.n, total.r, total.m) == (10_000, 99_990_000, 9_999) and time.time() - began < 30


def test_pieces_of_a_long_text_are_not_counted_from_its_start(spark):
    """Two million characters in pieces of 16: counted from the start that was over 10^11 steps."""
    import time

    rows = spark.range(1).select(F.repeat(F.lit("é2345678"), 250_000).alias("text"))
    began = time.time()
    got = rows.select(F.size(chunks.character_chunks(F.col("text"), 16)).alias("n"),
                      F.md5(F.array_join(chunks.character_chunks(F.col("text"), 16), "")).alias("a"), F.md5("text").alias("b")).first()
    assert got.n == 125_000 and got.a == got.b and time.time() - began < 30


def test_batches_become_objects_some_rows_at_a_time():
    import pyarrow as pa

    rows = pa.array([None, "", *map(str, range(500))])
    assert chunks.row_by_row(rows, lambda x: [x], pa.list_(pa.string())).to_pylist() == [None, [""], *[[str(i)] for i in range(500)]]
    assert chunks.row_by_row(rows[:0], lambda x: [x], pa.list_(pa.string())).to_pylist() == []


def test_turns_that_fit_are_packed_without_counting_their_characters(monkeypatch):
    import pandas as pd

    rows = pd.DataFrame({"segment_id": [0, 1, 2], "speaker": ["A", None, "é"], "start_sec": [0.0, None, 2.0],
                         "text": ['say "x"\\', "tab\tand\u0001 é 😀", "w " * 150]})
    parts = []
    monkeypatch.setattr(chunks, "_turn_parts", lambda *a, f=chunks._turn_parts: parts.append(a[0]) or f(*a))
    got = chunks._pack(200)(rows, None)
    assert parts == [rows.text[2]]
    text, labels = rows.text[1], len('{"text":"","speaker":null,"segment_id":1,"start":null}')
    whole = '{"text":"tab\\tand\\u0001 é 😀","speaker":null,"segment_id":1,"start":null}'
    assert chunks._turn_parts(text, labels, 200) == [(text, len(whole.encode()))]
    assert list(got[0].text[:2]) == list(rows.text[:2])


def test_rows_of_a_frequent_text_go_to_many_tasks(spark, monkeypatch):
    """Half of all rows hold one text; they were sorted in one task."""
    monkeypatch.setattr(translation, "ROWS_AT_ONCE", 50, raising=False)
    rows = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, "same").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("task"),
                                    F.col("id").alias("seg_from"))
    memory = spark.createDataFrame([("same", "SAME"), ("t7", "T7"), ("unused", "?")], "source string, translation string").select(
        translation.text_key().alias("text_key"), "translation")
    found = {r.id: r.task for r in translation.apply_translations(rows, ["id"], memory).collect()}
    assert found == {k: "SAME" if k % 2 == 0 else "T7" if k == 7 else f"t{k}" for k in range(4000)}
    texts = translation.display_texts(rows, ["id"]).withColumn("text_key", translation.text_key())
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        largest = translation.known_texts(texts, memory.hint("merge"), ["id"]).groupBy(
            F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert largest < 1000


def test_training_looks_at_its_sentences_once(spark):
    """Labels that are dear to find were found again for each of five passes."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def label(sentence):
        seen.add(1)
        return "DECISION" if "agreed" in sentence else "QUESTION" if "?" in sentence else "OTHER"

    texts = [f"we agreed on plan {i}" if i % 3 else f"who owns plan {i}?" for i in range(60)] + ["neither of both", "nothing"]
    rows = spark.createDataFrame([(t,) for t in texts], "sentence string").withColumn("label", label("sentence"))
    model = models.train_classifier(rows, 20, 50)
    assert seen.value <= 2 * len(texts)  # the filter and the column may each ask
    got = models.classify(model, spark.createDataFrame([("we agreed on it",), ("who knows?",)], "sentence string"))
    assert {(r.sentence, r.model_label) for r in got.collect()} == {("we agreed on it", "DECISION"), ("who knows?", "QUESTION")}


def test_spread_rows_lie_on_all_cores(spark):
    rows = spread(spark.range(40).distinct())
    assert rows.count() == 40 and rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
