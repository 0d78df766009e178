"""Reading and writing meetings and artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.functions import vocab as V

MEETING_JSON = (
    "id string, filename string, duration double, language string, uploaded_at string, "
    "status string, full_text string, segments array<struct<start:double,end:double,"
    "speaker:string,speaker_id:string,text:string>>, _corrupt_record string")


def read_meetings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """S1. One JSON document per meeting; unreadable files are left out."""
    rows = (spark.read.schema(MEETING_JSON).option("multiLine", multi_line)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
            .json(path))
    return rows.filter(F.col("_corrupt_record").isNull() & F.col("id").isNotNull()).drop(
        "_corrupt_record")


def explode_segments(meetings: DataFrame) -> DataFrame:
    """S1/S9. Segments with raw position; segment_id counts the ones that hold text.

    The segments of one document are one value, so positions come from the array itself.
    """
    # Each segment is looked at by itself, so the work is linear in their number.
    kept = F.filter(F.transform("segments", lambda s, i: F.struct(
        i.alias("raw_index"), s.alias("s"), X.norm(s["text"]).alias("text"))), lambda r: r["text"] != "")
    rows = meetings.filter(F.size("segments") > 0).select(
        F.col("id").alias("meeting_id"), F.posexplode(kept).alias("segment_id", "_r"))

    def seconds(c):
        return F.when(~F.isnan(c) & (c >= 0), c)

    return rows.select(
        "meeting_id", F.col("segment_id").cast("bigint").alias("segment_id"),
        F.col("_r.raw_index").cast("bigint").alias("raw_index"),
        seconds(F.col("_r.s.start")).alias("start_sec"), seconds(F.col("_r.s.end")).alias("end_sec"),
        F.coalesce(X.blank_to_null(X.norm("_r.s.speaker")), X.blank_to_null(
            X.norm("_r.s.speaker_id"))).alias("speaker"), F.col("_r.text").alias("text"))


def project_meetings(meetings: DataFrame) -> DataFrame:
    """S3. The six listed columns."""
    return meetings.select("id", F.coalesce("filename", F.lit("Recording")).alias("filename"),
                           F.col("duration_sec").alias("duration"), "language", "uploaded_at",
                           "status")


def segments_of(segments: DataFrame, meeting_id: int) -> DataFrame:
    """S4. Segments of one meeting by start."""
    return segments.filter(F.col("meeting_id") == meeting_id).orderBy("start_sec", "segment_id")


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None,
                   form: str = "parquet") -> str:
    """S2. Replace an artifact as a whole; readers see it only once the job has committed."""
    writer = df.write.mode("overwrite").format(form)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    return path


def append_meetings(meetings: DataFrame, meetings_path: str, segments_path: str) -> None:
    """S5. Append meeting rows and their segment rows."""
    meetings.drop("segments").write.mode("append").parquet(meetings_path)
    explode_segments(meetings).write.mode("append").parquet(segments_path)


def append_run(df: DataFrame, run_id: int, path: str) -> None:
    """S14. One more version of an artifact."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def previous_run(versions: DataFrame, run_id: int) -> DataFrame:
    """S14. The latest version below ``run_id`` of each meeting."""
    older = versions.filter(F.col("run_id") < run_id)
    latest = older.groupBy("meeting_id").agg(F.max("run_id").alias("run_id"))
    return older.join(latest, ["meeting_id", "run_id"], "left_semi")


def read_labelled(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """S7. Labelled sentences from CSV; both columns are required.

    Files can be split unless sentences hold line breaks (``multi_line``).
    """
    header = spark.read.option("header", True).option("multiLine", multi_line).option(
        "escape", '"').csv(path)
    missing = {"sentence", "label"} - set(header.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return clean_labelled(header.select("sentence", "label"))


def clean_labelled(rows: DataFrame, labels: list[str] = V.CLASS_LABELS) -> DataFrame:
    return rows.filter(F.col("label").isin(labels)).dropna(subset=["sentence", "label"])


def merge_sources(stored: DataFrame, cached: DataFrame) -> DataFrame:
    """S8. The stored row wins; a meeting only the cache knows comes from there.

    Both: meeting_id, filename, duration_sec, full_text, n_segments.
    """
    columns = ["filename", "duration_sec", "full_text"]
    s = stored.select("meeting_id", *[F.col(c).alias(f"s_{c}") for c in columns],
                      F.col("n_segments").alias("s_n"), F.lit(True).alias("_stored"))
    c = cached.select("meeting_id", *[F.col(x).alias(f"c_{x}") for x in columns],
                      F.col("n_segments").alias("c_n"))
    both = s.join(c, "meeting_id", "full_outer")
    mine = F.coalesce("_stored", F.lit(False))
    return both.select(
        "meeting_id", *[F.when(mine, F.col(f"s_{x}")).otherwise(F.col(f"c_{x}")).alias(x)
                        for x in columns],
        # Cached segments are richer (speakers), so they are preferred where there are any.
        F.when(F.coalesce("c_n", F.lit(0)) > 0, F.col("c_n")).otherwise(F.coalesce("s_n", F.lit(0)))
        .alias("n_segments"), F.when(mine, "stored").otherwise("cached").alias("origin"))


def normalise_types(raw: DataFrame) -> DataFrame:
    """S9. Loosely typed segment rows: wrong types become null or empty, times must be usable."""
    def number(c: str):
        value = F.expr(f"try_cast({c} as double)")
        return F.when(~F.isnan(value) & (value >= 0), value)

    return raw.select(
        "meeting_id", F.coalesce(F.expr("try_cast(id as bigint)"), F.col("position"))
        .alias("segment_id"), F.coalesce("text", F.lit("")).alias("text"),
        number("start").alias("start_sec"), number("end").alias("end_sec"),
        F.coalesce(X.blank_to_null(F.col("speaker")), X.blank_to_null(F.col("speaker_id")))
        .alias("speaker"))


def report_dataset(meetings: DataFrame, items: DataFrame) -> DataFrame:
    """S12. One row per meeting for the report cover: header and counts."""
    counts = items.groupBy("meeting_id").agg(
        *[F.count_if(F.col("category") == c).alias(c)
          for c in ("action_items", "decisions", "questions")])
    return meetings.join(counts, "meeting_id", "left").select(
        "meeting_id", "filename", X.duration(F.col("duration_sec")).alias("duration"),
        F.coalesce("language", F.lit("—")).alias("language"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("action_items", "decisions", "questions")])
