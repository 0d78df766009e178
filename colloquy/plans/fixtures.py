"""Input tables derived from the given parquet tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.plans.ordered import dense_position

MEETINGS = 203


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of texts, spread over the cores where it comes in fewer pieces than there are.

    A small file is one row group and so one task, however heavy its texts are. Inputs with more
    splits than cores are read as they lie, without a shuffle.
    """
    rows = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() <= cores else rows


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templated transcripts: one segment per order, positions dense per meeting."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"),
        (F.col("o_orderkey") % MEETINGS).alias("meeting_id"))
    o = dense_position(orders, ["meeting_id"], "k", "segment_id", width=MEETINGS * 65536)
    k = F.col("k").cast("string")

    def numbered(prefix: str, modulus: int | None, suffix: str):
        n = k if modulus is None else (F.col("k") % modulus).cast("string")
        return F.concat(F.lit(prefix), n, F.lit(suffix))

    slot = F.col("k") % 16
    text = (
        F.when(slot == 0, numbered("Alice will send report ", None, " by Friday."))
        .when(slot == 1, numbered("Bob, can you prepare invoice ", None, " by end of week?"))
        .when(slot == 2, F.lit("We agreed to keep PostgreSQL for the release."))
        .when(slot == 3, numbered("We have not approved budget ", 50, "."))
        .when(slot == 4, F.lit("We decided not to deploy on Monday."))
        .when(slot == 5, numbered("When will we launch phase ", 5, "?"))
        .when(slot == 6, numbered("We still need to figure out who owns version ", 3, "."))
        .when(slot == 7, numbered("The API handles ", None, " requests per minute."))
        .when(slot == 8, F.lit("Um, you know, the   Docker build is  like slow."))
        .when(slot == 9, numbered("Carol must review ticket ", 97,
                                  " before release; it is urgent priority."))
        .when(slot == 10, F.lit("Maybe we could redesign the machine learning dashboard."))
        .when(slot == 11, F.lit("Does that make sense?"))
        .when(slot == 12, numbered("Dave is working on the slides urgently. They will share deck ",
                                   7, " tomorrow."))
        .when(slot == 13, F.lit("The migration is blocked and we are waiting on Kubernetes."))
        .when(slot == 14, numbered("I will update document ", 23, " next week."))
        .otherwise(F.lit("Yeah. Okay. Right.")))
    return o.select(
        "meeting_id", "segment_id",
        (F.col("segment_id") * 7).cast("double").alias("start_sec"),
        (F.col("segment_id") * 7 + 6).cast("double").alias("end_sec"),
        F.when(F.col("k") % 11 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Speaker "), (F.col("c") % 4).cast("string"))).alias("speaker"),
        text.alias("text"))


def candidates(segs: DataFrame) -> DataFrame:
    """Extraction candidates of two runs over the templated segments."""
    text = F.col("text")

    def starts(*prefixes: str):
        condition = F.lit(False)
        for prefix in prefixes:
            condition = condition | text.startswith(prefix)
        return condition

    category = (F.when(starts("Alice will ", "Bob, can ", "Carol must ", "I will update "),
                       "action_items")
                .when(starts("We agreed ", "We decided "), "decisions")
                .when(starts("When will ", "We still need "), "questions"))
    seg, run = F.col("segment_id"), F.col("run_id")
    # Two runs: each row is written out twice, which needs no join.
    rows = (segs.withColumn("category", category).filter(F.col("category").isNotNull())
            .withColumn("run_id", F.explode(F.array(F.lit(1), F.lit(2))))
            .filter(~((run == 2) & (seg % 5 == 4))))
    none = F.lit(None).cast("string")
    return rows.select(
        "run_id", "meeting_id", "category", seg.alias("seg_from"), seg.alias("seg_to"),
        F.when((run == 2) & (seg % 3 == 0), F.concat(F.lit("To confirm, "), text))
        .otherwise(text).alias("item_text"),
        F.when((run == 2) & (seg % 13 == 0), F.lit("Zed"))
        .when(starts("Alice "), F.lit("Alice")).when(starts("Bob,"), F.lit("Bob"))
        .when(starts("Carol "), F.lit("unknown")).otherwise(none).alias("owner"),
        F.when(text.endswith(" by Friday."), F.lit("Friday")).otherwise(none).alias("deadline"),
        F.when(seg % 17 == 0, F.lit("Unsupported promise.")).otherwise(text).alias("evidence"),
        F.when((run == 1) & (seg % 7 == 0), F.lit("User owner")).otherwise(none)
        .alias("edited_owner"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as ordered transcript units: meetings of 50 units."""
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 50).cast("bigint").alias("meeting_id"),
        (F.col("vec_id") % 50).alias("segment_id"), "embedding")


def conversation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations table seen as transcripts: the role speaks, the turn is the position."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("meeting_id"), F.col("turn").cast("bigint").alias("segment_id"),
        F.col("role").alias("speaker"), "text")
