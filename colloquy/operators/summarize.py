"""Extractive summaries (K4): relevance to the centroid, boosts, and diversity by rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.functions import vocab as V
from colloquy.operators.extract import first_of_each
from colloquy.operators.weights import tfidf
from colloquy.plans.runtime import materialize

KEY = ["meeting_id"]


def summary_candidates(sentences: DataFrame) -> DataFrame:
    """F5. Substantive sentences, each wording once, at its first place (``pos``: segment, sentence)."""
    rows = sentences.select("meeting_id", F.struct("segment_id", "sentence_no").alias("pos"),
                            X.norm("sentence").alias("sentence"))
    return first_of_each(rows.filter(X.is_substantive("sentence")), ["meeting_id", "sentence"],
                         ["pos"])


def score_sentences(rows: DataFrame, weights: DataFrame, focus: DataFrame | None = None
                    ) -> DataFrame:
    """Centroid cosine plus boosts for outcomes, risks and focus; short chatter is damped."""
    size = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    centre = (weights.groupBy(*KEY, "term").agg(F.sum("w").alias("_s"))
              .join(size, KEY).select(*KEY, "term", (F.col("_s") / F.col("_n")).alias("c")))
    length = centre.groupBy(*KEY).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("_len"))
    near = (weights.join(centre, KEY + ["term"]).groupBy(*KEY, "pos")
            .agg(F.sum(F.col("w") * F.col("c")).alias("_dot")).join(length, KEY)
            .select(*KEY, "pos", (F.col("_dot") / F.col("_len")).alias("_cos")))
    scored = rows.join(near, KEY + ["pos"], "left")
    outcome = X.is_action("sentence") | X.is_decision("sentence")
    if focus is None:
        focused = F.lit(False)
    else:
        scored = scored.join(focus.select(*KEY, "sentence").distinct().withColumn(
            "_focus", F.lit(True)), KEY + ["sentence"], "left")
        focused = F.coalesce("_focus", F.lit(False))
    base = (F.coalesce("_cos", F.lit(0.0))
            + F.when(focused, V.FOCUS_BOOST).otherwise(0.0)
            + F.when(outcome, V.OUTCOME_BOOST).otherwise(0.0)
            + F.when(F.col("sentence").rlike(V.RISK), V.RISK_BOOST).otherwise(0.0))
    damped = (X.word_count("sentence") < 8) & ~outcome
    return scored.select(*KEY, "pos", "sentence", F.round(
        F.when(damped, base * V.SHORT_FACTOR).otherwise(base), 9).alias("score"))


def summarize(sentences: DataFrame, n: int = 5, focus: DataFrame | None = None) -> DataFrame:
    """K4. The ``n`` chosen sentences per meeting with their round, in transcript order by pos.

    Each round takes the best of score minus 0.65 times the greatest similarity to a sentence
    already chosen, ties to the earliest. A round is one aggregate per meeting and one join of
    the chosen sentences' terms, never a matrix of all pairs.
    """
    rows = materialize(summary_candidates(sentences))
    token = F.filter(X.words("sentence"), lambda w: (F.length(w) >= 2)
                     & ~w.isin(V.TOPIC_STOP))
    weights = materialize(tfidf(rows.select(*KEY, "pos", token.alias("tokens")), KEY, "pos",
                                (1, 2), 10000))
    # Rounds carry places and numbers only; the sentences join the chosen places at the end.
    state = materialize(score_sentences(rows, weights, focus).drop("sentence").withColumn(
        "redundancy", F.lit(0.0)).withColumn("round", F.lit(None).cast("int")))
    for step in range(1, n + 1):
        value = F.round(F.col("score") - V.MMR_WEIGHT * F.col("redundancy"), 9)
        open_rows = state.filter("round is null")
        chosen = open_rows.groupBy(*KEY).agg(
            F.min_by("pos", F.struct(-value, F.col("pos"))).alias("pos"))
        marked = state.join(chosen.withColumn("_now", F.lit(step)), KEY + ["pos"], "left")
        marked = marked.withColumn("round", F.coalesce("round", "_now")).drop("_now")
        if step < n:
            picked = weights.join(chosen, KEY + ["pos"]).select(*KEY, "term",
                                                                F.col("w").alias("_w"))
            similar = (weights.join(picked, KEY + ["term"]).groupBy(*KEY, "pos")
                       .agg(F.sum(F.col("w") * F.col("_w")).alias("_sim")))
            marked = (marked.join(similar, KEY + ["pos"], "left")
                      .withColumn("redundancy", F.greatest("redundancy",
                                                           F.coalesce("_sim", F.lit(0.0))))
                      .drop("_sim"))
            state = materialize(marked)
        else:
            state = marked
    return state.filter("round is not null").join(rows, KEY + ["pos"]).select(*KEY, "pos", "sentence", "round")
