"""Exact substring joins: which quotes occur where, without testing every pair.

Texts are whitespace-normalised, so a text is words separated by single spaces and a quote of
four or more words holds whole word pairs of the text inside it. Each quote is looked up by the
word pair of its own that is rarest in the same group; quotes of up to three words, whose
outer words may be parts of words, are first matched against the distinct word pairs. Every
candidate is then compared character by character. Groups may be of any size: the index has
one row per word, and candidates per quote are bounded by the count of its rarest word pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.plans.ordered import BLOCK, running_sum, with_neighbours
from colloquy.plans.runtime import materialize

PIECE = 64
CHAR_BLOCK = 4096


def _word_index(rows: DataFrame, keys: list[str], next_word: str | None) -> DataFrame:
    """One row per word: the word, the word after it and its character offset."""
    words = F.split("text", " ")
    pieces = rows.withColumn("_words", words).withColumn(
        "_pieces", F.transform(F.sequence(F.lit(0), F.size("_words") - 1, F.lit(PIECE)),
                               lambda i: F.slice("_words", i + 1, F.lit(PIECE + 1))))
    lengths = F.transform("_pieces", lambda p: F.length(
        F.array_join(F.slice(p, 1, PIECE), " ")) + 1)
    pieces = pieces.withColumn("_lengths", lengths)
    starts = F.transform(
        F.sequence(F.lit(0), F.size("_pieces") - 1),
        lambda i: F.aggregate(F.slice("_lengths", F.lit(1), i), F.lit(0), lambda a, x: a + x))
    piece = (pieces.select(*keys, "row_id", "at", "_words", F.lit(None).cast("string").alias("_n")
                           if next_word is None else F.col(next_word).alias("_n"),
                           F.posexplode(F.arrays_zip("_pieces", starts.alias("_starts")))
                           .alias("_p", "_piece"))
             .withColumn("_list", F.col("_piece._pieces"))
             .withColumn("_from", F.col("at") + F.col("_piece._starts")))
    shown = F.least(F.size("_list"), F.lit(PIECE))
    inside = F.transform(F.sequence(F.lit(0), shown - 1), lambda i: F.struct(
        F.get("_list", i).alias("w"),
        F.coalesce(F.get("_list", i + 1), F.col("_n"), F.lit("")).alias("nxt"),
        F.when(i == 0, F.lit(0)).otherwise(
            F.length(F.array_join(F.slice("_list", F.lit(1), i), " ")) + 1).alias("off")))
    return (piece.select(*keys, "row_id", F.col("_from"), F.explode(inside).alias("_g"))
            .select(*keys, "row_id", F.col("_g.w").alias("w"), F.col("_g.nxt").alias("nxt"),
                    (F.col("_from") + F.col("_g.off")).alias("word_at")))


def _ends(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, F.substring(c, -n, n))


def _starts(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, F.substring(c, 1, n))


def _lookups(needles: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, needle, w, nxt, delta): word pairs to look for; a match starts ``delta`` from w."""
    # Distinct pairs grow far slower than the text and are read for every quote length.
    pairs = materialize(index.groupBy(*keys, "w", "nxt").agg(F.count(F.lit(1)).alias("cnt")))
    n = needles.withColumn("_q", F.split("needle", " ")).withColumn("_m", F.size("_q"))
    first, second = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    three = F.lit(3)

    # Four words and more: the rarest of the word pairs wholly inside the quote.
    inner = F.transform(F.sequence(F.lit(1), F.col("_m") - 3), lambda i: F.struct(
        F.get("_q", i).alias("w"), F.get("_q", i + 1).alias("nxt"),
        (-F.length(F.array_join(F.slice("_q", F.lit(1), i), " ")) - 1).alias("delta")))
    long = (n.filter("_m >= 4").select(*keys, "needle", F.explode(inner).alias("_g"))
            .select(*keys, "needle", "_g.w", "_g.nxt", "_g.delta"))
    total = n.filter("_m >= 4").select(*keys, "needle", (F.col("_m") - 3).alias("_pairs"))
    rarest = (long.join(pairs, keys + ["w", "nxt"])
              .groupBy(*keys, "needle")
              .agg(F.min(F.struct("cnt", "w", "nxt", "delta")).alias("_best"),
                   F.count(F.lit(1)).alias("_seen"))
              .join(total, keys + ["needle"]).filter("_seen = _pairs")
              .select(*keys, "needle", "_best.w", "_best.nxt", "_best.delta"))

    # Three words: the first may be the end of a word, the second is whole.
    tail3 = F.substring(first, -3, 3)
    mid = n.filter("_m = 3").select(*keys, "needle", first.alias("_a"), second.alias("nxt"),
                                    tail3.alias("_tail"))
    by_tail = pairs.select(*keys, "w", "nxt", F.explode(F.array_compact(F.array(
        *[_ends(F.col("w"), i) for i in (1, 2, 3)]))).alias("_tail"))
    three_words = (mid.filter(F.length("_tail") == F.least(F.length("_a"), three))
                   .join(by_tail, keys + ["_tail", "nxt"])
                   .filter(F.col("w").endswith(F.col("_a")))
                   .select(*keys, "needle", "w", "nxt",
                           (F.length("w") - F.length("_a")).alias("delta")))

    # Two words: the end of one word and the start of the next.
    two = n.filter("_m = 2").select(
        *keys, "needle", first.alias("_a"), second.alias("_b"),
        F.concat(tail3, F.lit(" "), F.substring(second, 1, 3)).alias("_edge"))
    edges = F.array(*[F.concat(_ends(F.col("w"), i), F.lit(" "), _starts(F.col("nxt"), j))
                      for i in (1, 2, 3) for j in (1, 2, 3)])
    by_edge = pairs.select(*keys, "w", "nxt", F.explode(F.array_compact(edges)).alias("_edge"))
    two_words = (two.join(by_edge, keys + ["_edge"])
                 .filter(F.col("w").endswith(F.col("_a")) & F.col("nxt").startswith(F.col("_b")))
                 .select(*keys, "needle", "w", "nxt",
                         (F.length("w") - F.length("_a")).alias("delta")))

    # One word: a part of a distinct word, found through the word's 1- to 3-character pieces.
    one = n.filter("_m = 1").select(*keys, "needle", F.substring("needle", 1, 3).alias("_gram"))

    def pieces(size: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length("w") - size + 1, F.lit(1)))
        return F.transform(places, lambda i: F.substr(F.col("w"), i, F.lit(size)))

    grams = F.flatten(F.array(*[pieces(size) for size in (1, 2, 3)]))
    by_gram = (pairs.select(*keys, "w").distinct()
               .select(*keys, "w", F.explode(F.array_distinct(grams)).alias("_gram")))
    length = F.length("needle")
    spots = F.filter(F.transform(
        F.sequence(F.lit(0), F.greatest(F.length("w") - length, F.lit(0))), lambda i: i),
        lambda i: F.substr(F.col("w"), i + 1, length) == F.col("needle"))
    one_word = (one.join(by_gram, keys + ["_gram"]).filter(F.col("w").contains(F.col("needle")))
                .select(*keys, "needle", "w", F.explode(spots).alias("delta"))
                .join(pairs.select(*keys, "w", "nxt"), keys + ["w"])
                .select(*keys, "needle", "w", "nxt", "delta"))
    # A job per quote length that occurs, not per length that could: at most four values.
    kinds = {r[0] for r in n.select(F.least("_m", F.lit(4))).distinct().collect()}
    parts = [part for kind, part in ((4, rarest), (3, three_words), (2, two_words), (1, one_word))
             if kind in kinds] or [rarest]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def occurrences(needles: DataFrame, rows: DataFrame, keys: list[str],
                payload: list[str], block: int = BLOCK) -> DataFrame:
    """All places where a needle occurs in the running text of its group.

    ``needles``: keys + needle (normalised, not blank). ``rows``: keys + row_id (dense) + text
    (normalised, not blank) + payload columns. The running text is the rows in order, joined by
    single spaces. Returns keys, needle, start and ``cover``, the ordered rows it touches.
    """
    needles = materialize(needles.select(*keys, "needle").distinct())
    rows = rows.select(*keys, "row_id", "text", *payload)
    placed = running_sum(rows, keys, "row_id", F.length("text") + 1, "at", block=block)
    # Read three times: for the word pairs, for the places, and for what lies across rows.
    placed = materialize(with_neighbours(
        placed, keys, "row_id", 0, 1,
        {"_next": lambda w: F.lead(F.split("text", " ").getItem(0)).over(w)}, block))
    index = _word_index(placed, keys, "_next")
    wanted = _lookups(needles, index, keys)
    # The row of the looked-up word is met first: most places lie wholly inside of it.
    spots = materialize(
        index.join(wanted, keys + ["w", "nxt"])
        .select(*keys, "needle", "row_id", (F.col("word_at") + F.col("delta")).alias("start"))
        .filter("start >= 0").join(placed.drop("_next"), keys + ["row_id"])
        .withColumn("_stop", F.col("start") + F.length("needle"))
        .withColumn("_inside", (F.col("start") >= F.col("at")) & (F.col("_stop") <= F.col("at") + F.length("text")))
        .withColumn("_piece", F.when(F.col("_inside"), F.substr("text", F.col("start") - F.col("at") + 1, F.length("needle"))))
        .filter(~F.col("_inside") | (F.col("_piece") == F.col("needle")))
        .select(*keys, "needle", "start", "_stop",
                F.when(F.col("_inside"), F.array(F.struct("row_id", "at", "text", *payload))).alias("cover")))
    within = spots.filter("cover is not null").select(*keys, "needle", "start", "cover")
    across = spots.filter("cover is null").select(*keys, "needle", "start", "_stop").distinct()

    def blocks(lo: Column, hi: Column) -> Column:
        return F.sequence(F.floor(lo / CHAR_BLOCK), F.floor((hi - 1) / CHAR_BLOCK))

    cut_spots = across.withColumn("_cb", F.explode(blocks(F.col("start"), F.col("_stop"))))
    cut_rows = (placed.drop("_next").withColumn("_end", F.col("at") + F.length("text"))
                .withColumn("_cb", F.explode(blocks(F.col("at"), F.col("_end")))))
    touching = (cut_spots.join(cut_rows, keys + ["_cb"])
                .filter((F.col("at") < F.col("_stop")) & (F.col("_end") > F.col("start")))
                # A pair can meet in several blocks; it counts in the first it shares.
                .filter(F.col("_cb") == F.floor(F.greatest("start", "at") / CHAR_BLOCK)))
    # At most as many rows as the quote has characters.
    cover = F.array_sort(F.collect_list(F.struct("row_id", "at", "text", *payload)))
    found = touching.groupBy(*keys, "needle", "start").agg(cover.alias("cover"))
    joined = F.array_join(F.transform("cover", lambda r: r["text"]), " ")
    inside = F.substr(joined, F.col("start") - F.col("cover")[0]["at"] + 1, F.length("needle"))
    return within.unionByName(found.filter(inside == F.col("needle")))


def rows_containing(needles: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, needle, row_id) where the needle occurs within one row's text."""
    needles = materialize(needles.select(*keys, "needle").distinct())
    placed = rows.select(*keys, "row_id", "text").withColumn("at", F.lit(0))
    index = _word_index(placed, keys, None)
    wanted = _lookups(needles, index, keys)
    pairs = (index.join(wanted, keys + ["w", "nxt"]).select(*keys, "needle", "row_id").distinct())
    return (pairs.join(placed, keys + ["row_id"])
            .filter(F.col("text").contains(F.col("needle"))).select(*keys, "needle", "row_id"))


def first_and_unique(found: DataFrame, keys: list[str]) -> DataFrame:
    """Per needle: its first place, and whether non-overlapping counting finds only one."""
    return (found.groupBy(*keys, "needle")
            .agg(F.min("start").alias("start"), F.max("start").alias("_last"),
                 F.min_by("cover", "start").alias("cover"))
            .withColumn("is_unique", F.col("_last") < F.col("start") + F.length("needle"))
            .drop("_last"))
