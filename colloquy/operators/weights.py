"""Term weights on long tables: tf-idf, keywords, phrases and labels."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.functions import vocab as V
from colloquy.operators import groups
from colloquy.plans.ordered import top_k
from colloquy.plans.runtime import has_rows, materialize

BREAKING_TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_ \t\n\r\f]"


def ngrams(tokens: Column, sizes: tuple[int, ...]) -> Column:
    """All sequences of the given lengths; elements are read by place, as slicing copies."""
    def of_size(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.concat_ws(
            " ", *[F.get(tokens, i + k) for k in range(n)]))
        return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[of_size(n) for n in sizes]))


def tfidf(docs: DataFrame, keys: list[str], doc: str, sizes: tuple[int, ...] = (1, 2),
          max_features: int = 5000) -> DataFrame:
    """Row-normalised weights (keys, doc, term, w) of ``docs`` (keys, doc, tokens).

    tf' = 1 + ln tf, idf = ln((1+n)/(1+df)) + 1, rows of length one. Only the ``max_features``
    most frequent terms of each group count (ties by term).
    """
    counts = materialize(term_counts(docs, keys, doc, sizes))  # read for the vocabulary and for the weights
    size = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    vocabulary = materialize(counts.groupBy(*keys, "term").agg(
        F.count(F.lit(1)).alias("_df"), F.sum("tf").alias("_total")))
    rich = materialize(vocabulary.groupBy(*keys).agg(F.count(F.lit(1)).alias("_v"))
                       .filter(F.col("_v") > max_features).select(*keys))
    kept = vocabulary
    if has_rows(rich):
        frequent = top_k(vocabulary.join(rich, keys, "left_semi"), keys,
                         [F.desc("_total"), F.asc("term")], max_features, ["term"]).drop("rank")
        kept = vocabulary.join(rich, keys, "left_anti").unionByName(frequent)
    idf = kept.join(size, keys).select(
        *keys, "term", (F.log((F.col("_n") + 1) / (F.col("_df") + 1)) + 1).alias("_idf"))
    raw = counts.join(idf, keys + ["term"]).select(
        *keys, doc, "term", ((F.log(F.col("tf").cast("double")) + 1) * F.col("_idf")).alias("_w"))
    # A window over one document's terms, so its partitions stay as small as a document.
    own = Window.partitionBy(*keys, doc)
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(own))
    return raw.withColumn("w", F.col("_w") / length).drop("_w")


def term_counts(docs: DataFrame, keys: list[str], doc: str, sizes: tuple[int, ...]) -> DataFrame:
    """(keys, doc, term, tf), counted inside each row: sorted terms, lengths of equal runs."""
    rows = docs.filter(F.size("tokens") >= min(sizes)).select(
        *keys, doc, F.sort_array(ngrams(F.col("tokens"), sizes)).alias("_g"))
    rows = rows.withColumn("_starts", F.filter(
        F.sequence(F.lit(0), F.size("_g") - 1),
        lambda i: (i == 0) | (F.get("_g", i) != F.coalesce(F.get("_g", i - 1), F.lit("")))))
    runs = F.transform("_starts", lambda at, j: F.struct(
        F.get("_g", at).alias("term"),
        (F.coalesce(F.get("_starts", j + 1), F.size("_g")) - at).cast("bigint").alias("tf")))
    return rows.select(*keys, doc, F.explode(runs).alias("_r")).select(*keys, doc, "_r.*")


def keywords(docs: DataFrame, keys: list[str], doc: str, top: int = 20,
             max_features: int = 5000, skip: list[str] | None = None, whole: int = groups.WHOLE) -> DataFrame:
    """A14. Terms with the highest summed weight per group (ties by term); tokens are words, so none is empty or holds a blank."""
    rows = materialize(docs.select(*keys, doc, "tokens"))
    small, large = groups.by_size(rows, keys, F.greatest(F.size("tokens"), F.lit(0)), whole)
    scores = _scores(groups.dealt_words(small, keys, doc, "tokens"), keys, doc, top, max_features, skip)
    if large is not None:
        scores = scores.unionByName(_joined_scores(large, keys, doc, max_features, skip))
    return top_k(scores, keys, [F.desc("score"), F.asc("term")], top, ["term"])


def _scores(dealt: DataFrame, keys: list[str], doc: str, top: int, max_features: int, skip: list[str] | None) -> DataFrame:
    """keys, term, score from rows that lie by group, of the terms that can be among the first ``top``."""
    types = dict(dealt.dtypes)
    return dealt.mapInArrow(
        groups.best_terms(keys, doc, top, max_features, skip),
        ", ".join([*[f"{k} {types[k]}" for k in keys], "term string, raw double"])).select(*keys, "term", F.round("raw", 6).alias("score"))


def _joined_scores(docs: DataFrame, keys: list[str], doc: str, max_features: int, skip: list[str] | None) -> DataFrame:
    scores = (tfidf(docs, keys, doc, (1, 2), max_features).groupBy(*keys, "term")
              .agg(F.round(F.sum("w"), 6).alias("score")))
    return scores.filter(~F.col("term").isin(skip) & (F.length("term") > 2)) if skip else scores


def _good(t: Column) -> Column:
    return t.rlike(r"^\p{L}{2,}$") & ~F.lower(t).isin(V.TOPIC_STOP)


def phrase_words(sentences: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, order, words of each sentence; those that no phrase may hold are blanks."""
    tokens = F.regexp_extract_all("sentence", F.lit(BREAKING_TOKEN), 0)
    return sentences.select(*keys, order, F.transform(
        tokens, lambda t: F.when(_good(t), t).otherwise(F.lit(""))).alias("words"))


def phrases(sentences: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Candidate phrases: two to five neighbouring content words, first wording kept."""
    return phrases_of(materialize(phrase_words(sentences, keys, order)), keys, order)


def phrases_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The phrases of the sentences of ``phrase_words``."""
    rows = rows.select(*keys, order, F.col("words").alias("_t")).filter(F.size("_t") >= 2)
    rows = rows.withColumn("_ok", F.transform("_t", lambda t: t != ""))

    def of_size(n: int) -> Column:
        last = F.size("_t") - n
        starts = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: functools.reduce(
            lambda a, b: a & b, [F.coalesce(F.get("_ok", i + k), F.lit(False)) for k in range(n)]))
        return F.transform(starts, lambda i: F.struct(
            i.alias("at"), F.lower(F.get("_t", i + n - 1)).alias("tail"),
            F.concat_ws(" ", *[F.get("_t", i + k) for k in range(n)]).alias("label")))

    # Phrases are formed inside the row, so no row carries its whole token list along.
    grams = (rows.select(*keys, order, F.explode(F.flatten(F.array(
        *[of_size(n) for n in (2, 3, 4, 5)]))).alias("_p"))
        .select(*keys, order, "_p.at", "_p.tail", "_p.label")
        .filter(~F.col("tail").isin(V.PHRASE_TAIL)))
    return (grams.groupBy(*keys, F.lower("label").alias("phrase"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.min_by("label", F.struct(order, "at")).alias("label")))


# A phrase can only be dropped for one that holds all its words, and phrases made of the at most
# five words of each selected phrase are at most 5**2 + ... + 5**5 in number.
HELD_PHRASES = sum(5 ** n for n in (2, 3, 4, 5))


def _unrepeated(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Phrases whose words are not all words of a higher-ranked one, by a join on word sets."""
    def picked(mask: Column) -> Column:
        chosen = F.filter("_words", lambda w, i: F.floor(mask / F.pow(F.lit(2.0), i)) % 2 == 1)
        return F.array_join(chosen, " ")

    # Every set of a phrase's words (five words at most, so 31 sets at most).
    subsets = F.transform(F.sequence(F.lit(1), F.pow(F.lit(2.0), F.size("_words")).cast("int") - 1),
                          picked)
    holders = (ranked.select(*keys, "rank", F.explode(subsets).alias("_set"))
               .groupBy(*keys, "_set").agg(F.min("rank").alias("_best")))
    own = ranked.withColumn("_set", F.array_join("_words", " "))
    return (own.join(holders, keys + ["_set"]).filter(F.col("_best") == F.col("rank"))
            .drop("_set", "_best", "_words"))


def discussion_topics(sentences: DataFrame, keys: list[str], order: str, limit: int = 5,
                      head: int = 64, whole: int = groups.WHOLE) -> DataFrame:
    """K2. Top phrases, none of which only repeats words of a higher one.

    Ranked by count, then words, then label. A phrase is dropped when a higher-ranked phrase
    holds all of its words; since being held is transitive this equals the one-by-one selection.
    Whether a phrase is dropped depends on the ranks above it only, so the first ``head`` phrases
    of a group settle it; groups they do not settle are looked at as far as it can take.
    """
    rows = materialize(phrase_words(sentences, keys, order))
    small, large = groups.by_size(rows, keys, F.greatest(F.size("words"), F.lit(0)), whole)
    types = dict(rows.dtypes)
    by = [F.desc("n"), F.desc(F.size(F.split("phrase", " "))), F.asc("label"), F.asc("phrase")]
    lowered = F.transform("words", lambda w: F.lower(w)).alias("lowered")
    kept = groups.dealt_words(small, keys, order, "words").select(*keys, "words", lowered).mapInArrow(
        groups.best_phrases(keys, limit, head, V.PHRASE_TAIL),
        ", ".join([*[f"{k} {types[k]}" for k in keys], "label string, phrase string, n bigint, total bigint"]))
    if large is not None:
        total = large.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
        kept = kept.unionByName(_ranked(phrases_of(large, keys, order), keys, by, limit, head).join(total, keys).select(*kept.columns))
    return top_k(kept, keys, by, limit, ["phrase"]).select(
        *keys, "rank", "label", "phrase", "n",
        F.round(F.col("n") / F.col("total"), 4).alias("relevance"))


def _ranked(found: DataFrame, keys: list[str], by: list[Column], limit: int, head: int) -> DataFrame:
    """Phrases of groups too large for one task: enough of those that repeat no better one."""
    found = materialize(found.withColumn("_words", F.array_sort(F.array_distinct(F.split("phrase", " ")))))
    first = top_k(found, keys, by, head, ["phrase"])
    kept = _unrepeated(first, keys)
    settled = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    sizes = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    open_groups = materialize(sizes.join(settled, keys).filter(
        (F.col("_k") < limit) & (F.col("_size") > head)).select(*keys))
    if has_rows(open_groups):
        rest = top_k(found.join(open_groups, keys, "left_semi"), keys, by,
                     limit * (HELD_PHRASES + 1), ["phrase"])
        kept = kept.join(open_groups, keys, "left_anti").unionByName(_unrepeated(rest, keys))
    return kept.drop("rank")


def topic_labels(sentences: DataFrame, keys: list[str], order: str, whole: int = groups.WHOLE) -> DataFrame:
    """M8. Most frequent phrase (longest on ties), else two keywords, else a fixed label."""
    def tokens(rows: DataFrame) -> DataFrame:
        return rows.select(*keys, order, X.content_words("sentence", V.FUNCTION_WORDS).alias("tokens"))

    sentences = materialize(sentences.select(*keys, order, "sentence"))
    small, large = groups.by_size(sentences, keys, F.length("sentence"), whole)  # its words are not more than its characters
    there, types = groups.dealt(small, keys, order, "sentence"), dict(sentences.dtypes)  # once, for phrases and keywords
    lowered = F.transform("words", lambda w: F.lower(w)).alias("lowered")
    best = phrase_words(there, keys, order).select(*keys, "words", lowered).mapInArrow(
        groups.most_said(keys, V.PHRASE_TAIL), ", ".join([*[f"{k} {types[k]}" for k in keys], "phrase string"])).withColumnRenamed("phrase", "_phrase")
    scores = _scores(tokens(there), keys, order, 6, 2000, V.LABEL_STOP)
    if large is not None:
        best = best.unionByName(phrases(large, keys, order).groupBy(*keys).agg(F.max_by("phrase", F.struct(
            "n", F.length("phrase"), "phrase")).alias("_phrase")))
        scores = scores.unionByName(_joined_scores(tokens(large), keys, order, 2000, V.LABEL_STOP))
    words = top_k(scores, keys, [F.desc("score"), F.asc("term")], 6, ["term"])
    listed = words.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda r: r["term"])
        .alias("keywords"))
    pair = F.array_join(F.slice("keywords", 1, 2), " & ")
    return (sentences.select(*keys).distinct().join(best, keys, "left").join(listed, keys, "left")
            .select(*keys, F.coalesce(F.initcap("_phrase"), X.blank_to_null(F.initcap(pair)),
                                      F.lit("General Discussion")).alias("label"),
                    F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), ", ")
                    .alias("keywords")))
