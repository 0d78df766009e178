"""One query per operator of this subpackage, over its whole table, and the SQL they are compared with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    html_extract,
    language_id,
    mixing,
    ngram_join,
    periodic_runs,
    quality,
    repair,
    secret_scan,
    sharding,
    vector_search,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark, d) -> DataFrame:
    units = mixing.queue_units(table(spark, d, "documents"))
    return mixing.fair_mix(units).select(
        "doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size")).alias("taken"))


def _joined_spans(findings: Column) -> Column:
    text = lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))
    return F.array_join(F.transform(findings, text), ",")


def op2_secret_scan(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    findings = F.col("findings")
    base = F.filter(findings, lambda f: f["kind"] != "model")
    count = lambda kind: F.size(F.filter(findings, lambda f: f["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return secret_scan.find_secrets(docs, secret_scan.train(docs)).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_joined_spans(base), 256).alias("base_sha256"), _joined_spans(findings).alias("spans"))


def op3_vector_search(spark, d) -> DataFrame:
    return vector_search.nearest(table(spark, d, "embeddings"))


def op4_exact_dedup(spark, d) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, d, "documents"))


def op5_byte_bpe(spark, d) -> DataFrame:
    return bpe.encoded_digests(table(spark, d, "documents"), public_tokenizers.path(corpus_pipeline.RANKS),
                               public_tokenizers.PATTERN)


def op6_ngram_jaccard(spark, d) -> DataFrame:
    return ngram_join.components(table(spark, d, "documents"))


def op7_sharding(spark, d) -> DataFrame:
    return sharding.shard_rows(table(spark, d, "documents"))


def op8_quality(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    scored = quality.score_documents(docs, quality.train(docs, table(spark, d, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op9_language_id(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    return language_id.predict(docs, language_id.train(docs), ["doc_id"]).select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_html_extract(spark, d) -> DataFrame:
    return html_extract.extract_pages(table(spark, d, "pages"))


def hits_of_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row of counts and the digest of the items per document."""
    found = decontaminate.contamination(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.end - s.begin)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


def op11_decontaminate(spark, d) -> DataFrame:
    return hits_of_documents(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op12_repair(spark, d) -> DataFrame:
    rows = table(spark, d, "conversations")
    return repair.report(repair.damaged(rows), rows)


def runs_of_documents(docs: DataFrame) -> DataFrame:
    """One row of digests per document, of whose texts one in ten gets a repeated tail."""
    found = periodic_runs.find_runs(docs, ["doc_id"], periodic_runs.with_repeated_tails(docs))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.start.alias("start"), best.length.alias("length"),
        best.period.alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_periodic_runs(spark, d) -> DataFrame:
    return runs_of_documents(table(spark, d, "documents"))


def pipeline(spark, d) -> DataFrame:
    return corpus_pipeline.run(spark, d)


QUERIES = {f.__name__: f for f in (
    op1_mixing, op2_secret_scan, op3_vector_search, op4_exact_dedup, op5_byte_bpe, op6_ngram_jaccard, op7_sharding,
    op8_quality, op9_language_id, op10_html_extract, op11_decontaminate, op12_repair, op13_periodic_runs, pipeline)}

ORACLES = {
    "op1_mixing": r"""
WITH units AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS skey,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM units GROUP BY skey
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY skey = '', skey) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight,
         source_size * 3 AS lim
  FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, skey
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY lim / weight, skey
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT skey, source_size, least(lim::DOUBLE,
         (SELECT max(level) FROM levels WHERE lim / weight >= level) * weight) AS target
  FROM levels
), passes AS (
  SELECT u.*, t.source_size, t.target, unnest(range(0, CAST(least(
           coalesce(floor(target / nullif(source_size, 0)), 0), 2) AS INT) + 1)) AS epoch
  FROM units u JOIN targets t USING (skey)
), keyed AS (
  SELECT *, substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(epoch AS VARCHAR)), 1, 16) AS key
  FROM passes
), queued AS (
  SELECT *, coalesce((epoch * source_size + sum(size) OVER (PARTITION BY skey, epoch ORDER BY key, doc_id, size
              ROWS UNBOUNDED PRECEDING))::DOUBLE / nullif(target, 0), 0) AS finish
  FROM keyed
), reached AS (
  SELECT *, sum(size) OVER (ORDER BY finish, skey, epoch, key, doc_id, size ROWS UNBOUNDED PRECEDING)
            <= (SELECT sum(source_size) FROM sources) AS chosen
  FROM queued
)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN chosen THEN size ELSE 0 END) AS BIGINT) AS taken
FROM reached GROUP BY doc_id, size, source_size, target""",
    "op4_exact_dedup": """
SELECT doc_id, keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id
      FROM documents) d""",
    "op11_decontaminate": r"""
WITH docs AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), starts AS (
  SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM starts
), places AS (
  SELECT uid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) s WHERE len(w) >= k
), grams AS (
  SELECT uid, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram FROM places
), occurring AS (
  SELECT uid, item, k, i FROM grams JOIN windows USING (k, gram)
), covered AS (
  SELECT uid, count(DISTINCT place) AS n_hit
  FROM (SELECT uid, unnest(range(i, i + k)) AS place FROM (SELECT DISTINCT uid, k, i FROM occurring) d) c GROUP BY uid
), named AS (
  SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT uid, item FROM occurring) d GROUP BY uid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (uid) LEFT JOIN named USING (uid)""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
