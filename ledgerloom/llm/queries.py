"""Registered corpus queries and their oracle SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    chat_format,
    cross_polytope,
    decontaminate,
    embedding_dedup,
    language_id,
    mixing,
    ngram_join,
    periodic_runs,
    quality_rules,
    ring_sharding,
    secret_scan,
    suffix_dedup,
    turn_repair,
)
from ledgerloom.llm.shared import staged, word_count


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """Whether a document belongs to the held-out fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op1_embedding_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return embedding_dedup.near_dedup(table(spark, directory, "embeddings"))


def op2_mix_sources(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents").select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        mixing.quality_weight(F.col("text")).alias("weight"),
    )
    return mixing.mix(staged(docs, "sizes")).select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents").select("doc_id", "text")
    model = quality_rules.train(docs, table(spark, directory, "labels"), ~held_out())
    scored = quality_rules.score(docs, model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"),
        F.when(F.col("quality_score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op4_ngram_join(spark: SparkSession, directory: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, directory, "documents"))


def op5_decontaminate(spark: SparkSession, directory: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, directory, "documents"), table(spark, directory, "benchmark"))
    return found.where("contaminated")


def op6_secret_scan(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    found = staged(secret_scan.candidates(docs), "candidates")
    found = staged(secret_scan.with_features(found, secret_scan.dictionary(docs)), "features")
    # The tables hold no labelled findings; labels are set where the form leaves no doubt.
    forest = secret_scan.fit(found.withColumn("label", secret_scan.weak_label()))
    return secret_scan.scan(found, forest).select("doc_id", "place", "value", "score", "is_secret")


def op7_language_id(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    net = language_id.train(language_id.labelled_sample(docs, ~held_out()))
    found = language_id.identify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op8_ring_sharding(spark: SparkSession, directory: str) -> DataFrame:
    return ring_sharding.manifest(table(spark, directory, "documents"))


def op9_suffix_dedup(spark: SparkSession, directory: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, directory, "documents"))
    # The text that is left; a span may end inside a character, whose other bytes become U+FFFD.
    return found.withColumn("kept_text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op10_chat_format(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    return chat_format.digests(chat_format.format_turns(rows.unionByName(extra)))


def op11_periodic_runs(spark: SparkSession, directory: str) -> DataFrame:
    docs = periodic_runs.replayed(table(spark, directory, "documents"))
    return periodic_runs.digests(periodic_runs.periodic_runs(docs))


def op12_cross_polytope(spark: SparkSession, directory: str) -> DataFrame:
    return cross_polytope.nearest(table(spark, directory, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_turn_repair(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "conversations")
    edited, found = turn_repair.repair(turn_repair.damaged(rows))
    ids = rows.select("conv_id").distinct()
    out = ids
    for part in (found, turn_repair.digests(edited)):
        part = part.withColumnRenamed("conv_id", "_id")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    nothing = hashlib.sha256().hexdigest()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.fillna(0, counts).fillna({"audit": "", "repaired_sha256": nothing})


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_dedup, op2_mix_sources, op3_quality_rules, op4_ngram_join, op5_decontaminate,
        op6_secret_scan, op7_language_id, op8_ring_sharding, op9_suffix_dedup, op10_chat_format, op11_periodic_runs,
        op12_cross_polytope, op13_turn_repair,
    )
}

ORACLE = {
    "op2_mix_sources": """
WITH sized AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    coalesce((length(regexp_replace(text, '[^A-Za-z]', '', 'g')) + 1)::DOUBLE / (length(text) + 1), 1.0) AS weight,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 3.0::DOUBLE * source_size / w AS level,
    row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source COLLATE "C" NULLS LAST) AS k FROM sources),
rest AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT
      - 3 * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS words_left,
    (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weight_left FROM levels),
cut AS (SELECT min(k) AS k FROM rest WHERE level >= words_left::DOUBLE / weight_left),
goals AS (
  SELECT source, source_size,
    CASE WHEN k < (SELECT k FROM cut) THEN 3.0::DOUBLE * source_size
      ELSE (SELECT words_left::DOUBLE / weight_left FROM rest WHERE k = (SELECT k FROM cut)) * w END AS target FROM rest),
keyed AS (
  SELECT s.*, g.source_size, g.target,
    CASE WHEN g.source_size = 0 THEN 0 ELSE floor(g.target / g.source_size)::BIGINT END AS epochs, -ln(u) / weight AS key
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
runs AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM keyed)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN 2 * run - size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM runs
""",
}
