"""Registered queries of the numbered operators: name -> (callable(spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martweave.functions.scale import new_path, stage
from martweave.llm import decontamination, jaccard, licenses, mixing, privacy, quality, ranking, scoring, sharding, substrings, tokens, vectors, warc
from martweave.llm.sql import SQL

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SHARDS = 8


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def op1_token_counts(spark: SparkSession, root: str) -> DataFrame:
    """Four batches over all documents: first counts, moved and deleted documents, a recount, and a replayed batch."""
    docs = table(spark, root, "documents")
    counted = stage(tokens.token_counts(docs.select("doc_id", "source", "lang", "text", mixing.word_count(F.col("text")).alias("words")), VOCABULARY), "tokens")
    none = F.lit(None).cast("long")
    rollup = tokens.TokenRollup(spark, new_path(spark, "rollup"))
    words = counted.withColumn("tokenizer", F.lit("words"))
    first = words.select(F.lit("insert").alias("kind"), *tokens.KEYS, none.alias("before"), F.col("words").alias("after"))
    rollup.apply("words", first)
    subword = counted.withColumn("tokenizer", F.lit("byte_bpe_50k"))
    rollup.apply("subwords", subword.select(F.lit("insert").alias("kind"), *tokens.KEYS, none.alias("before"), F.col("words").alias("after")))
    # The first subword counts were estimates by words; the revision brings the true ones.
    rollup.apply("recount", subword.select(F.lit("revise").alias("kind"), *tokens.KEYS, F.col("words").alias("before"), F.col("tokens").alias("after")))
    toxic = table(spark, root, "labels").filter("toxic = 1").select("doc_id").distinct()
    rollup.apply("withdrawn", words.join(toxic, "doc_id", "left_semi").select(
        F.lit("delete").alias("kind"), *tokens.KEYS, F.col("words").alias("before"), none.alias("after")))
    rollup.apply("words", first)
    rollup.compact()
    return rollup.current()


def op2_warc(spark: SparkSession, root: str) -> DataFrame:
    return warc.round_trip(table(spark, root, "pages"))


def op3_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, root, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")


def op4_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    judged = quality.apply_rules(table(spark, root, "documents"), table(spark, root, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_privacy(spark: SparkSession, root: str) -> DataFrame:
    return privacy.report(privacy.protect(table(spark, root, "documents")))


def op6_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    return substrings.dedup(table(spark, root, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_sharding(spark: SparkSession, root: str) -> DataFrame:
    placed = sharding.shard(table(spark, root, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_lm_scoring(spark: SparkSession, root: str) -> DataFrame:
    return scoring.score(table(spark, root, "documents"))


def op9_decontamination(spark: SparkSession, root: str) -> DataFrame:
    return decontamination.contaminated(table(spark, root, "documents"), table(spark, root, "benchmark"))


def op10_mixing(spark: SparkSession, root: str) -> DataFrame:
    mixed = mixing.mix(table(spark, root, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_license_scan(spark: SparkSession, root: str) -> DataFrame:
    return licenses.scan(table(spark, root, "documents"))


def op12_ranked_search(spark: SparkSession, root: str) -> DataFrame:
    return ranking.search(table(spark, root, "documents"), table(spark, root, "benchmark"))


def op13_vector_codes(spark: SparkSession, root: str) -> DataFrame:
    return vectors.compress(table(spark, root, "embeddings")).drop("label")


FUNCTIONS = [op1_token_counts, op2_warc, op3_jaccard_join, op4_quality_rules, op5_privacy, op6_substring_dedup, op7_sharding, op8_lm_scoring, op9_decontamination, op10_mixing, op11_license_scan, op12_ranked_search, op13_vector_codes]
QUERIES = {f.__name__: (f, SQL.get(f.__name__)) for f in FUNCTIONS}
