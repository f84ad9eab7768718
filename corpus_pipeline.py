"""A corpus pipeline: rules, near duplicates, benchmark passages, mixture, shards.

Every stage reads all that its predecessor kept, written as Parquet, and returns the
columns of ``documents``; the last adds the shards. Nulls, repeated rows, empty tables and
extra columns are handled as the operators' docstrings say; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martweave.functions.scale import stage
from martweave.llm import decontamination, jaccard, mixing, packed, quality, sharding

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 8
SHINGLE, PERCENT = 5, 80

ORACLE_SQL = None  # fitted cutoffs, tilings and hashed samples have no SQL; see tests/llm/test_pipeline.py


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified cutoff go."""
    metrics = quality.text_metrics(docs, tuple(COLUMNS))
    fitted = stage(quality.text_metrics(docs, ("doc_id", "lang")), "pipeline-metrics")
    cutoffs = quality.fit_thresholds(fitted, _table(spark, sf_dir, "labels"), "lang")
    return quality.judge(metrics, cutoffs, "lang").filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near copies, the document with the smallest id stays; of repeated rows, one."""
    found = stage(jaccard.jaccard_join(docs, SHINGLE, PERCENT).withColumn("k", F.coalesce("doc_id", F.lit(packed.LAST))), "pipeline-components")
    first = found.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("k", "tag")).alias("first")).select("first.*")
    keep = stage(first.union(found.filter("component IS NULL").select("k", "tag").distinct()), "pipeline-keep")
    return packed.named(docs, COLUMNS).join(keep, ["k", "tag"]).dropDuplicates(["k", "tag"]).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go."""
    judged = decontamination.find_overlaps(docs, _table(spark, sf_dir, "benchmark"), keep=tuple(COLUMNS))
    return judged.filter("n_items = 0").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    own = docs.select(*COLUMNS)
    taken = mixing.mix(own).filter("copies > 0").groupBy("doc_id", "source", "size", "_crc").agg(F.max("copies").alias("_copies"))
    keyed = own.withColumns({"_size": mixing.word_count(F.col("text")), "_c": F.crc32(F.coalesce("text", F.lit("")).cast("binary"))})
    t = stage(taken, "pipeline-taken").withColumnsRenamed({"doc_id": "_id", "source": "_s", "size": "_n"})
    match = (F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_s"))
             & (F.col("_size") == F.col("_n")) & (F.col("_c") == F.col("_crc")))
    rows = keyed.join(t, match).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return rows.select(*COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, text_crc32, shard, slot and grown_shard."""
    return sharding.shard(docs, SHARDS, keep=COLUMNS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("mixture", mixture),
    ("shards", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
