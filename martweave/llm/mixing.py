"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target number of words. Whole epochs come first: as many copies of
all its documents as fit. The rest is chosen by exponential keys ``-ln(u) / weight``,
where ``u`` is a hash of the document id (so reruns agree) and ``weight`` is the
document's quality: documents in ascending key order are taken while their words fit,
and of the one that crosses the budget as many words as are left. So every source gives
its target to the word. ``copies`` rounds a part of a document to the whole or nothing.

Targets share all words in proportion to the weights, but stop at ``most_epochs`` times
the words of their source; what is left over is shared again by weight. That is the
level at which the sources' capped shares add up to all words, found by one pass over
the sources in the order in which they reach their cap.

A null source is a source of its own, the last. A null or empty text has no words and is
never needed; it is taken 0 times. Weights below ``least_weight``, null ones included,
count as ``least_weight``. Repeated rows are separate documents. Running sums are kept in
range partitions, so one source may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martweave.functions.scale import grouped_rank, grouped_running_sum, stage

WORD = r"[^\x20\x09-\x0D]+"
MOST_EPOCHS = 3
LEAST_WEIGHT = 0.01


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of characters that are no digits or symbols."""
    kept = F.length(F.translate(text, "0123456789#*$%&|<>{}[]=_~^\\", ""))
    return F.when(F.length(text) > 0, kept / F.length(text)).otherwise(F.lit(0.0))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Sources in code point order, null last, take ``weights`` in turn.
    """
    named = sizes.withColumns({"_null": F.col("source").isNull(), "_name": F.coalesce("source", F.lit(""))})
    placed = grouped_rank(named, [], ["_null", "_name"], "_turn")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_turn") - 1) % len(weights) + 1).cast("int"))
    full = placed.withColumn("weight", turn).withColumn("_cap", F.col("source_size") * most_epochs).withColumn(
        "_ratio", F.col("_cap") / F.col("weight"))
    # Sources fill up in the order of cap / weight; in thousandths of a weight the sums stay whole numbers.
    order = ["_ratio", "_turn"]
    sums = grouped_running_sum(full.withColumn("_w", F.round(F.col("weight") * 1000).cast("long")), [], order, F.col("_cap"), "_caps")
    sums = stage(grouped_running_sum(sums, [], order, F.col("_w"), "_weights"), "mix-levels")
    all_words, all_weights = sums.agg(F.sum("source_size"), F.sum("_w")).first()
    if not all_words:
        return sums.select("source", "source_size", "weight", F.lit(0.0).alias("target"))
    # The level if all sources before this one stand at their caps and this one shares what is left.
    left = F.lit(all_words) - F.col("_caps") + F.col("_cap")
    free = F.lit(all_weights) - F.col("_weights") + F.col("_w")
    levels = sums.withColumn("_level", left * 1000 / free)
    level = levels.filter("_level <= _ratio").orderBy(*order).select("_level").first()[0]
    return sums.select("source", "source_size", "weight",
                       F.least(F.col("_cap").cast("double"), F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, weight: Column | None = None, weights: tuple[float, ...] = (1.0, 2.0, 3.0),
        most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken words, whole copies) for every row of ``docs``."""
    quality = F.greatest(F.coalesce(weight if weight is not None else quality_weight(F.col("text")), F.lit(0.0)), F.lit(LEAST_WEIGHT))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / float((1 << 52) + 1)
    rows = stage(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        (-F.log(uniform) / quality).alias("_key"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("_crc")), "mix-rows")
    sizes = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    targets = stage(source_targets(sizes, weights, most_epochs), "mix-targets").withColumnRenamed("source", "_source")
    ordered = grouped_running_sum(rows, ["source"], ["_key", "doc_id", "_crc", "size"], F.col("size"), "_sum")
    budgeted = ordered.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = F.floor(F.col("target") - F.col("_epochs") * F.col("source_size") + 0.5)
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - (F.col("_sum") - F.col("size"))))
    copies = F.col("_epochs") + F.when((F.col("_part") > 0) & (2 * F.col("_part") >= F.col("size")), F.lit(1)).otherwise(F.lit(0))
    return budgeted.withColumn("_epochs", epochs).withColumn("_part", part).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("_epochs") + F.col("_part")).cast("long").alias("taken"),
        copies.cast("int").alias("copies"), "_crc")
