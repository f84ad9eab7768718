"""Ranks, lags and running sums with a hot key and many copies, against plain Python."""

from collections import defaultdict
from types import SimpleNamespace

import pytest

from pyspark.sql import functions as F

from martweave.functions import scale
from tests.conftest import rows


def skewed(spark, partitions=7):
    """A third of 9,000 rows share key 0, many of them exact copies."""
    df = spark.range(0, 9000, 1, partitions).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"),
        (F.col("id") * 7919 % 1000).cast("int").alias("v"))
    return scale.number_copies(df, "copy")


def many_chunks(spark, fn):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return fn()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_rank_splits_a_hot_key(spark):
    data = skewed(spark)
    chunks = many_chunks(spark, lambda: scale.ordered_chunks(data, ["k"], ["v", "copy"]))
    assert chunks.filter("k = 0").select("_chunk").distinct().count() > 1
    ranked = many_chunks(spark, lambda: rows(scale.grouped_rank(data, ["k"], ["v", "copy"], "r"), "k", "v", "r"))
    groups = defaultdict(list)
    for k, v in rows(data, "k", "v"):
        groups[k].append(v)
    expected = [(k, v, i + 1) for k, vs in groups.items() for i, v in enumerate(sorted(vs))]
    assert sorted(ranked) == sorted(expected)


def test_rank_without_keys_is_dense_and_ordered(spark):
    data = skewed(spark)
    ranked = many_chunks(spark, lambda: rows(scale.grouped_rank(data, [], ["v", "k", "copy"], "r"), "r", "v", "k"))
    ranked.sort()
    assert [r[0] for r in ranked] == list(range(1, 9001))
    assert [(r[1], r[2]) for r in ranked] == sorted((v, k) for k, v in rows(data, "k", "v"))


def test_running_sum_over_copies(spark):
    data = skewed(spark).withColumn("one", F.lit(1))
    got = many_chunks(spark, lambda: rows(
        scale.grouped_running_sum(data, ["k"], ["v", "copy"], F.col("one"), "s").groupBy("k").agg(
            F.max("s").alias("m"), F.count_distinct("s").alias("d"))))
    sizes = {k: n for k, n in rows(data.groupBy("k").count())}
    assert got == sorted(((k, n, n) for k, n in sizes.items()), key=repr)


def test_lag_crosses_chunks(spark):
    data = spark.range(0, 5000, 1, 5).select(
        F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 10).alias("k"), F.col("id").alias("at"))
    got = many_chunks(spark, lambda: rows(scale.grouped_lag(data, ["k"], ["at"], "at", "prev"), "k", "at", "prev"))
    last, expected = {}, []
    for k, at in sorted(rows(data, "k", "at"), key=lambda r: r[1]):
        expected.append((k, at, last.get(k)))
        last[k] = at
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_shared_folder_is_the_configured_one():
    def session(master, configured):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: configured if key == "spark.checkpoint.dir" else default),
            sparkContext=SimpleNamespace(master=master, applicationId="app"))

    assert scale.shared_folder(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        scale.shared_folder(session("yarn", None))


def test_staged_tables_can_be_released(spark):
    import os

    df = scale.stage(spark.range(3), "gone")
    path = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert os.path.isdir(path) and scale.release(spark) >= 1 and not os.path.exists(path)
    assert scale.release(spark) == 0
