"""Sharding by jump consistent hashing.

A stable key and the number of shards decide the shard, without a table of ring points.
When one more shard is added, a row either stays or moves into the new shard, and about
one row in (shards + 1) moves. Slots number the rows of a shard from 0 without gaps, in
the order of the key; they are counted in range partitions, so one shard may hold any
share of the rows.

A null key is a key of its own. A null text is empty: size 1, CRC 0. Rows that repeat a
key share its shard and get slots of their own. Other columns pass unchanged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martweave.functions.scale import grouped_rank, new_path

MULTIPLIER = np.uint64(2862933555777941757)  # fixed value of the published algorithm


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key: the last jump that stays below ``shards``."""
    key = keys.astype(np.uint64).copy()
    at = np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    ahead = np.zeros(len(key), np.int64)
    while len(going):
        at[going] = ahead
        key[going] = key[going] * MULTIPLIER + np.uint64(1)
        scale = float(1 << 31) / ((key[going] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead = ((at[going] + 1) * scale).astype(np.int64)
        on = ahead < shards
        going, ahead = going[on], ahead[on]
    return at


def stable_key(column: Column) -> Column:
    """16 hexadecimal digits that depend on the key's text alone."""
    return F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, 16)


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(np.array([int(k, 16) for k in keys], np.uint64), shards), dtype="int32")

    return jump(key)


def shard(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, size, text_crc32, shard, slot, grown_shard): where every row goes, now and with one more shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        key, *[c for c in keep if c != key], (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), stable_key(F.col(key)).alias("_k"))
    placed = rows.withColumns({"shard": shard_of(F.col("_k"), shards), "grown_shard": shard_of(F.col("_k"), shards + 1)})
    ranked = grouped_rank(placed, ["shard"], [key, "text_crc32", "size"], "_rank")
    return ranked.withColumn("slot", F.col("_rank") - 1).drop("_k", "_rank")


def write_shards(df: DataFrame, shards: int, key: str = "doc_id") -> str:
    """Write ``df`` into one folder per shard; returns the path."""
    path = new_path(df.sparkSession, "shards")
    df.withColumn("_shard", shard_of(stable_key(F.col(key)), shards)).write.partitionBy("_shard").parquet(path)
    return path
