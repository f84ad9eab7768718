"""Building blocks that stay balanced when one key holds a large share of the rows.

``stage`` cuts lineage through a written table in the shared folder, so a lost
executor never forces a recomputation that could change row placement.
``ordered_chunks`` range-partitions rows by (keys, order), which splits a hot key
over as many tasks as its size needs; ``grouped_rank`` and ``grouped_lag`` finish
window work inside chunks and stitch the chunk borders with a table that has at
most one row per chunk.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_FOLDERS: dict[str, str] = {}
_STAGED: dict[str, list[str]] = {}

CHUNK = "_chunk"
PLACE_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in the low 33 bits
T = TypeVar("T")


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):  # not local-cluster, whose executors are processes of their own
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_FOLDERS[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete all tables staged so far in this application; call it when the results built on them are written."""
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)


def number_copies(scan: DataFrame, out: str) -> DataFrame:
    """Give exact copies a column to be told apart by, the last part of a total order.

    Only for a frame read straight from files: there a task that runs again meets
    the same rows in the same order and repeats the same numbers. After a shuffle
    it would not, and rows placed by the number could be lost.
    """
    return scan.withColumn(out, F.monotonically_increasing_id())


def ordered_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows range-partitioned by (keys, order) with the partition number in ``_chunk``.

    Placement depends on values only. With a total order a hot key is split over as
    many partitions as its size needs; see ``number_copies`` for groups of copies.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)])
    return stage(ranged.withColumn(CHUNK, F.spark_partition_id()), "chunks")


def _join_borders(rows: DataFrame, borders: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    # At most one row per chunk: only a key that continues from the chunk before has one.
    names = {c: f"_b_{c}" for c in (CHUNK, *keys)}
    small = F.broadcast(borders.select(*[F.col(c).alias(n) for c, n in names.items()], value))
    match: Column = F.lit(True)
    for c, n in names.items():
        match = match & rows[c].eqNullSafe(F.col(n))
    return rows.join(small, match, "left").drop(*names.values())


def grouped_running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Running bigint sum of ``value`` per ``keys`` up to and including the row, in ``order``."""
    rows = ordered_chunks(df.withColumn("_v", value.cast("long")), keys, order)
    across = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = across.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    borders = (
        rows.groupBy(CHUNK, *keys)
        .agg(F.sum("_v").alias("_n"))
        .withColumn("_before", F.sum("_n").over(before))
        .filter(F.col("_before").isNotNull())
    )
    inside = Window.partitionBy(CHUNK, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumn("_run", F.sum("_v").over(inside))
    joined = _join_borders(running, borders, keys, "_before")
    return joined.withColumn(out, F.col("_run") + F.coalesce("_before", F.lit(0))).drop(
        "_v", "_run", "_before", CHUNK
    )


def grouped_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """``row_number`` per ``keys`` (or over everything when empty), as bigint from 1."""
    if keys:
        return grouped_running_sum(df, keys, order, F.lit(1), out)
    # Without keys the place inside a sorted range partition is the row's own number there,
    # so one shuffle is enough; each partition only needs the size of those before it.
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_place", F.monotonically_increasing_id())
    rows = stage(placed, "ranked").withColumn(CHUNK, F.shiftright("_place", PLACE_BITS))
    before = Window.partitionBy(F.lit(0)).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    borders = sizes.withColumn("_before", F.sum("_n").over(before)).filter(F.col("_before") > 0)
    joined = _join_borders(rows, borders, [], "_before")
    place = F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return joined.withColumn(out, place + 1 + F.coalesce("_before", F.lit(0))).drop("_place", "_before", CHUNK)


def grouped_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Value of the row before within ``keys`` under a total ``order``."""
    rows = ordered_chunks(df, keys, order)
    spot = F.struct(*order)
    last = rows.groupBy(CHUNK, *keys).agg(F.max_by(F.struct(value), spot).alias("_last"))
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    borders = last.withColumn("_prior", F.lag("_last").over(across)).filter(F.col("_prior").isNotNull())
    inside = Window.partitionBy(CHUNK, *keys).orderBy(*order)
    lagged = rows.withColumn("_in", F.lag(F.struct(value)).over(inside))
    joined = _join_borders(lagged, borders, keys, "_prior")
    picked = F.when(F.col("_in").isNotNull(), F.col("_in")).otherwise(F.col("_prior"))
    return joined.withColumn(out, picked[value]).drop("_in", "_prior", CHUNK)


def together(tasks: dict[str, Callable[[], T]]) -> dict[str, T]:
    """Run independent Spark actions at the same time, so short jobs do not queue behind each other."""
    with ThreadPoolExecutor(max_workers=len(tasks)) as pool:
        started = {name: pool.submit(task) for name, task in tasks.items()}
        return {name: future.result() for name, future in started.items()}


def one_row_values(rows: dict[str, DataFrame], measures: Sequence[str]) -> DataFrame:
    """(measure, <name>_value …, same) for several one-row frames; they meet in a union, not a join."""
    tall = None
    for name, df in rows.items():
        pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("string").alias("value"))
                          for m in measures])
        one = df.select(F.inline(pairs)).withColumn("_name", F.lit(name))
        tall = one if tall is None else tall.unionByName(one)
    values = {n: F.max(F.when(F.col("_name") == n, F.col("value"))).alias(f"{n}_value") for n in rows}
    wide = tall.groupBy("measure").agg(*values.values())
    first, *rest = rows
    same = F.lit(True)
    for name in rest:
        same = same & F.col(f"{first}_value").eqNullSafe(F.col(f"{name}_value"))
    return wide.withColumn("same", same)


def one_row_differs(left: DataFrame, right: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Compare two one-row frames measure by measure: (measure, left_value, right_value, same)."""
    return one_row_values({"left": left, "right": right}, measures)
