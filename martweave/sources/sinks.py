"""Exact row export and versioned publication of tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_wire(df: DataFrame) -> DataFrame:
    """One JSON text per row: integers and decimals as strings, dates in ISO form.

    Non-finite floats and unsupported types are errors.
    """
    out = []
    for field in df.schema.fields:
        c, t = F.col(f"`{field.name}`"), field.dataType
        if isinstance(t, (T.StringType, T.BooleanType)):
            pass
        elif isinstance(t, (T.IntegralType, T.DecimalType, T.DateType)):
            c = c.cast("string")
        elif isinstance(t, (T.FloatType, T.DoubleType)):
            finite = ~(F.isnan(c) | (F.abs(c) == float("inf")))
            c = F.when(F.assert_true(F.coalesce(finite, F.lit(True)), "query_result_invalid").isNull(), c)
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
        else:
            raise TypeError("query_result_type_unsupported")
        out.append(c.alias(field.name))
    return df.select(F.to_json(F.struct(*out), {"ignoreNullFields": "false"}).alias("json"))


class PublishRejected(RuntimeError):
    pass


def publish(spark: SparkSession, root: str, paths: dict[str, str]) -> None:
    """Make written table versions current, all at once: one row appended to the version log.

    Readers follow the newest row, so they see either all old or all new versions.
    """
    pairs = [F.lit(text) for pair in paths.items() for text in pair]
    entry = spark.range(1).coalesce(1).select(
        F.lit(time.time_ns()).alias("published"), F.create_map(*pairs).alias("paths"))
    entry.write.mode("append").parquet(f"{root}/log")


LOG = "published long, paths map<string,string>"


def current_paths(spark: SparkSession, root: str) -> dict[str, str]:
    log = spark.read.schema(LOG).parquet(f"{root}/log")
    return log.agg(F.max_by("paths", "published")).first()[0]


def is_published(spark: SparkSession, root: str) -> bool:
    """Whether anything was ever made current at ``root``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/log")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    return sorted(entry.getPath().getName() for entry in found)


def replace_table(
    df: DataFrame, root: str, name: str, check: Callable[[DataFrame], bool] | None = None
) -> DataFrame:
    """Write a new version of one table, validate it as written, then make it current."""
    spark = df.sparkSession
    path = version_path(root, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    if check is not None and not check(written):
        raise PublishRejected(name)
    publish(spark, f"{root}/{name}", {name: path})
    return written


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(current_paths(spark, f"{root}/{name}")[name])


def version_path(root: str, name: str) -> str:
    return f"{root}/{name}/versions/{uuid.uuid4().hex}"
