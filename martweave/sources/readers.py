"""Typed reads of the mart's source tables, document manifests and JSON documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martweave.functions.scalars import finish_digest, set_digest

# Declared types of the seven source tables.
SOURCE_SCHEMAS = {
    "product": "product_id bigint, name string, product_number string, product_subcategory_id bigint",
    "product_subcategory": "product_subcategory_id bigint, name string, product_category_id bigint",
    "product_category": "product_category_id bigint, name string",
    "customer": "customer_id bigint, territory_id bigint",
    "sales_territory": "territory_id bigint, name string, country_region_code string, territory_group string",
    "sales_order_header": "sales_order_id bigint, order_date timestamp, customer_id bigint, territory_id bigint,"
                          " status int, currency_rate_id bigint",
    "sales_order_detail": "sales_order_id bigint, sales_order_detail_id bigint, product_id bigint, order_qty int,"
                          " unit_price decimal(19,4), unit_price_discount decimal(19,4), line_total decimal(19,6)",
}

# JDBC URL shapes and drivers of the supported platforms.
JDBC = {
    "mssql": ("jdbc:sqlserver://{host}:{port};databaseName={database}",
              "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "postgres": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver"),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver"),
    "oracle": ("jdbc:oracle:thin:@//{host}:{port}/{database}", "oracle.jdbc.OracleDriver"),
}
# Derby comes with Spark; its embedded databases belong to one process, so it serves local sessions only.
EMBEDDED = {"derby": ("jdbc:derby:{database}", "org.apache.derby.iapi.jdbc.AutoloadedDriver")}
STATEMENT_SECONDS = 30
FETCH_ROWS = 10_000
ROWS_PER_READ = 1_000_000


def read_sources(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The seven source tables under ``root``, one parquet table each, with declared types."""
    return {
        name: spark.read.schema(schema).parquet(f"{root}/{name}.parquet")
        for name, schema in SOURCE_SCHEMAS.items()
    }


def jdbc_options(platform: str, options: dict[str, str], table: str) -> dict[str, str]:
    if platform not in JDBC and platform not in EMBEDDED:
        raise ValueError("query_platform_unsupported")
    url, driver = JDBC[platform] if platform in JDBC else EMBEDDED[platform]
    place = {k: options.get(k) if platform in EMBEDDED else options[k] for k in ("host", "port", "database")}
    result = {
        "url": url.format(**place),
        "driver": driver,
        "dbtable": table,
        "queryTimeout": str(STATEMENT_SECONDS),
        "fetchsize": str(FETCH_ROWS),
    }
    for key in ("user", "password", "partitionColumn", "lowerBound", "upperBound", "numPartitions"):
        if key in options:
            result[key] = str(options[key])
    return result


def split_ranges(column: str, low: int, high: int, nulls: int, parts: int) -> list[str]:
    """One predicate per range of a whole-number column; together they hold every row once, NULL keys in one of their own."""
    width = high - low + 1
    bounds = sorted({low + width * i // parts for i in range(parts)})
    ranges = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(bounds, [*bounds[1:], high + 1])]
    return ranges + ([f"{column} IS NULL"] if nulls else [])


def read_jdbc(spark: SparkSession, platform: str, options: dict[str, str], table: str, split: str | None = None,
              rows_per_read: int = ROWS_PER_READ) -> DataFrame:
    """Read-only table scan.

    ``split`` names a whole-number column to read in parallel by: the source is asked for its
    least and greatest value and its number of rows and of NULLs, and each range of about ``rows_per_read``
    rows is a query of its own. Without it, partitionColumn and bounds may be given among the options.
    """
    chosen = jdbc_options(platform, options, table)
    if split is None:
        return spark.read.format("jdbc").options(**chosen).load()
    plain = {k: v for k, v in chosen.items() if k not in ("dbtable", "partitionColumn", "lowerBound", "upperBound", "numPartitions")}
    asked = f"SELECT MIN({split}) AS low, MAX({split}) AS high, COUNT(*) AS n, COUNT({split}) AS filled FROM {table}"
    low, high, n, filled = spark.read.format("jdbc").options(**plain, query=asked).load().first()
    if not n:
        return spark.read.format("jdbc").options(**chosen).load()
    parts = max(1, -(-n // rows_per_read))
    ranges = split_ranges(split, int(low), int(high), n - filled, parts) if filled else [f"{split} IS NULL"]
    return spark.read.jdbc(plain.pop("url"), table, predicates=ranges, properties=plain)


def corpus_manifest(docs: DataFrame, path: Column, text: Column) -> DataFrame:
    """(path, sha256, size_bytes) per document."""
    return docs.select(
        path.alias("path"),
        F.sha2(text, 256).alias("sha256"),
        F.octet_length(text).cast("long").alias("size_bytes"),
    )


def manifest_digest(manifest: DataFrame) -> DataFrame:
    """One row: file count, bytes and one digest of all (path, sha256, size) entries.

    The digest does not depend on order, so it is a plain aggregate with
    map-side combine instead of a sort of the whole corpus into one row.
    """
    parts = [F.col("path"), F.col("sha256"), F.col("size_bytes")]
    return manifest.agg(*set_digest(parts), F.sum("size_bytes").alias("total_bytes")).select(
        F.col("_rows").alias("files"), "total_bytes", finish_digest().alias("manifest_sha256")
    )


def allowlist_tables(catalog: DataFrame, name: str, patterns: Sequence[str]) -> DataFrame:
    """Rows whose qualified name matches any anchored pattern; the pattern list is configuration."""
    anchored = [p for p in patterns if p.startswith("^") and p.endswith("$")]
    if len(anchored) != len(patterns) or not patterns:
        raise ValueError("pattern_must_be_anchored")
    hit = F.lit(False)
    for pattern in anchored:
        hit = hit | F.col(name).rlike(pattern)
    return catalog.filter(hit).distinct()
