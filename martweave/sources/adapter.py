"""Maps the driver's parquet tables onto the seven source tables of the mart.

Source ids start at 0 in the driver tables, while 0 is reserved for the Unknown
member, so every id is shifted by one. Category and subcategory ids are the
smallest product id of their group, which needs no global numbering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martweave.functions import scale
from martweave.functions.scalars import line_net_amount
from martweave.operators.mart import Scope, in_scope

_LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def category(spark: SparkSession, root: str) -> DataFrame:
    return (
        table(spark, root, "part")
        .groupBy(F.col("p_type").alias("name"))
        .agg((F.min("p_partkey") + 1).cast("long").alias("product_category_id"))
    )


def subcategory(spark: SparkSession, root: str) -> DataFrame:
    groups = (
        table(spark, root, "part")
        .groupBy("p_type", "p_brand")
        .agg((F.min("p_partkey") + 1).cast("long").alias("product_subcategory_id"))
    )
    owner = category(spark, root).withColumnRenamed("name", "p_type")
    return groups.join(owner, "p_type").select(
        "product_subcategory_id",
        F.concat_ws(" ", "p_type", "p_brand").alias("name"),
        "product_category_id",
        "p_type",
        "p_brand",
    )


def product(spark: SparkSession, root: str) -> DataFrame:
    """SMALL parts have no subcategory, so the Unknown category has work to do."""
    keys = subcategory(spark, root).filter("p_type <> 'SMALL'").select(
        "p_type", "p_brand", "product_subcategory_id"
    )
    return (
        table(spark, root, "part")
        .join(keys, ["p_type", "p_brand"], "left")
        .select(
            (F.col("p_partkey") + 1).cast("long").alias("product_id"),
            F.col("p_name").alias("name"),
            F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("product_number"),
            "product_subcategory_id",
        )
    )


def customer(spark: SparkSession, root: str) -> DataFrame:
    """Customers with a negative balance have no territory."""
    return table(spark, root, "customer").select(
        (F.col("c_custkey") + 1).cast("long").alias("customer_id"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey") + 1).cast("long").alias("territory_id"),
    )


def territory(spark: SparkSession, root: str) -> DataFrame:
    regions = table(spark, root, "region")
    return (
        table(spark, root, "nation")
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            (F.col("n_nationkey") + 1).cast("long").alias("territory_id"),
            F.col("n_name").alias("name"),
            F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("country_region_code"),
            F.col("r_name").alias("territory_group"),
        )
    )


def sales_order_header(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders").select(
        (F.col("o_orderkey") + 1).cast("long").alias("sales_order_id"),
        F.col("o_orderdate").alias("order_date"),
        (F.col("o_custkey") + 1).cast("long").alias("customer_id"),
        F.when(F.col("o_orderstatus") == "F", 5).when(F.col("o_orderstatus") == "P", 3)
        .otherwise(1).cast("int").alias("status"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", 1).cast("long").alias("currency_rate_id"),
    )
    return orders.join(customer(spark, root), "customer_id", "left")


def sales_order_detail(spark: SparkSession, root: str, *, with_ids: bool = True, scope: Scope | None = None) -> DataFrame:
    """(order, line number) repeats in the driver table, so detail ids are ranks within the order.

    With a ``scope``, lines of other orders are left out before they are ranked: an order is in or
    out of scope with all its lines, so the ids are the same.
    """
    lines = table(spark, root, "lineitem")
    if with_ids:
        scanned = scale.number_copies(lines.select("l_orderkey", *_LINE_ORDER), "_copy")
        if scope is not None:
            wanted = in_scope(sales_order_header(spark, root), scope).select((F.col("sales_order_id") - 1).alias("l_orderkey"))
            scanned = scanned.join(wanted, "l_orderkey", "left_semi")
        lines = scale.grouped_rank(scanned, ["l_orderkey"], [*_LINE_ORDER, "_copy"], "_line")
    else:
        lines = lines.withColumn("_line", F.lit(None).cast("long"))
    prices = table(spark, root, "part").select(
        "p_partkey", F.col("p_retailprice").cast("decimal(19,4)").alias("unit_price")
    )
    quantity = F.col("l_quantity").cast("int")
    discount = F.col("l_discount").cast("decimal(19,4)")
    return lines.join(prices, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") + 1).cast("long").alias("sales_order_id"),
        F.col("_line").cast("long").alias("sales_order_detail_id"),
        (F.col("l_partkey") + 1).cast("long").alias("product_id"),
        quantity.alias("order_qty"),
        "unit_price",
        discount.alias("unit_price_discount"),
        line_net_amount(quantity, F.col("unit_price"), discount).cast("decimal(19,6)").alias("line_total"),
    )


def mart_sources(spark: SparkSession, root: str, *, with_ids: bool = True, scope: Scope | None = None) -> dict[str, DataFrame]:
    """The seven source tables; with a ``scope``, only the details of its orders."""
    return {
        "product": product(spark, root),
        "product_subcategory": subcategory(spark, root).drop("p_type", "p_brand"),
        "product_category": category(spark, root),
        "customer": customer(spark, root),
        "sales_territory": territory(spark, root),
        "sales_order_header": sales_order_header(spark, root),
        "sales_order_detail": sales_order_detail(spark, root, with_ids=with_ids, scope=scope),
    }
