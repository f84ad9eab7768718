"""Reports over the sales view: monthly summaries, dashboard measures, filter choices."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martweave.functions.scalars import average_order_value, month_start, unknown_id, unknown_label
from martweave.operators.mart import between_days, fact_date_dim


def _money(c: str):
    return F.sum(F.col(c).cast("decimal(38,6)")).cast("decimal(38,6)")


def sales_by_month_category(view: DataFrame, start: str, through: str) -> DataFrame:
    """Net sales per month and category of the closed date range, ordered."""
    if date.fromisoformat(start) > date.fromisoformat(through):
        raise ValueError("range_invalid")
    return (
        between_days(view, start, through)
        .groupBy(month_start(F.col("order_date")).alias("month"),
                 unknown_label(F.col("product_category_name")).alias("category"))
        .agg(_money("line_net_amount").alias("sales_amount"))
        .orderBy("month", "category")
    )


def _summary(rows: DataFrame, id_columns: list) -> DataFrame:
    return rows.groupBy(month_start(F.col("full_date")).alias("month_start"), *id_columns).agg(
        F.count(F.lit(1)).alias("line_count"),
        F.count_distinct("sales_order_id").alias("order_count"),
        F.sum(F.col("order_qty").cast("long")).alias("quantity"),
        _money("line_net_amount").alias("net_sales"),
        _money("source_line_total").alias("source_line_total"),
    )


def monthly_category_summary(fact: DataFrame, dim_date: DataFrame, dim_product: DataFrame) -> DataFrame:
    product = dim_product.select(
        "product_key",
        unknown_id(F.col("source_product_category_id")).alias("product_category_id"),
        unknown_label(F.col("product_category_name")).alias("product_category_name"),
    )
    return _summary(
        fact_date_dim(fact, dim_date, product, "product_key"),
        [F.col("product_category_id"), F.col("product_category_name")],
    )


def monthly_territory_summary(fact: DataFrame, dim_date: DataFrame, dim_territory: DataFrame) -> DataFrame:
    place = dim_territory.select("territory_key", F.col("source_territory_id").alias("territory_id"), "territory_name")
    return _summary(
        fact_date_dim(fact, dim_date, place, "territory_key"),
        [F.col("territory_id"), F.col("territory_name")],
    )


def dashboard_filter(
    view: DataFrame,
    start: str,
    end: str,
    territories: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
) -> DataFrame:
    """Inclusive time range and multi-selects; None means every value, NULL reads as 'Unknown'."""
    rows = between_days(view, start, end)
    if territories is not None:
        rows = rows.filter(unknown_label(F.col("territory_name")).isin(*territories))
    if categories is not None:
        rows = rows.filter(unknown_label(F.col("product_category_name")).isin(*categories))
    return rows


def kpi_sales(rows: DataFrame) -> DataFrame:
    return rows.agg(_money("line_net_amount").alias("value"))


def kpi_orders(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_distinct("sales_order_id").alias("value"))


def kpi_aov(rows: DataFrame) -> DataFrame:
    totals = rows.agg(_money("line_net_amount").alias("net"), F.count_distinct("sales_order_id").alias("orders"))
    return totals.select(average_order_value(F.col("net"), F.col("orders")).alias("value"))


def monthly_trend(rows: DataFrame) -> DataFrame:
    """Per month, the first selected order date as the time point, so a clipped month stays in range."""
    return (
        rows.groupBy(month_start(F.col("order_date")).alias("_month"))
        .agg(F.min("order_date").alias("time"), _money("line_net_amount").alias("sales_amount"))
        .select("time", "sales_amount")
        .orderBy("time")
    )


def sales_by_category(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy(unknown_label(F.col("product_category_name")).alias("category"))
        .agg(_money("line_net_amount").alias("sales_amount"))
        .orderBy(F.desc("sales_amount"))
    )


def sales_by_territory(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy(unknown_label(F.col("territory_name")).alias("territory"))
        .agg(_money("line_net_amount").alias("sales_amount"))
        .orderBy(F.desc("sales_amount"))
    )


def quality_summary(rows: DataFrame) -> DataFrame:
    """Counts are 0 and sums NULL for an empty selection."""
    return rows.agg(
        F.count(F.lit(1)).alias("line_count"),
        F.count_distinct("sales_order_id").alias("order_count"),
        F.sum(F.col("order_qty").cast("long")).alias("quantity"),
        _money("line_net_amount").alias("line_net_amount"),
        _money("source_line_total").alias("source_line_total"),
    )


def panels(rows: DataFrame) -> dict[str, DataFrame]:
    return {
        "sales": kpi_sales(rows),
        "orders": kpi_orders(rows),
        "aov": kpi_aov(rows),
        "trend": monthly_trend(rows),
        "category": sales_by_category(rows),
        "territory": sales_by_territory(rows),
        "quality": quality_summary(rows),
    }


def distinct_values(view: DataFrame, column: str, out: str = "value") -> DataFrame:
    return view.select(unknown_label(F.col(column)).alias(out)).distinct().orderBy(out)
