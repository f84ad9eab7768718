"""Star-schema operators: extraction joins, Type-1 upserts, surrogate keys, the reporting view."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martweave.functions import scale
from martweave.functions.scalars import calendar_dim, date_key, line_net_amount


@dataclass(frozen=True)
class Scope:
    """Closed date range, one order status, local currency only."""

    start: str
    end: str
    status: int = 5

    def __post_init__(self) -> None:
        if date.fromisoformat(self.start) > date.fromisoformat(self.end) or self.status < 0:
            raise ValueError("invalid_scope")

    def order_filter(self, day: Column, status: Column, currency: Column) -> Column:
        """On the raw timestamp or date column, so the bounds reach the scan."""
        until = F.date_add(F.lit(self.end).cast("date"), 1)
        return (day >= F.lit(self.start).cast("date")) & (day < until) & (status == self.status) & currency.isNull()


# --- extraction -----------------------------------------------------------------


def in_scope(orders: DataFrame, scope: Scope) -> DataFrame:
    return orders.filter(scope.order_filter(F.col("order_date"), F.col("status"), F.col("currency_rate_id")))


def scope_flag(view: DataFrame, scope: Scope, out: str = "in_scope") -> DataFrame:
    """Flag computed once per row and shared by several aggregates."""
    rule = scope.order_filter(F.col("order_date"), F.col("status"), F.col("currency_rate_id"))
    return view.withColumn(out, F.coalesce(rule, F.lit(False)))


def order_lines(header: DataFrame, detail: DataFrame, scope: Scope | None = None) -> DataFrame:
    """Header joined to detail on the order id, the net amount computed once per line."""
    head = header if scope is None else in_scope(header, scope)
    return head.join(detail, "sales_order_id").select(
        "sales_order_id",
        "sales_order_detail_id",
        F.to_date("order_date").alias("order_date"),
        F.col("product_id").alias("source_product_id"),
        F.col("customer_id").alias("source_customer_id"),
        F.col("territory_id").alias("source_territory_id"),
        "status",
        "currency_rate_id",
        "order_qty",
        F.col("unit_price").cast("decimal(19,4)").alias("unit_price"),
        F.col("unit_price_discount").cast("decimal(19,4)").alias("unit_price_discount"),
        line_net_amount(F.col("order_qty"), F.col("unit_price"), F.col("unit_price_discount"))
        .alias("line_net_amount"),
        F.col("line_total").cast("decimal(19,6)").alias("source_line_total"),
    )


def product_hierarchy(product: DataFrame, subcategory: DataFrame, category: DataFrame) -> DataFrame:
    """Product with optional subcategory and category; their sizes decide the join, not a hint."""
    sub = subcategory.select(
        "product_subcategory_id", F.col("name").alias("product_subcategory_name"), "product_category_id"
    )
    cat = category.select("product_category_id", F.col("name").alias("product_category_name"))
    return (
        product.join(sub, "product_subcategory_id", "left")
        .join(cat, "product_category_id", "left")
        .select(
            F.col("product_id").alias("source_product_id"),
            F.col("name").alias("product_name"),
            "product_number",
            F.col("product_subcategory_id").alias("source_product_subcategory_id"),
            "product_subcategory_name",
            F.col("product_category_id").alias("source_product_category_id"),
            "product_category_name",
        )
    )


def extract(sources: dict[str, DataFrame], scope: Scope) -> dict[str, DataFrame]:
    """The four inputs of a load: products, customers, territories and in-scope order lines."""
    return {
        "products": product_hierarchy(
            sources["product"], sources["product_subcategory"], sources["product_category"]
        ),
        "customers": sources["customer"].select(
            F.col("customer_id").alias("source_customer_id"),
            F.col("territory_id").alias("source_territory_id"),
        ),
        "territories": sources["sales_territory"].select(
            F.col("territory_id").alias("source_territory_id"),
            F.col("name").alias("territory_name"),
            "country_region_code",
            "territory_group",
        ),
        "facts": order_lines(sources["sales_order_header"], sources["sales_order_detail"], scope),
    }


# --- dimensions -----------------------------------------------------------------

DIM_SCHEMAS = {
    "dim_date": "date_key int, full_date date, calendar_year int, calendar_quarter int, calendar_month int,"
                " month_name string, day_of_month int",
    "dim_territory": "territory_key bigint, source_territory_id bigint, territory_name string,"
                     " country_region_code string, territory_group string",
    "dim_product": "product_key bigint, source_product_id bigint, product_name string, product_number string,"
                   " source_product_subcategory_id bigint, product_subcategory_name string,"
                   " source_product_category_id bigint, product_category_name string",
    "dim_customer": "customer_key bigint, source_customer_id bigint, source_territory_id bigint, territory_key bigint",
}

# The Unknown member (key 0) of every dimension.
UNKNOWN_MEMBERS = {
    "dim_date": ("0", "DATE'1900-01-01'", "0", "0", "0", "'Unknown'", "0"),
    "dim_territory": ("0", "0", "'Unknown'", "'UNK'", "'Unknown'"),
    "dim_product": ("0", "0", "'Unknown'", "'UNKNOWN'", "CAST(NULL AS BIGINT)", "CAST(NULL AS STRING)",
                    "CAST(NULL AS BIGINT)", "CAST(NULL AS STRING)"),
    "dim_customer": ("0", "0", "CAST(NULL AS BIGINT)", "0"),
}


def unknown_member(spark: SparkSession, dim: str) -> DataFrame:
    names = [part.split()[0] for part in DIM_SCHEMAS[dim].split(",")]
    kinds = [part.split()[1] for part in DIM_SCHEMAS[dim].split(",")]
    return spark.range(1).select(*[F.expr(v).cast(k).alias(n) for n, v, k in zip(names, UNKNOWN_MEMBERS[dim], kinds)])


def unknown_member_check(dims: dict[str, DataFrame]) -> DataFrame:
    """One row: how many dimensions hold exactly one key-0 row with the canonical values.

    Each dimension is filtered to its key 0 (pushed to the scan) and counted; the
    counts meet in a union, so nothing is multiplied.
    """
    parts = None
    for name, df in dims.items():
        names = [part.split()[0] for part in DIM_SCHEMAS[name].split(",")]
        values = dict(zip(names, [F.expr(v) for v in UNKNOWN_MEMBERS[name]]))
        match = reduce(and_, [F.col(c).eqNullSafe(v) for c, v in values.items()])
        one = df.filter(F.col(names[0]) == 0).agg(
            F.count(F.lit(1)).alias("members"),
            F.count_if(match).alias("canonical"),
        ).withColumn("dim", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    good = (F.col("members") == 1) & (F.col("canonical") == 1)
    return parts.agg(
        F.count(F.lit(1)).alias("dimensions"),
        F.count_if(good).alias("canonical_dimensions"),
        F.bool_and(good).alias("canonical"),
    )


def insert_if_absent(current: DataFrame, incoming: DataFrame, key: str | Sequence[str]) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return current.unionByName(incoming.join(current.select(*keys), keys, "left_anti"))


def assign_keys(new: DataFrame, order: Sequence[str], start: int, out: str) -> DataFrame:
    """Keys start+1, start+2, … in ``order``; ranks are made per range partition, not in one task."""
    ranked = scale.grouped_rank(new, [], order, "_rank")
    return ranked.withColumn(out, F.col("_rank") + F.lit(start)).drop("_rank")


def upsert_type1(
    current: DataFrame, incoming: DataFrame, key: str, attrs: Sequence[str], surrogate: str
) -> DataFrame:
    """Matching keys take the incoming attributes, others stay, missing keys get new surrogates."""
    fresh = incoming.select(F.col(key), *[F.col(a).alias(f"_in_{a}") for a in attrs], F.lit(True).alias("_hit"))
    kept = current.join(fresh, key, "left").select(
        surrogate,
        key,
        *[F.when(F.col("_hit"), F.col(f"_in_{a}")).otherwise(F.col(a)).alias(a) for a in attrs],
    )
    new = incoming.join(current.select(key), key, "left_anti").select(key, *attrs)
    start = current.agg(F.coalesce(F.max(surrogate), F.lit(0))).first()[0]
    added = assign_keys(new, [key], start, surrogate)
    return kept.unionByName(added.select(surrogate, key, *attrs)).select(*current.columns)


FACT_KEY = ["sales_order_id", "sales_order_detail_id"]
FACT_COLUMNS = [
    *FACT_KEY, "order_date_key", "product_key", "customer_key", "territory_key", "status",
    "currency_rate_id", "order_qty", "unit_price", "unit_price_discount", "line_net_amount",
    "source_line_total",
]
FACT_SCHEMA = (
    "sales_order_id bigint, sales_order_detail_id bigint, order_date_key int, product_key bigint, customer_key bigint,"
    " territory_key bigint, status int, currency_rate_id bigint, order_qty int, unit_price decimal(19,4),"
    " unit_price_discount decimal(19,4), line_net_amount decimal(19,6), source_line_total decimal(19,6)"
)


def upsert_fact(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming lines replace lines with the same (order, detail) key; the rest stay."""
    left = current.select(*FACT_KEY, F.struct(*FACT_COLUMNS).alias("_old"))
    right = incoming.select(*FACT_KEY, F.struct(*FACT_COLUMNS).alias("_new"))
    merged = left.join(right, FACT_KEY, "full").select(F.coalesce("_new", "_old").alias("_row"))
    return merged.select("_row.*")


FACT_MONTH = "order_month"


def order_month() -> Column:
    """yyyymm of the order date key, the unit in which the fact is rewritten."""
    return F.expr("order_date_key div 100").cast("int")


def changed_facts(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming lines that are new or differ from the current line of their key, with that line's month as ``old_month``."""
    old = current.select(*FACT_KEY, F.struct(*FACT_COLUMNS).alias("_old"), order_month().alias("old_month"))
    new = incoming.select(*FACT_KEY, F.struct(*FACT_COLUMNS).alias("_new"))
    met = new.join(old, FACT_KEY, "left").filter(~F.col("_new").eqNullSafe(F.col("_old")))
    return met.select("_new.*", "old_month")


def replace_lines(current: DataFrame, changed: DataFrame) -> DataFrame:
    """Current lines without those whose key changed, and the changed ones."""
    return current.select(*FACT_COLUMNS).join(changed.select(*FACT_KEY), FACT_KEY, "left_anti").select(*FACT_COLUMNS).unionByName(
        changed.select(*FACT_COLUMNS))


def lookup_surrogate(df: DataFrame, dim: DataFrame, key: str, surrogate: str, *, optional: bool = False) -> DataFrame:
    """Add ``surrogate`` for the business key; an optional NULL key becomes 0.

    A non-NULL key without a member leaves NULL, which ``unresolved`` counts. The
    dimension is unique on the key, so a hot key only makes a large probe side,
    which adaptive execution splits.
    """
    found = df.join(dim.select(key, F.col(surrogate).alias("_sk")), key, "left")
    value = F.when(F.col(key).isNull(), F.lit(0)).otherwise(F.col("_sk")) if optional else F.col("_sk")
    return found.withColumn(surrogate, value).drop("_sk")


def unresolved(df: DataFrame, surrogates: Sequence[str]) -> DataFrame:
    """(surrogate, rows) for lookups that left a NULL."""
    counts = df.agg(*[F.count_if(F.col(s).isNull()).alias(s) for s in surrogates])
    pairs = F.array(*[F.struct(F.lit(s).alias("surrogate"), F.col(s).alias("rows")) for s in surrogates])
    return counts.select(F.inline(pairs)).filter("rows > 0")


def build_fact(facts: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    df = lookup_surrogate(facts, dims["dim_product"], "source_product_id", "product_key")
    df = lookup_surrogate(df, dims["dim_customer"].drop("territory_key"), "source_customer_id", "customer_key")
    df = lookup_surrogate(df, dims["dim_territory"], "source_territory_id", "territory_key", optional=True)
    return df.withColumn("order_date_key", date_key(F.col("order_date"))).select(
        *[F.col(c).cast("decimal(19,6)").alias(c) if c == "line_net_amount" else F.col(c) for c in FACT_COLUMNS]
    )


# --- reporting view and fact joins -----------------------------------------------


def sales_view(fact: DataFrame, dims: dict[str, DataFrame], *, customer: bool = True) -> DataFrame:
    """Fact joined to its four dimensions, 24 columns; columns a report does not use are pruned.

    ``customer=False`` leaves out the customer join and its one column. A load only
    publishes facts whose keys all resolve, so that join neither drops nor repeats
    rows, and reports without customer columns save the shuffle of the largest dimension.
    """
    joined = (
        fact.join(dims["dim_date"].select(F.col("date_key").alias("order_date_key"), "full_date"), "order_date_key")
        .join(dims["dim_product"], "product_key")
        .join(dims["dim_territory"], "territory_key")
    )
    if customer:
        joined = joined.join(dims["dim_customer"].select("customer_key", "source_customer_id"), "customer_key")
    columns = [c for c in VIEW_COLUMNS if customer or c != "source_customer_id"]
    return joined.withColumnRenamed("full_date", "order_date").select(*columns)


VIEW_COLUMNS = [
    "sales_order_id", "sales_order_detail_id", "order_date", "order_date_key", "product_key", "source_product_id",
    "product_name", "product_number", "product_subcategory_name", "product_category_name", "customer_key",
    "source_customer_id", "territory_key", "source_territory_id", "territory_name", "country_region_code",
    "territory_group", "status", "currency_rate_id", "order_qty", "unit_price", "unit_price_discount",
    "line_net_amount", "source_line_total",
]


def between_days(view: DataFrame, start: str, end: str) -> DataFrame:
    """View rows of a closed date range.

    The same range on the fact's own date key is implied by the join and repeated
    here so that it reaches the fact scan, whose files are clustered by that key.
    """
    low, high = (int(d.replace("-", "")) for d in (start, end))
    day = F.col("order_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    if start <= "1900-01-01":  # the Unknown day has key 0
        return view.filter(day)
    return view.filter(F.col("order_date_key").between(low, high) & day)


def fact_date_dim(fact: DataFrame, dim_date: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Fact with its calendar day and one more dimension, the input of a monthly summary."""
    days = dim_date.select(F.col("date_key").alias("order_date_key"), "full_date")
    return fact.join(days, "order_date_key").join(dim, key)


def calendar(spark: SparkSession, scope: Scope) -> DataFrame:
    return calendar_dim(spark, scope.start, scope.end)
