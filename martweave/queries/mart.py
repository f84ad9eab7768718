"""Mart queries: extraction, load, reports, quality checks over the whole driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martweave.functions import scale
from martweave.functions import scalars as S
from martweave.operators import copies, mart, quality
from martweave.operators.mart import Scope
from martweave.plans import load, reports
from martweave.queries.registry import DIGEST, query, row_sql
from martweave.sources import adapter, readers
from martweave.sources.adapter import table
from martweave.sources.sinks import current_paths

SCOPE = Scope("1995-06-01", "2001-06-30")
_MARTS: dict[tuple[str, str], load.Mart] = {}


def mart_of(spark: SparkSession, root: str) -> load.Mart:
    """The mart loaded once per application from the driver tables, in the shared folder."""
    key = (spark.sparkContext.applicationId, root)
    if key not in _MARTS:
        target = scale.new_path(spark, "mart")
        load.load_mart(adapter.mart_sources(spark, root, scope=SCOPE), target, SCOPE)
        _MARTS[key] = load.open_mart(spark, target)
    return _MARTS[key]


def view_of(spark: SparkSession, root: str) -> DataFrame:
    return mart_of(spark, root).view


def report_of(spark: SparkSession, root: str) -> DataFrame:
    return mart_of(spark, root).report_view


# --- the same mart in SQL ---------------------------------------------------------

_DIMS = """
cat AS (SELECT p_type, CAST(min(p_partkey) + 1 AS BIGINT) AS id FROM part GROUP BY p_type),
sub AS (SELECT p_type, p_brand, CAST(min(p_partkey) + 1 AS BIGINT) AS id FROM part GROUP BY p_type, p_brand),
products AS (
  SELECT CAST(p_partkey + 1 AS BIGINT) AS source_product_id, p_name AS product_name,
         'P-' || p_partkey AS product_number,
         sub.id AS source_product_subcategory_id,
         CASE WHEN sub.id IS NOT NULL THEN p.p_type || ' ' || p.p_brand END AS product_subcategory_name,
         cat.id AS source_product_category_id, cat.p_type AS product_category_name
  FROM part p
  LEFT JOIN sub ON sub.p_type = p.p_type AND sub.p_brand = p.p_brand AND p.p_type <> 'SMALL'
  LEFT JOIN cat ON cat.p_type = sub.p_type),
customers AS (
  SELECT CAST(c_custkey + 1 AS BIGINT) AS source_customer_id,
         CASE WHEN c_acctbal >= 0 THEN CAST(c_nationkey + 1 AS BIGINT) END AS source_territory_id
  FROM customer),
territories AS (
  SELECT CAST(n_nationkey + 1 AS BIGINT) AS source_territory_id, n_name AS territory_name,
         'C' || n_nationkey AS country_region_code, r_name AS territory_group
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

_HEADERS = """
headers AS (
  SELECT CAST(o_orderkey + 1 AS BIGINT) AS sales_order_id, o_orderdate AS order_date,
         CAST(o_custkey + 1 AS BIGINT) AS source_customer_id, c.source_territory_id,
         CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'P' THEN 3 ELSE 1 END AS status,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 END AS currency_rate_id
  FROM orders LEFT JOIN customers c ON c.source_customer_id = o_custkey + 1)"""

_IN_SCOPE = ("order_date >= DATE '1995-06-01' AND order_date < DATE '2001-07-01' AND status = 5"
             " AND currency_rate_id IS NULL")

_LINES = f"""
details AS (
  SELECT CAST(l_orderkey + 1 AS BIGINT) AS sales_order_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
              l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT)
           AS sales_order_detail_id,
         CAST(l_partkey + 1 AS BIGINT) AS source_product_id, CAST(l_quantity AS INTEGER) AS order_qty,
         CAST(p_retailprice AS DECIMAL(19,4)) AS unit_price,
         CAST(l_discount AS DECIMAL(19,4)) AS unit_price_discount
  FROM lineitem JOIN part ON l_partkey = p_partkey),
lines AS (
  SELECT h.sales_order_id, d.sales_order_detail_id, CAST(h.order_date AS DATE) AS order_date,
         d.source_product_id, h.source_customer_id, h.source_territory_id, h.status, h.currency_rate_id,
         d.order_qty, d.unit_price, d.unit_price_discount,
         CAST(round(d.order_qty * d.unit_price * (1 - d.unit_price_discount), 6) AS DECIMAL(19,6)) AS line_net_amount,
         CAST(round(d.order_qty * d.unit_price * (1 - d.unit_price_discount), 6) AS DECIMAL(19,6)) AS source_line_total
  FROM headers h JOIN details d ON d.sales_order_id = h.sales_order_id
  WHERE {_IN_SCOPE})"""

_VIEW = """
keyed_products AS (SELECT row_number() OVER (ORDER BY source_product_id) AS product_key, * FROM products),
keyed_customers AS (SELECT row_number() OVER (ORDER BY source_customer_id) AS customer_key, * FROM customers),
keyed_territories AS (
  SELECT row_number() OVER (ORDER BY source_territory_id) AS territory_key, * FROM territories
  UNION ALL SELECT 0, 0, 'Unknown', 'UNK', 'Unknown'),
sales AS (
  SELECT l.sales_order_id, l.sales_order_detail_id, l.order_date,
         CAST(year(l.order_date) * 10000 + month(l.order_date) * 100 + day(l.order_date) AS INTEGER) AS order_date_key,
         CAST(p.product_key AS BIGINT) AS product_key, p.source_product_id, p.product_name, p.product_number,
         p.product_subcategory_name, p.product_category_name, CAST(c.customer_key AS BIGINT) AS customer_key,
         c.source_customer_id, CAST(t.territory_key AS BIGINT) AS territory_key, t.source_territory_id,
         t.territory_name, t.country_region_code, t.territory_group, l.status, l.currency_rate_id, l.order_qty,
         l.unit_price, l.unit_price_discount, l.line_net_amount, l.source_line_total
  FROM lines l
  JOIN keyed_products p ON p.source_product_id = l.source_product_id
  JOIN keyed_customers c ON c.source_customer_id = l.source_customer_id
  JOIN keyed_territories t ON t.source_territory_id = coalesce(l.source_territory_id, 0))"""

MART_SQL = f"WITH {_DIMS}, {_HEADERS}, {_LINES}, {_VIEW}\n"


def _money(column: str) -> str:
    return f"CAST(sum({column}) AS DECIMAL(38,6))"


# --- extraction ---------------------------------------------------------------------


@query(MART_SQL + f"SELECT * FROM headers WHERE {_IN_SCOPE}")
def in_scope_orders(spark, root):
    header = adapter.sales_order_header(spark, root)
    return mart.in_scope(header, SCOPE).withColumnsRenamed(
        {"customer_id": "source_customer_id", "territory_id": "source_territory_id"})


@query(MART_SQL + "SELECT * FROM lines")
def order_lines(spark, root):
    return mart.order_lines(
        adapter.sales_order_header(spark, root), adapter.sales_order_detail(spark, root, scope=SCOPE), SCOPE
    ).withColumn("line_net_amount", F.col("line_net_amount").cast("decimal(19,6)"))


@query(MART_SQL + "SELECT * FROM products")
def product_hierarchy(spark, root):
    return mart.product_hierarchy(
        adapter.product(spark, root), adapter.subcategory(spark, root).drop("p_type", "p_brand"),
        adapter.category(spark, root))


@query(MART_SQL + "SELECT * FROM sales")
def sales_view(spark, root):
    return view_of(spark, root)


@query(MART_SQL + """
SELECT order_date AS full_date, territory_name, count(*) AS line_count,
       CAST(sum(order_qty) AS BIGINT) AS quantity
FROM sales GROUP BY ALL""")
def fact_date_territory(spark, root):
    m = mart_of(spark, root)
    rows = mart.fact_date_dim(
        m.fact, m.dims["dim_date"], m.dims["dim_territory"].select("territory_key", "territory_name"), "territory_key")
    return rows.groupBy("full_date", "territory_name").agg(
        F.count(F.lit(1)).alias("line_count"), F.sum(F.col("order_qty").cast("long")).alias("quantity"))


@query(MART_SQL + """
SELECT l.sales_order_id, l.sales_order_detail_id, p.product_key, c.customer_key, t.territory_key
FROM lines l JOIN keyed_products p USING (source_product_id) JOIN keyed_customers c USING (source_customer_id)
JOIN keyed_territories t ON t.source_territory_id = coalesce(l.source_territory_id, 0)""")
def lookup_surrogate(spark, root):
    lines = mart.order_lines(
        adapter.sales_order_header(spark, root), adapter.sales_order_detail(spark, root, scope=SCOPE), SCOPE)
    dims = mart_of(spark, root).dims
    df = mart.lookup_surrogate(lines, dims["dim_product"], "source_product_id", "product_key")
    df = mart.lookup_surrogate(df, dims["dim_customer"].drop("territory_key"), "source_customer_id", "customer_key")
    df = mart.lookup_surrogate(df, dims["dim_territory"], "source_territory_id", "territory_key", optional=True)
    return df.select("sales_order_id", "sales_order_detail_id",
                     *[F.col(k).cast("long").alias(k) for k in ("product_key", "customer_key", "territory_key")])


@query("""
SELECT CAST(row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS line_key,
       l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem""")
def assign_keys(spark, root):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    keyed = mart.assign_keys(table(spark, root, "lineitem").select(*order), order, 0, "line_key")
    return keyed.withColumn("line_key", F.col("line_key").cast("long"))


# --- calendar and scalar functions -----------------------------------------------------


@query("""
SELECT CAST(year(d) * 10000 + month(d) * 100 + day(d) AS INTEGER) AS date_key, d AS full_date,
       CAST(year(d) AS INTEGER) AS calendar_year, CAST(quarter(d) AS INTEGER) AS calendar_quarter,
       CAST(month(d) AS INTEGER) AS calendar_month, monthname(d) AS month_name, CAST(day(d) AS INTEGER) AS day_of_month,
       count(o_orderkey) AS orders
FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d
      FROM (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders))
LEFT JOIN orders ON CAST(o_orderdate AS DATE) = d
GROUP BY d""")
def calendar_dim(spark, root):
    """Calendar over the order dates' range with the orders of each day."""
    orders = table(spark, root, "orders")
    low, high = orders.agg(F.to_date(F.min("o_orderdate")), F.to_date(F.max("o_orderdate"))).first()
    per_day = orders.groupBy(F.to_date("o_orderdate").alias("full_date")).agg(F.count("o_orderkey").alias("orders"))
    return S.calendar_dim(spark, str(low), str(high)).join(per_day, "full_date", "left").withColumn(
        "orders", F.coalesce("orders", F.lit(0)))


@query("""
SELECT o_orderkey, CAST(date_trunc('day', o_orderdate) AS DATE) AS day_bucket,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS month_bucket,
       CAST(date_trunc('year', o_orderdate) AS DATE) AS year_bucket,
       CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INTEGER) AS date_key
FROM orders""")
def date_buckets(spark, root):
    day = F.col("o_orderdate")
    return table(spark, root, "orders").select(
        "o_orderkey", *[S.date_bucket(day, b).alias(f"{b}_bucket") for b in ("day", "month", "year")],
        S.date_key(day).alias("date_key"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CAST(round(CAST(l_quantity AS INTEGER) * CAST(p_retailprice AS DECIMAL(19,4))
            * (1 - CAST(l_discount AS DECIMAL(19,4))), 6) AS DECIMAL(38,6)) AS line_net_amount,
       CAST(l_extendedprice AS DECIMAL(19,4)) AS amount_4, CAST(l_extendedprice AS DECIMAL(19,6)) AS amount_6,
       CAST(l_extendedprice AS DECIMAL(38,6)) AS amount_wide,
       CASE WHEN nullif(l_tax, 0) IS NULL THEN 'none' ELSE 'taxed' END AS tax_label,
       coalesce(nullif(l_returnflag, 'N'), 'kept') AS return_label
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def line_amounts(spark, root):
    """Exact line amounts, decimal casts and NULL logic."""
    lines = table(spark, root, "lineitem").join(
        table(spark, root, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    price = F.col("l_extendedprice")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        S.line_net_amount(F.col("l_quantity"), F.col("p_retailprice"), F.col("l_discount")).alias("line_net_amount"),
        price.cast("decimal(19,4)").alias("amount_4"), price.cast("decimal(19,6)").alias("amount_6"),
        price.cast("decimal(38,6)").alias("amount_wide"),
        F.when(F.nullif(F.col("l_tax"), F.lit(0.0)).isNull(), "none").otherwise("taxed").alias("tax_label"),
        F.coalesce(F.nullif(F.col("l_returnflag"), F.lit("N")), F.lit("kept")).alias("return_label"),
    )


@query(MART_SQL + """
SELECT source_customer_id, CAST(round(CAST(sum(line_net_amount) AS DECIMAL(38,6)) / count(DISTINCT sales_order_id), 6)
       AS DECIMAL(38,6)) AS aov
FROM lines GROUP BY source_customer_id""")
def aov_by_customer(spark, root):
    totals = view_of(spark, root).groupBy("source_customer_id").agg(
        F.sum("line_net_amount").alias("net"), F.count_distinct("sales_order_id").alias("orders"))
    return totals.select("source_customer_id", S.average_order_value(F.col("net"), F.col("orders")).alias("aov"))


# --- summaries and dashboard ---------------------------------------------------------------


@query(MART_SQL + f"""
SELECT CAST(date_trunc('month', order_date) AS DATE) AS month,
       coalesce(product_category_name, 'Unknown') AS category, {_money('line_net_amount')} AS sales_amount
FROM sales WHERE order_date >= DATE '1996-01-01' AND order_date < DATE '2001-01-01' GROUP BY 1, 2""")
def sales_by_month_category(spark, root):
    return reports.sales_by_month_category(report_of(spark, root), "1996-01-01", "2000-12-31")


_SUMMARY = f"""count(*) AS line_count, count(DISTINCT sales_order_id) AS order_count,
       CAST(sum(order_qty) AS BIGINT) AS quantity, {_money('line_net_amount')} AS net_sales,
       {_money('source_line_total')} AS source_line_total"""

CATEGORY_SUMMARY_SQL = f"""SELECT CAST(date_trunc('month', order_date) AS DATE) AS month_start,
       coalesce(source_product_category_id, 0) AS product_category_id,
       coalesce(s.product_category_name, 'Unknown') AS product_category_name, {_SUMMARY}
FROM sales s JOIN products p ON p.source_product_id = s.source_product_id GROUP BY 1, 2, 3"""

TERRITORY_SUMMARY_SQL = f"""SELECT CAST(date_trunc('month', order_date) AS DATE) AS month_start,
       source_territory_id AS territory_id, territory_name, {_SUMMARY}
FROM sales GROUP BY 1, 2, 3"""


def category_summary(m: load.Mart) -> DataFrame:
    return reports.monthly_category_summary(m.fact, m.dims["dim_date"], m.dims["dim_product"])


@query(MART_SQL + CATEGORY_SUMMARY_SQL)
def monthly_category_summary(spark, root):
    return category_summary(mart_of(spark, root))


@query(MART_SQL + TERRITORY_SUMMARY_SQL)
def monthly_territory_summary(spark, root):
    m = mart_of(spark, root)
    return reports.monthly_territory_summary(m.fact, m.dims["dim_date"], m.dims["dim_territory"])


DASHBOARD = ("1997-03-15", "2000-09-20", ["NATION_1", "NATION_7", "NATION_12", "Unknown"],
             ["LARGE", "PROMO", "Unknown"])
_PICK = """order_date BETWEEN DATE '1997-03-15' AND DATE '2000-09-20'
  AND coalesce(territory_name, 'Unknown') IN ('NATION_1', 'NATION_7', 'NATION_12', 'Unknown')
  AND coalesce(product_category_name, 'Unknown') IN ('LARGE', 'PROMO', 'Unknown')"""


def selected(spark, root):
    return reports.dashboard_filter(report_of(spark, root), *DASHBOARD)


@query(MART_SQL + f"SELECT * FROM sales WHERE {_PICK}")
def dashboard_filter(spark, root):
    return reports.dashboard_filter(view_of(spark, root), *DASHBOARD)


@query(MART_SQL + f"SELECT {_money('line_net_amount')} AS value FROM sales WHERE {_PICK}")
def kpi_sales(spark, root):
    return reports.kpi_sales(selected(spark, root))


@query(MART_SQL + f"SELECT count(DISTINCT sales_order_id) AS value FROM sales WHERE {_PICK}")
def kpi_orders(spark, root):
    return reports.kpi_orders(selected(spark, root))


_AOV = "CAST(round(sum(line_net_amount) / nullif(count(DISTINCT sales_order_id), 0), 6) AS DECIMAL(38,6))"


@query(MART_SQL + f"SELECT {_AOV} AS value FROM sales WHERE {_PICK}")
def kpi_aov(spark, root):
    return reports.kpi_aov(selected(spark, root))


@query(MART_SQL + f"""
SELECT min(order_date) AS time, {_money('line_net_amount')} AS sales_amount FROM sales WHERE {_PICK}
GROUP BY date_trunc('month', order_date)""")
def monthly_trend(spark, root):
    return reports.monthly_trend(selected(spark, root))


@query(MART_SQL + f"""
SELECT coalesce(product_category_name, 'Unknown') AS category, {_money('line_net_amount')} AS sales_amount
FROM sales WHERE {_PICK} GROUP BY 1""")
def sales_by_category(spark, root):
    return reports.sales_by_category(selected(spark, root))


@query(MART_SQL + f"""
SELECT coalesce(territory_name, 'Unknown') AS territory, {_money('line_net_amount')} AS sales_amount
FROM sales WHERE {_PICK} GROUP BY 1""")
def sales_by_territory(spark, root):
    return reports.sales_by_territory(selected(spark, root))


_QUALITY = f"""count(*) AS line_count, count(DISTINCT sales_order_id) AS order_count,
       CAST(sum(order_qty) AS BIGINT) AS quantity, {_money('line_net_amount')} AS line_net_amount,
       {_money('source_line_total')} AS source_line_total"""


@query(MART_SQL + f"SELECT {_QUALITY} FROM sales WHERE {_PICK}")
def quality_summary(spark, root):
    return reports.quality_summary(selected(spark, root))


@query(MART_SQL + f"""
SELECT {_QUALITY}, {_AOV} AS aov FROM sales WHERE order_date BETWEEN DATE '2030-01-01' AND DATE '2030-12-31'""")
def quality_summary_empty(spark, root):
    """A range without data: counts 0, sums and average NULL."""
    rows = reports.dashboard_filter(report_of(spark, root), "2030-01-01", "2030-12-31")
    return reports.quality_summary(rows).withColumn("aov", S.average_order_value(
        F.col("line_net_amount"), F.col("order_count")))


@query(MART_SQL + "SELECT DISTINCT coalesce(territory_name, 'Unknown') AS value FROM sales")
def distinct_territories(spark, root):
    return reports.distinct_values(report_of(spark, root), "territory_name")


@query(MART_SQL + "SELECT DISTINCT coalesce(product_category_name, 'Unknown') AS value FROM sales")
def distinct_categories(spark, root):
    return reports.distinct_values(report_of(spark, root), "product_category_name")


@query(MART_SQL + f"""
, picked AS (SELECT * FROM sales WHERE {_PICK}),
q AS (SELECT {_QUALITY}, {_AOV} AS aov FROM picked),
v AS (SELECT CAST(order_count AS DECIMAL(38,6)) AS o, line_net_amount AS n, source_line_total AS s, aov AS a FROM q)
SELECT 'orders_equal_quality_orders' AS "check", o AS left_value, o AS right_value, true AS same FROM v
UNION ALL SELECT 'quality_net_equals_sales', n, n, true FROM v
UNION ALL SELECT 'quality_source_equals_sales', s, n, abs(s - n) <= 0.000001 FROM v
UNION ALL SELECT 'aov_rederived', a, a, true FROM v
UNION ALL SELECT 'trend_sums_to_sales', n, n, true FROM v
UNION ALL SELECT 'category_sums_to_sales', n, n, true FROM v
UNION ALL SELECT 'territory_sums_to_sales', n, n, true FROM v
UNION ALL SELECT 'no_point_before_start', CAST(0 AS DECIMAL(38,6)), CAST(0 AS DECIMAL(38,6)), true""")
def check_panels(spark, root):
    return quality.check_panels(reports.panels(selected(spark, root)), DASHBOARD[0])


# --- totals, reconciliation ---------------------------------------------------------------

_TOTALS = f"""count(*) AS fact_count, CAST(coalesce(sum(order_qty), 0) AS BIGINT) AS quantity,
       CAST(coalesce(sum(line_net_amount), 0) AS DECIMAL(38,6)) AS line_net_amount,
       CAST(coalesce(sum(source_line_total), 0) AS DECIMAL(38,6)) AS source_line_total,
       count(DISTINCT sales_order_id) AS order_count"""


@query(MART_SQL + f"SELECT {_TOTALS} FROM lines")
def scope_totals(spark, root):
    m = mart_of(spark, root)
    return quality.target_totals(m.fact, m.dims["dim_date"], SCOPE)


_NARROW = Scope("1997-01-01", "1999-12-31")


@query(MART_SQL + """
, flagged AS (SELECT *, order_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AS hit FROM sales)
SELECT count(*) AS view_count, count(*) FILTER (hit) AS fact_count,
       CAST(coalesce(sum(order_qty) FILTER (hit), 0) AS BIGINT) AS quantity,
       CAST(coalesce(sum(line_net_amount) FILTER (hit), 0) AS DECIMAL(38,6)) AS line_net_amount,
       CAST(coalesce(sum(source_line_total) FILTER (hit), 0) AS DECIMAL(38,6)) AS source_line_total,
       count(DISTINCT CASE WHEN hit THEN sales_order_id END) AS order_count
FROM flagged""")
def conditional_totals(spark, root):
    return quality.conditional_totals(mart.scope_flag(view_of(spark, root), _NARROW))


@query(MART_SQL + """
SELECT sales_order_id, sales_order_detail_id,
       (order_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31') AS in_scope FROM sales""")
def scope_flag(spark, root):
    return mart.scope_flag(view_of(spark, root), _NARROW).select(
        "sales_order_id", "sales_order_detail_id", "in_scope")


_MEASURES = ", ".join(f"('{m}', CAST({m} AS VARCHAR))" for m in quality.TOTALS)
_RECONCILED = f"""
, t AS (SELECT {_TOTALS} FROM lines)
SELECT m.measure, m.v AS left_value, m.v AS right_value, true AS same
FROM t, LATERAL (VALUES {_MEASURES}) AS m(measure, v)"""


@query(MART_SQL + _RECONCILED)
def reconcile_load(spark, root):
    m = mart_of(spark, root)
    source = quality.scope_totals(mart.order_lines(
        adapter.sales_order_header(spark, root), adapter.sales_order_detail(spark, root, with_ids=False), SCOPE))
    return quality.reconcile(source, quality.target_totals(m.fact, m.dims["dim_date"], SCOPE))


@query(MART_SQL + _RECONCILED)
def reconcile_view(spark, root):
    m = mart_of(spark, root)
    seen = quality.conditional_totals(mart.scope_flag(m.view, SCOPE))
    return quality.reconcile(quality.target_totals(m.fact, m.dims["dim_date"], SCOPE), seen)


@query(MART_SQL + f"""
SELECT count(*) AS line_count, CAST(sum(order_qty) AS BIGINT) AS quantity,
       {_money('line_net_amount')} AS net_sales, {_money('source_line_total')} AS source_line_total,
       CAST(NULL AS VARCHAR) AS reason FROM lines""")
def table_totals(spark, root):
    return quality.table_totals(quality.summary_table_totals(category_summary(mart_of(spark, root))))


@query(MART_SQL + f""", expected AS ({CATEGORY_SUMMARY_SQL}),
actual AS (SELECT month_start, product_category_id, upper(product_category_name) AS product_category_name,
                  line_count, order_count, quantity, net_sales, source_line_total FROM expected)
SELECT (SELECT count(*) FROM (SELECT * FROM expected EXCEPT SELECT * FROM actual)) AS missing_groups,
       (SELECT count(*) FROM (SELECT * FROM actual EXCEPT SELECT * FROM expected)) AS unexpected_groups,
       (SELECT CAST(count(*) AS BIGINT) FROM actual) AS summary_rows""")
def diff_both_ways(spark, root):
    """Summary against a copy whose label was changed to upper case."""
    expected = category_summary(mart_of(spark, root))
    actual = expected.withColumn("product_category_name", F.upper("product_category_name"))
    return quality.diff_both_ways(expected, actual)


@query(MART_SQL + f""", expected AS ({CATEGORY_SUMMARY_SQL})
SELECT 'line_count' AS "check", sum(line_count) = (SELECT count(*) FROM lines) AS same FROM expected
UNION ALL SELECT 'quantity', sum(quantity) = (SELECT sum(order_qty) FROM lines) FROM expected
UNION ALL SELECT 'net_sales', sum(net_sales) = (SELECT sum(line_net_amount) FROM lines) FROM expected
UNION ALL SELECT 'source_line_total', sum(source_line_total) = (SELECT sum(source_line_total) FROM lines) FROM expected
UNION ALL SELECT 'missing_groups', true UNION ALL SELECT 'unexpected_groups', true
UNION ALL SELECT 'summary_rows', count(*) > 0 FROM expected""")
def reconcile_summary(spark, root):
    m = mart_of(spark, root)
    summaries = load.refresh_summaries(m, scale.new_path(spark, "summaries"))
    return quality.reconcile_summary(m.fact, category_summary(m), summaries["monthly_category_summary"])


@query(MART_SQL + f"""
, points AS (SELECT date_trunc('month', order_date) AS month, coalesce(product_category_name, 'Unknown') AS category,
                    {_money('line_net_amount')} AS sales_amount FROM sales GROUP BY 1, 2)
, sums AS (SELECT category, {_money('sales_amount')} AS rolled FROM points GROUP BY category),
both_sides AS (SELECT category, rolled, CAST(rolled + CASE WHEN category < 'M' THEN 0.01 ELSE 0 END AS DECIMAL(38,6)) AS independent FROM sums)
SELECT *, rolled = independent AS same FROM both_sides""")
def rollup_compare(spark, root):
    """The report by category with a cent too much in some of its rows."""
    view = report_of(spark, root)
    cent = F.when(F.col("category") < "M", F.lit("0.01")).otherwise("0").cast("decimal(38,6)")
    report = reports.sales_by_category(view)
    return quality.rollup_compare(
        reports.sales_by_month_category(view, SCOPE.start, SCOPE.end),
        report.withColumn("sales_amount", (F.col("sales_amount") + cent).cast("decimal(38,6)")))


@query(MART_SQL + f"SELECT {_TOTALS} FROM lines")
def preview_totals(spark, root):
    """The dry run's measures, pivoted back to one row."""
    rows = load.preview_load(adapter.mart_sources(spark, root, scope=SCOPE), SCOPE)
    wide = rows.groupBy().pivot("measure", quality.TOTALS).agg(F.first("value"))
    kinds = {"line_net_amount": "decimal(38,6)", "source_line_total": "decimal(38,6)"}
    return wide.select(*[F.col(m).cast(kinds.get(m, "long")).alias(m) for m in quality.TOTALS])


@query(MART_SQL + f"""
, t AS (SELECT {_TOTALS} FROM lines)
SELECT fact_count AS target_fact_rows, fact_count AS reporting_view_rows, quantity, order_count AS orders,
       line_net_amount, source_line_total, (SELECT count(*) FROM products) AS source_products,
       (SELECT count(*) FROM customers) AS source_customers, (SELECT count(*) FROM territories) AS source_territories,
       fact_count AS source_facts, CAST(round(line_net_amount / order_count, 6) AS DECIMAL(38,6)) AS aov,
       '1995-06-01' AS scope_start, '2001-06-30' AS scope_end, 'COMMITTED' AS status
FROM t""")
def load_mart(spark, root):
    """A complete load into an empty mart; the receipt without its digest."""
    target = scale.new_path(spark, "mart")
    receipt = load.load_mart(adapter.mart_sources(spark, root, scope=SCOPE), target, SCOPE).drop("receipt_sha256")
    _MARTS[(spark.sparkContext.applicationId, root)] = load.open_mart(spark, target)
    return receipt


@query(MART_SQL + """
, m AS (SELECT *, CAST(strftime(order_date, '%Y%m') AS INTEGER) AS order_month FROM lines),
n AS (SELECT *, order_month % 5 = 0 AND sales_order_id % 3 = 0 AND source_customer_id <> 1 AS moved FROM m)
SELECT order_month, bool_or(moved) AS rewritten, count(*) AS lines, count(DISTINCT CASE WHEN moved THEN 1 ELSE source_customer_id END) AS customers
FROM n GROUP BY order_month""")
def reload_mart(spark, root):
    """A second load in which orders of some months have another customer: which months were written anew."""
    target = scale.new_path(spark, "mart")
    sources = adapter.mart_sources(spark, root, scope=SCOPE)
    load.load_mart(sources, target, SCOPE)
    before = load.fact_months(current_paths(spark, target))
    moved = (F.date_format("order_date", "yyyyMM").cast("int") % 5 == 0) & (F.col("sales_order_id") % 3 == 0)
    header = sources["sales_order_header"].withColumn("customer_id", F.when(moved, F.lit(1).cast("long")).otherwise(F.col("customer_id")))
    load.load_mart({**sources, "sales_order_header": header}, target, SCOPE)
    after = load.fact_months(current_paths(spark, target))
    rewritten = [m for m in after if before.get(m) != after[m]]
    fact = load.open_mart(spark, target).fact.withColumn("order_month", mart.order_month())
    return fact.groupBy("order_month").agg(
        F.bool_or(F.col("order_month").isin(rewritten)).alias("rewritten"), F.count(F.lit(1)).alias("lines"),
        F.countDistinct("customer_key").alias("customers"))


# --- quality rules on the whole source (out-of-scope rows break scope rules) ---------------


def _all_lines(spark, root):
    return mart.order_lines(adapter.sales_order_header(spark, root), adapter.sales_order_detail(spark, root))


_ALL_LINES = """
, every AS (SELECT h.sales_order_id, d.sales_order_detail_id, h.order_date, h.status, h.currency_rate_id,
                   d.source_product_id, h.source_customer_id, h.source_territory_id, d.order_qty, d.unit_price,
                   d.unit_price_discount
            FROM headers h JOIN details d USING (sales_order_id))"""


@query(MART_SQL + _ALL_LINES + """
SELECT 'fact_outside_date_scope' AS rule, sales_order_id || '/' || sales_order_detail_id AS "key",
       CAST(CAST(order_date AS DATE) AS VARCHAR) AS detail
FROM every WHERE NOT (CAST(order_date AS DATE) BETWEEN DATE '1995-06-01' AND DATE '2001-06-30')
UNION ALL SELECT 'fact_status_out_of_scope', sales_order_id || '/' || sales_order_detail_id, CAST(status AS VARCHAR)
FROM every WHERE status <> 5
UNION ALL SELECT 'fact_currency_out_of_scope', sales_order_id || '/' || sales_order_detail_id,
       CAST(currency_rate_id AS VARCHAR)
FROM every WHERE currency_rate_id IS NOT NULL""")
def check_in_scope(spark, root):
    return quality.check_in_scope(_all_lines(spark, root), SCOPE)


@query("""
SELECT 'duplicate_line_number' AS rule, l_orderkey || '/' || l_linenumber AS "key", CAST(count(*) AS VARCHAR) AS detail
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def check_fact_key(spark, root):
    """The driver's (order, line number) is not unique, so the rule has violations to report."""
    keyed = table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("sales_order_id"), F.col("l_linenumber").alias("sales_order_detail_id"))
    return quality.check_fact_key(keyed).withColumn("rule", F.lit("duplicate_line_number"))


@query("""
SELECT 'duplicate_customer_id' AS rule, CAST(o_custkey AS VARCHAR) AS "key", CAST(count(*) AS VARCHAR) AS detail
FROM orders GROUP BY o_custkey HAVING count(*) > 1
UNION ALL SELECT 'reserved_customer_id_zero', '0', '0' FROM orders WHERE o_custkey = 0""")
def check_unique(spark, root):
    return quality.check_unique(table(spark, root, "orders").select("o_custkey"), "o_custkey", "customer_id")


@query(MART_SQL + _ALL_LINES + """
SELECT 'invalid_order_qty' AS rule, sales_order_id || '/' || sales_order_detail_id AS "key",
       CAST(order_qty - 3 AS VARCHAR) AS detail FROM every WHERE order_qty - 3 <= 0
UNION ALL SELECT 'invalid_amount', sales_order_id || '/' || sales_order_detail_id,
       unit_price || '|' || CAST(unit_price_discount - 0.01 AS DECIMAL(19,4))
FROM every WHERE unit_price_discount - 0.01 < 0""")
def check_domain(spark, root):
    """Whole lines with quantity and discount shifted down, so both rules have violations."""
    shifted = _all_lines(spark, root).withColumns({
        "order_qty": F.col("order_qty") - 3,
        "unit_price_discount": (F.col("unit_price_discount") - F.lit("0.01").cast("decimal(19,4)")).cast("decimal(19,4)"),
    })
    return quality.check_domain(shifted)


@query(MART_SQL + """
SELECT 'line_total_mismatch' AS rule, sales_order_id || '/' || sales_order_detail_id AS "key",
       CAST(CAST(0.01 * order_qty AS DECIMAL(38,6)) AS VARCHAR) AS detail
FROM lines WHERE order_qty > 40""")
def check_formula(spark, root):
    """In-scope lines whose source total was raised on large quantities."""
    lines = mart.order_lines(
        adapter.sales_order_header(spark, root), adapter.sales_order_detail(spark, root, scope=SCOPE), SCOPE)
    extra = F.when(F.col("order_qty") > 40, F.col("order_qty") * F.lit("0.01").cast("decimal(3,2)")).otherwise(
        F.lit(0).cast("decimal(3,2)"))
    changed = lines.withColumn("source_line_total", (F.col("source_line_total") + extra).cast("decimal(19,6)"))
    return quality.check_formula(changed).withColumn("detail", F.col("detail").cast("decimal(38,6)").cast("string"))


@query(MART_SQL + _ALL_LINES + """
SELECT source_territory_id, count(*) AS rows FROM every
WHERE source_territory_id IS NOT NULL
  AND source_territory_id NOT IN (SELECT source_territory_id FROM territories WHERE territory_group <> 'ASIA')
GROUP BY 1""")
def find_orphans(spark, root):
    """Lines whose territory is missing from a parent table without one region."""
    lines = mart.order_lines(
        adapter.sales_order_header(spark, root), adapter.sales_order_detail(spark, root, with_ids=False))
    parent = adapter.territory(spark, root).filter("territory_group <> 'ASIA'").select(
        F.col("territory_id").alias("source_territory_id"))
    return quality.find_orphans(lines, parent, "source_territory_id").groupBy("source_territory_id").agg(
        F.count(F.lit(1)).alias("rows"))


@query("""
SELECT CAST(o_custkey AS BIGINT) AS customer, 'current' AS origin FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
UNION ALL SELECT o_custkey, 'new' FROM orders WHERE o_custkey NOT IN
  (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def insert_if_absent(spark, root):
    orders = table(spark, root, "orders")
    current = orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("customer")).distinct()
    incoming = orders.select(F.col("o_custkey").alias("customer")).distinct()
    return mart.insert_if_absent(
        current.withColumn("origin", F.lit("current")), incoming.withColumn("origin", F.lit("new")), "customer")


@query(MART_SQL + f""", expected AS ({CATEGORY_SUMMARY_SQL})
SELECT 'quantity_invalid' AS rule, strftime(month_start, '%Y-%m-%d') || '/' || product_category_id AS "key",
       CAST(quantity - 900 AS VARCHAR) AS detail FROM expected WHERE quantity - 900 <= 0
UNION ALL SELECT 'month_start_not_first_day', strftime(month_start + 1, '%Y-%m-%d') || '/' || product_category_id,
       strftime(month_start + 1, '%Y-%m-%d') FROM expected WHERE product_category_id = 0
UNION ALL SELECT 'quantity_invalid', strftime(month_start + 1, '%Y-%m-%d') || '/' || product_category_id,
       CAST(quantity - 900 AS VARCHAR) FROM expected WHERE quantity - 900 <= 0 AND product_category_id = 0""".replace(
    "expected WHERE quantity - 900 <= 0\nUNION", "expected WHERE quantity - 900 <= 0 AND product_category_id <> 0\nUNION"))
def check_summary_rules(spark, root):
    """Summary with a lowered quantity and the Unknown category moved to the second of the month."""
    changed = category_summary(mart_of(spark, root)).withColumns({
        "quantity": F.col("quantity") - 900,
        "month_start": F.when(F.col("product_category_id") == 0, F.date_add("month_start", 1)).otherwise(
            F.col("month_start")),
    })
    return quality.check_summary_rules(changed, "product_category_id")


@query(MART_SQL + f"""
, points AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month,
                    coalesce(product_category_name, 'Unknown') AS category,
                    {_money('line_net_amount')} AS sales_amount FROM sales GROUP BY 1, 2)
SELECT 'month_out_of_range' AS rule, month || '/' || category AS "key", CAST(month AS VARCHAR) AS detail
FROM points WHERE month NOT BETWEEN DATE '1996-01-01' AND DATE '2000-12-01'""")
def check_points(spark, root):
    points = reports.sales_by_month_category(report_of(spark, root), SCOPE.start, SCOPE.end)
    return quality.check_points(points, "1996-01-15", "2000-12-31")


@query("SELECT 4 AS dimensions, 4 AS canonical_dimensions, true AS canonical FROM (SELECT count(*) FROM lineitem)")
def unknown_member_check(spark, root):
    return mart.unknown_member_check(mart_of(spark, root).dims)


_FACT_SCHEMA = ",".join(":".join(part.split()) for part in mart.FACT_SCHEMA.replace("(19,", "(19;").split(",")).replace(";", ",")


@query(MART_SQL + f"""
, hashed AS (SELECT {row_sql(*mart.FACT_COLUMNS)} AS h FROM sales)
SELECT count(*) AS rows, sha256('{_FACT_SCHEMA}') AS schema_sha256, {DIGEST} AS content_sha256 FROM hashed""")
def table_fingerprint(spark, root):
    """The fingerprint of the fact; two copies are the same table when it is equal."""
    return quality.table_fingerprint(mart_of(spark, root).fact)


@query(MART_SQL + """
SELECT source_customer_id, customer_key, CASE WHEN source_customer_id % 2 = 0 THEN 0
       ELSE coalesce(source_territory_id, 0) END AS territory_key FROM keyed_customers
UNION ALL SELECT 0, 0, 0
UNION ALL SELECT source_customer_id + 1000000000,
       (SELECT count(*) FROM customers) + row_number() OVER (ORDER BY source_customer_id),
       source_territory_id FROM customers WHERE source_territory_id = 3""")
def upsert_type1(spark, root):
    """Second load of customers: even ids lose their territory, new ids are appended."""
    dims = mart_of(spark, root).dims
    customers = adapter.customer(spark, root).select(
        F.col("customer_id").alias("source_customer_id"), F.col("territory_id").alias("source_territory_id"))
    lost = F.col("source_customer_id") % 2 == 0
    changed = customers.filter(lost).withColumn("source_territory_id", F.lit(None).cast("long"))
    new = customers.filter("source_territory_id = 3").withColumn(
        "source_customer_id", F.col("source_customer_id") + 1000000000)
    incoming = mart.lookup_surrogate(
        changed.unionByName(new), dims["dim_territory"], "source_territory_id", "territory_key", optional=True)
    merged = mart.upsert_type1(
        dims["dim_customer"], incoming, "source_customer_id", ["source_territory_id", "territory_key"], "customer_key")
    return merged.select("source_customer_id", F.col("customer_key").cast("long").alias("customer_key"), "territory_key")


@query(MART_SQL + """
SELECT sales_order_id, sales_order_detail_id, CASE WHEN order_qty > 25 THEN order_qty + 1 ELSE order_qty END AS order_qty
FROM lines
UNION ALL SELECT sales_order_id + 1000000000, sales_order_detail_id, order_qty FROM lines WHERE order_qty > 45""")
def upsert_fact(spark, root):
    """Changed quantities replace matching lines, lines of new orders are added."""
    fact = mart_of(spark, root).fact
    changed = fact.filter("order_qty > 25").withColumn("order_qty", F.col("order_qty") + 1)
    added = fact.filter("order_qty > 45").withColumn("sales_order_id", F.col("sales_order_id") + 1000000000)
    merged = mart.upsert_fact(fact, changed.unionByName(added))
    return merged.select("sales_order_id", "sales_order_detail_id", "order_qty")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 5 THEN 0 ELSE 1 END AS left_rows,
       CASE WHEN o_orderkey % 97 = 3 THEN 0 WHEN o_orderkey % 97 = 11 THEN 2 ELSE 1 END AS right_rows,
       CASE o_orderkey % 97 WHEN 3 THEN 'missing' WHEN 5 THEN 'extra' ELSE 'changed' END AS finding
FROM orders WHERE o_orderkey % 97 IN (3, 5, 7, 9, 11)""")
def compare_copies(spark, root):
    """Orders against a copy that lost rows, has rows of its own, changed or NULL cells, and a repeated row."""
    orders, k = table(spark, root, "orders"), F.col("o_orderkey") % 97
    changed = orders.filter(k != 3).withColumns({
        "o_orderstatus": F.when(k == 7, "X").otherwise(F.col("o_orderstatus")), "o_orderpriority": F.when(k != 9, F.col("o_orderpriority"))})
    return copies.compare_copies(orders.filter(k != 5), changed.unionByName(orders.filter(k == 11)), ["o_orderkey"])


@query(MART_SQL + """
SELECT 'order_qty' AS "column", 'int' AS left_type, count(*) AS left_rows, 0 AS left_nulls, CAST(sum(order_qty) AS VARCHAR) AS left_total,
       'int' AS right_type, count(*) AS right_rows, 0 AS right_nulls, CAST(sum(order_qty + CASE WHEN order_qty = 50 THEN 1 ELSE 0 END) AS VARCHAR) AS right_total FROM sales
UNION ALL
SELECT 'status', 'int', count(*), 0, CAST(sum(status) AS VARCHAR), 'int', count(*), count(*) FILTER (order_qty < 3), CAST(sum(CASE WHEN order_qty >= 3 THEN status END) AS VARCHAR) FROM sales
UNION ALL
SELECT 'line_net_amount', 'decimal(19,6)', count(*), 0, CAST(CAST(sum(line_net_amount) AS DECIMAL(38,6)) AS VARCHAR), NULL, NULL, NULL, NULL FROM sales""")
def compare_totals(spark, root):
    """The fact against a copy with changed quantities, NULLs and a column less."""
    fact = mart_of(spark, root).fact
    q = F.col("order_qty")
    return copies.compare_totals(fact, fact.withColumns({
        "status": F.when(q >= 3, F.col("status")), "order_qty": F.when(q == 50, 51).otherwise(q)}).drop("line_net_amount"))


@query(MART_SQL + """
SELECT 'customer' AS name, count(*) AS rows, CAST(sum(source_customer_id) AS BIGINT) AS ids, 'bigint,bigint' AS types FROM customers
UNION ALL SELECT 'product', count(*), CAST(sum(source_product_id) AS BIGINT), 'bigint,string,string,bigint' FROM products
UNION ALL SELECT 'sales_territory', count(*), CAST(sum(source_territory_id) AS BIGINT), 'bigint,string,string,string' FROM territories
UNION ALL SELECT 'sales_order_header', count(*), CAST(sum(sales_order_id) AS BIGINT), 'bigint,timestamp,bigint,bigint,int,bigint' FROM headers
UNION ALL SELECT 'sales_order_detail', count(*), CAST(sum(sales_order_id) AS BIGINT), 'bigint,bigint,bigint,int,decimal(19,4),decimal(19,4),decimal(19,6)' FROM details
UNION ALL SELECT 'product_category', count(*), CAST(sum(id) AS BIGINT), 'bigint,string' FROM cat
UNION ALL SELECT 'product_subcategory', count(*), CAST(sum(id) AS BIGINT), 'bigint,string,bigint' FROM sub""")
def read_sources(spark, root):
    """The seven source tables, written from the driver tables and read back with their declared types."""
    folder = scale.new_path(spark, "sources")
    for name, df in adapter.mart_sources(spark, root).items():
        declared = [f.split(" ")[0] for f in readers.SOURCE_SCHEMAS[name].split(", ")]
        df.select(*declared).write.parquet(f"{folder}/{name}.parquet")
    parts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.sum(df.columns[0]).alias("ids"),
                    F.lit(",".join(kind for _, kind in df.dtypes)).alias("types")) for name, df in readers.read_sources(spark, folder).items()]
    return reduce(DataFrame.unionByName, parts)


# --- checks that find something: the same rules on tables with faults ----------------------


def _pairs_sql(left: str, right: str) -> str:
    """Measures of two one-row CTEs side by side, compared in SQL."""
    return f"""
SELECT l.measure, l.v AS left_value, r.v AS right_value, l.v IS NOT DISTINCT FROM r.v AS same
FROM (SELECT m.* FROM {left}, LATERAL (VALUES {_MEASURES}) AS m(measure, v)) l
JOIN (SELECT m.* FROM {right}, LATERAL (VALUES {_MEASURES}) AS m(measure, v)) r USING (measure)"""


@query(MART_SQL + f"""
, s AS (SELECT {_TOTALS} FROM lines),
t AS (SELECT {_TOTALS} FROM (SELECT * REPLACE (CAST(line_net_amount + CASE WHEN order_qty = 7 THEN 0.01 ELSE 0 END AS DECIMAL(19,6)) AS line_net_amount)
                             FROM lines WHERE order_qty <> 50))""" + _pairs_sql("s", "t"))
def reconcile_faulty_load(spark, root):
    """A fact that lost lines and has other amounts against its source."""
    m, q = mart_of(spark, root), F.col("order_qty")
    source = quality.scope_totals(mart.order_lines(
        adapter.sales_order_header(spark, root), adapter.sales_order_detail(spark, root, with_ids=False), SCOPE))
    amount = (F.col("line_net_amount") + F.when(q == 7, F.lit("0.01").cast("decimal(19,6)")).otherwise(F.lit("0").cast("decimal(19,6)"))).cast("decimal(19,6)")
    return quality.reconcile(source, quality.target_totals(m.fact.filter(q != 50).withColumn("line_net_amount", amount), m.dims["dim_date"], SCOPE))


@query(MART_SQL + f"""
, t AS (SELECT {_TOTALS} FROM lines), v AS (SELECT {_TOTALS} FROM (SELECT * FROM lines UNION ALL SELECT * FROM lines WHERE order_qty = 9))""" + _pairs_sql("t", "v"))
def reconcile_faulty_view(spark, root):
    """A view that repeats lines against its fact."""
    m = mart_of(spark, root)
    view = m.view.unionByName(m.view.filter("order_qty = 9"))
    return quality.reconcile(quality.target_totals(m.fact, m.dims["dim_date"], SCOPE), quality.conditional_totals(mart.scope_flag(view, SCOPE)))


@query(MART_SQL + f"""
, expected AS ({CATEGORY_SUMMARY_SQL}),
actual AS (SELECT * REPLACE (CASE WHEN product_category_name = 'LARGE' THEN quantity + 1 ELSE quantity END AS quantity) FROM expected
           WHERE NOT (product_category_name = 'PROMO' AND month(month_start) = 3)),
f AS (SELECT count(*) AS n, sum(order_qty) AS q, sum(line_net_amount) AS a, sum(source_line_total) AS s FROM lines)
SELECT 'line_count' AS "check", sum(line_count) = (SELECT n FROM f) AS same FROM actual
UNION ALL SELECT 'quantity', sum(quantity) = (SELECT q FROM f) FROM actual
UNION ALL SELECT 'net_sales', sum(net_sales) = (SELECT a FROM f) FROM actual
UNION ALL SELECT 'source_line_total', sum(source_line_total) = (SELECT s FROM f) FROM actual
UNION ALL SELECT 'missing_groups', count(*) = 0 FROM (SELECT * FROM expected EXCEPT SELECT * FROM actual)
UNION ALL SELECT 'unexpected_groups', count(*) = 0 FROM (SELECT * FROM actual EXCEPT SELECT * FROM expected)
UNION ALL SELECT 'summary_rows', count(*) > 0 FROM actual""")
def reconcile_faulty_summary(spark, root):
    """A summary without some groups and with other quantities in others."""
    m = mart_of(spark, root)
    expected = category_summary(m)
    large = F.col("product_category_name") == "LARGE"
    actual = expected.filter("NOT (product_category_name = 'PROMO' AND month(month_start) = 3)").withColumn(
        "quantity", F.when(large, F.col("quantity") + 1).otherwise(F.col("quantity")))
    return quality.reconcile_summary(m.fact, expected, actual)


@query(MART_SQL + f"""
, picked AS (SELECT * FROM sales WHERE {_PICK}),
q AS (SELECT {_QUALITY}, {_AOV} AS aov FROM picked),
x AS (
  SELECT CAST((SELECT count(DISTINCT sales_order_id) FROM picked WHERE order_qty > 1) AS DECIMAL(38,6)) AS orders,
         (SELECT {_money('line_net_amount')} FROM picked WHERE date_trunc('month', order_date) <> DATE '1998-05-01') AS trend,
         (SELECT {_money('line_net_amount')} FROM picked WHERE product_category_name = 'LARGE') AS large,
         (SELECT {_money('line_net_amount')} FROM sales WHERE {_PICK.replace("'NATION_7', ", "")}) AS three),
v AS (SELECT CAST(order_count AS DECIMAL(38,6)) AS o, line_net_amount AS n, source_line_total AS s, aov AS a, x.* FROM q, x),
early AS (SELECT CAST(count(DISTINCT date_trunc('month', order_date)) AS DECIMAL(38,6)) AS e FROM picked WHERE order_date < DATE '1998-01-01'),
pairs AS (
  SELECT 'orders_equal_quality_orders' AS "check", orders AS left_value, o AS right_value, 0 AS near FROM v
  UNION ALL SELECT 'quality_net_equals_sales', n, n, 0.000001 FROM v
  UNION ALL SELECT 'quality_source_equals_sales', s, n, 0.000001 FROM v
  UNION ALL SELECT 'aov_rederived', a, CAST(round(n / orders, 6) AS DECIMAL(38,6)), 0.000001 FROM v
  UNION ALL SELECT 'trend_sums_to_sales', trend, n, 0.000001 FROM v
  UNION ALL SELECT 'category_sums_to_sales', CAST(n - large AS DECIMAL(38,6)), n, 0.000001 FROM v
  UNION ALL SELECT 'territory_sums_to_sales', three, n, 0.000001 FROM v
  UNION ALL SELECT 'no_point_before_start', e, CAST(0 AS DECIMAL(38,6)), 0 FROM early)
SELECT "check", left_value, right_value, abs(left_value - right_value) <= near AS same FROM pairs""")
def check_faulty_panels(spark, root):
    """Panels of one state that were made from other rows: fewer orders, a month, a category and a territory less, an earlier start."""
    rows = selected(spark, root)
    panels = reports.panels(rows)
    panels["orders"] = reports.kpi_orders(rows.filter("order_qty > 1"))
    panels["trend"] = panels["trend"].filter("date_trunc('month', time) <> DATE '1998-05-01'")
    panels["category"] = panels["category"].filter("category <> 'LARGE'")
    panels["territory"] = reports.sales_by_territory(rows.filter("coalesce(territory_name, 'Unknown') <> 'NATION_7'"))
    return quality.check_panels(panels, "1998-01-01")


@query("""
SELECT 4 AS dimensions, 4 - count(*) AS canonical_dimensions, count(*) = 0 AS canonical FROM (
  SELECT 'repeated' AS fault FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'renamed' FROM region WHERE r_regionkey = 1
  UNION ALL SELECT 'missing' FROM region WHERE r_regionkey = 2)""")
def unknown_member_faults(spark, root):
    """An Unknown member that is there twice, one with another name, and one that is missing."""
    dims = dict(mart_of(spark, root).dims)
    territory, product, customer = (dims[d] for d in ("dim_territory", "dim_product", "dim_customer"))
    dims["dim_territory"] = territory.unionByName(territory.filter("territory_key = 0"))
    dims["dim_product"] = product.withColumn("product_name", F.when(F.col("product_key") == 0, "none").otherwise(F.col("product_name")))
    dims["dim_customer"] = customer.filter("customer_key <> 0")
    return mart.unknown_member_check(dims)
