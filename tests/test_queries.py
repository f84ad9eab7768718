"""Every registered query against its SQL on the smallest driver tables, and its physical plan."""

import os
import re

import duckdb
import pytest

from martweave.queries import REGISTRY
from martweave.queries import mart as mart_queries
from martweave.plans import reports
from martweave.sources.adapter import table
from tools.compare import TABLES, rows_of

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return con


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", REGISTRY)
def test_query_equals_sql(spark, duck, name):
    fn, sql = REGISTRY[name]
    df = fn(spark, ROOT)
    plan = physical(df)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    columns, got = rows_of(df.toArrow())
    if sql is None:
        return
    assert (columns, got) == rows_of(duck.execute(sql).to_arrow_table())


def test_filters_and_columns_reach_the_scan(spark):
    fact = mart_queries.mart_of(spark, ROOT).fact
    plan = physical(reports.kpi_sales(fact.filter("order_date_key BETWEEN 19970101 AND 19971231")))
    assert re.search(r"PushedFilters: \[.*order_date_key.*19970101", plan)
    assert re.search(r"ReadSchema: struct<order_date_key:int,line_net_amount:decimal\(19,6\)>", plan)
    orders = table(spark, ROOT, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in physical(orders)


def test_report_reads_only_its_columns(spark):
    plan = physical(mart_queries.sales_by_month_category(spark, ROOT))
    assert "unit_price" not in plan and "product_number" not in plan and "customer" not in plan
    # The scan's filter list is cut off in the printed plan, so look at its first entries.
    assert re.search(r"DataFilters: \[isnotnull\(order_date_key#\d+\), \(order_date_key#\d+ >= 19960101\)", plan)
