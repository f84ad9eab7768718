"""Structured plans: golden small results, boundaries, rejected plans, exact export."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from martweave.plans import query as Q
from martweave.queries.plans import item, join, on, plan, ref
from martweave.sources.sinks import to_wire
from tests.conftest import rows


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "o": spark.createDataFrame(
            [(1, 1, D("15"), date(2026, 1, 1)), (1, 2, D("40"), date(2026, 2, 1)), (3, 1, D("6"), date(2026, 3, 1))],
            "customer_id int, tenant int, amount decimal(18,2), date date"),
        "c": spark.createDataFrame([(1, 1, "North"), (1, 2, "South")], "id int, tenant int, region string"),
    }


JOIN = join("c", "left", on("o", "customer_id", "eq", "c", "id"), on("o", "tenant", "eq", "c", "tenant"))
BOTH = {"o": "o", "c": "c"}


def test_left_join_sum_ordered(tables):
    spec = plan(BOTH, [item("c", "region", "region"), item("o", "amount", "revenue", aggregate="sum")], [JOIN],
                [{"field": ref("o", "amount"), "op": "gte", "value": 10}], ["region"], [("revenue", "desc")], 20)
    assert [tuple(r) for r in Q.run_plan(spec, tables).collect()] == [("South", D("40.00")), ("North", D("15.00"))]


def test_null_group_sorts_first(tables):
    spec = plan(BOTH, [item("c", "region", "region"), item(None, None, "n", aggregate="count")], [JOIN],
                group=["region"], order=[("region", "asc")])
    assert [tuple(r) for r in Q.run_plan(spec, tables).collect()] == [(None, 1), ("North", 1), ("South", 1)]


@pytest.mark.parametrize("limit", [1, 2, 1000])
@pytest.mark.parametrize("extra", ["none", "less", "same", "more"])
def test_limit_lookahead(spark, limit, extra):
    n = {"none": 0, "less": limit - 1, "same": limit, "more": limit + 1}[extra]
    top, flag = Q.limit_truncated(spark.range(n), limit)
    assert top.count() == min(n, limit)
    assert flag.first()["truncated"] is (n > limit)


def test_pages_follow_a_key_to_the_end(spark):
    df = spark.range(10_500).select(F.when(F.col("id") > 4, F.col("id") % 7).alias("g"), "id")
    order = [("g", True), ("id", False)]
    first = Q.page(df, order, 2)
    assert [tuple(r) for r in first.collect()] == [(6, 6, 10_500, True), (6, 13, 10_500, True)]
    far = Q.page(df, order, 3, {"g": 0, "id": 10_493})
    assert [tuple(r)[:2] for r in far.collect()] == [(None, 0), (None, 1), (None, 2)]
    last = Q.page(df, order, 3, {"g": None, "id": 3})
    assert rows(last) == [(None, 4, 10_500, False)]
    assert Q.page(df, order, 3, {"g": None, "id": 4}).count() == 0
    for size, after in ((0, None), (1, {"id": 1})):
        with pytest.raises(Q.PlanError, match="page_invalid"):
            Q.page(df, order, size, after)


def test_ascending_pages_begin_with_null(spark):
    df = spark.createDataFrame([(None,), (1,), (2,)], "v int")
    assert [r.v for r in Q.page(df, [("v", False)], 5, {"v": None}).collect()] == [1, 2]


def test_outer_joins_keep_unmatched_and_repeated_rows(tables):
    for how, expected in (("left", [(1, "North"), (1, "South"), (3, None)]), ("full", [(1, "North"), (1, "South"), (3, None), (None, "West")])):
        more = {**tables, "c": tables["c"].unionByName(tables["c"].sparkSession.createDataFrame([(None, 1, "West")], tables["c"].schema))}
        spec = plan(BOTH, [item("o", "customer_id", "id"), item("c", "region", "region")], [{**JOIN, "type": how}])
        assert rows(Q.run_plan(spec, more)) == sorted(expected, key=repr)


def test_a_plan_without_a_limit_returns_all_rows(tables):
    assert Q.run_plan(plan({"o": "o"}, [item("o", "amount", "a")]), tables).count() == 3
    assert Q.run_plan(plan({"o": "o"}, [item("o", "amount", "a")], limit=5000), tables).count() == 3


@pytest.mark.parametrize("change", [
    {"limit": 0}, {"limit": 1.5}, {"limit": True}, {"extra": 1}, {"select": []},
    {"select": [item("o", "nope", "a")]}, {"select": [item("o", "amount", "1a")]},
    {"select": [item("o", "amount", "a"), item("o", "tenant", "A")]},
    {"select": [item("o", "amount", "a", aggregate="median")]},
    {"select": [item("o", "amount", "a", bucket="month")]}, {"select": [item("o", "date", "a", bucket="week")]},
    {"select": [item("o", "amount", "a", aggregate="sum"), item("o", "tenant", "t")]},
    {"groupBy": ["missing"]}, {"orderBy": [{"field": "zz", "direction": "asc"}]},
    {"orderBy": [{"field": "a", "direction": "up"}]},
    {"filters": [{"field": ref("o", "amount"), "op": "eq", "value": None}]},
    {"filters": [{"field": ref("o", "amount"), "op": "in", "value": []}]},
    {"filters": [{"field": ref("o", "amount"), "op": "between", "value": [1]}]},
    {"filters": [{"field": ref("o", "amount"), "op": "is_null", "value": 1}]},
    {"filters": [{"field": ref("o", "amount"), "op": "gt", "value": float("inf")}]},
    {"filters": [{"field": ref("o", "amount"), "op": "like", "value": 3}]},
    {"joins": [JOIN, JOIN]},
])
def test_rejected_plans(tables, change):
    spec = {**plan({"o": "o"}, [item("o", "amount", "a")]), **change}
    with pytest.raises(Q.PlanError):
        Q.build_plan(spec, tables)


def test_join_must_link_to_what_is_joined(tables):
    wrong = join("c", "inner", on("c", "id", "eq", "o", "customer_id"))
    with pytest.raises(Q.PlanError, match="query_join_disconnected"):
        Q.build_plan(plan(BOTH, [item("o", "amount", "a")], [wrong]), tables)


@pytest.mark.parametrize("how", ["inner", "left", "full"])
def test_a_join_without_equality_is_refused(tables, how):
    theta = join("c", how, on("o", "customer_id", "lt", "c", "id"))
    with pytest.raises(Q.PlanError, match="query_theta_unsupported"):
        Q.build_plan(plan(BOTH, [item("o", "amount", "a")], [theta]), tables)


def test_wire_is_exact(spark):
    df = spark.createDataFrame(
        [(9223372036854775807, D("12345678901234567890.123456789012345678"), "", date(2026, 9, 27), False),
         (-9223372036854775808, None, "中文📦", None, True)],
        "id bigint, amount decimal(38,18), label string, day date, enabled boolean")
    assert [r[0] for r in to_wire(df).collect()] == [
        '{"id":"9223372036854775807","amount":"12345678901234567890.123456789012345678","label":"","day":"2026-09-27","enabled":false}',
        '{"id":"-9223372036854775808","amount":null,"label":"中文📦","day":null,"enabled":true}']


def test_wire_refuses_infinity(spark):
    for bad in (spark.sql("SELECT double('inf') AS t"), spark.sql("SELECT double('nan') AS t")):
        with pytest.raises(Exception, match="query_result"):
            to_wire(bad).collect()
    assert to_wire(spark.sql("SELECT repeat('x', 9000) AS t, CAST(NULL AS DOUBLE) AS d")).count() == 1


COLUMNS = [{"name": "v", "type": "number"}, {"name": "m", "type": "time"}, {"name": "w", "type": "number"}]


def test_chart_columns(spark):
    df = spark.sql("SELECT 1 AS v, DATE'2020-01-01' AS m, 2 AS w")
    chart = {"title": "T", "type": "timeseries", "x": "m", "y": ["w", "v"]}
    assert Q.chart_frame(df, chart, COLUMNS).columns == ["m", "v", "w"]
    for bad in ({"type": "pie"}, {"x": "v", "y": ["w"]}, {"y": []}, {"y": ["m"]}, {"title": " "}, {"title": "<b>"}, {"x": "v"}):
        with pytest.raises(Q.PlanError):
            Q.chart_frame(df, {**chart, **bad}, COLUMNS)
    assert Q.chart_frame(df, {"title": "T", "type": "stat", "y": ["v"]}, COLUMNS).columns == ["v"]
    assert Q.chart_frame(df, {"title": "T", "type": "table"}, COLUMNS).columns == ["v", "m", "w"]
