"""Declarative plan queries: one registered query per plan feature."""

from __future__ import annotations

from pyspark.sql import functions as F

from martweave.functions import scalars as S
from martweave.plans import query as Q
from martweave.queries.registry import query
from martweave.sources.adapter import table


def tables(spark, root, spec):
    return {n: table(spark, root, n) for n in {d["urn"] for d in spec["datasets"]}}


def ref(dataset: str, field: str) -> dict:
    return {"dataset": dataset, "field": field}


def item(dataset: str | None, field: str | None, name: str, **extra) -> dict:
    return {"field": None if field is None else ref(dataset, field), "as": name, **extra}


def on(a: str, left: str, op: str, b: str, right: str) -> dict:
    return {"left": ref(a, left), "op": op, "right": ref(b, right)}


def plan(datasets, select, joins=(), filters=(), group=(), order=(), limit=None) -> dict:
    spec = {
        "datasets": [{"urn": u, "alias": a} for a, u in datasets.items()],
        "joins": list(joins),
        "select": list(select),
        "filters": list(filters),
        "groupBy": list(group),
        "orderBy": [{"field": f, "direction": d} for f, d in order],
    }
    return spec if limit is None else {**spec, "limit": limit}


def join(dataset: str, kind: str, *predicates) -> dict:
    return {"dataset": dataset, "type": kind, "on": list(predicates)}


def whole(spark, root, spec):
    return Q.run_plan(spec, tables(spark, root, spec))


@query("SELECT p_partkey AS part_id, p_name AS part_name, p_size AS size FROM part")
def plan_project(spark, root):
    return whole(spark, root, plan({"p": "part"}, [
        item("p", "p_partkey", "part_id"), item("p", "p_name", "part_name"), item("p", "p_size", "size")]))


@query("""
SELECT o_orderkey AS id FROM orders WHERE o_custkey = 7 UNION ALL
SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 AND o_totalprice <= 450000 AND o_custkey <> 7
  AND o_orderkey >= 100 AND o_orderkey < 12000""")
def plan_compare(spark, root):
    f = lambda field, op, value: {"field": ref("o", field), "op": op, "value": value}
    base = [item("o", "o_orderkey", "id")]
    one = plan({"o": "orders"}, base, filters=[f("o_custkey", "eq", 7)])
    two = plan({"o": "orders"}, base, filters=[
        f("o_totalprice", "gt", 400000), f("o_totalprice", "lte", 450000), f("o_custkey", "ne", 7),
        f("o_orderkey", "gte", 100), f("o_orderkey", "lt", 12000)])
    return whole(spark, root, one).unionByName(whole(spark, root, two))


@query("""
SELECT p_partkey AS id, p_size AS size FROM part
WHERE p_brand IN ('Brand#2', 'Brand#11', 'Brand#25') AND p_size BETWEEN 10 AND 20""")
def plan_in_between(spark, root):
    return whole(spark, root, plan({"p": "part"}, [item("p", "p_partkey", "id"), item("p", "p_size", "size")], filters=[
        {"field": ref("p", "p_brand"), "op": "in", "value": ["Brand#2", "Brand#11", "Brand#25"]},
        {"field": ref("p", "p_size"), "op": "between", "value": [10, 20]}]))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name LIKE '%ring' AND p_type LIKE 'S_ALL'")
def plan_like(spark, root):
    return whole(spark, root, plan({"p": "part"}, [item("p", "p_partkey", "id"), item("p", "p_name", "name")], filters=[
        {"field": ref("p", "p_name"), "op": "like", "value": "%ring"},
        {"field": ref("p", "p_type"), "op": "like", "value": "S_ALL"}]))


@query("""
SELECT c_custkey AS id, o_orderkey AS order_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey < c_custkey
WHERE o_orderkey IS NULL AND c_name IS NOT NULL""")
def plan_null_tests(spark, root):
    return whole(spark, root, plan(
        {"c": "customer", "o": "orders"}, [item("c", "c_custkey", "id"), item("o", "o_orderkey", "order_id")],
        joins=[join("o", "left", on("c", "c_custkey", "eq", "o", "o_custkey"),
                    on("c", "c_custkey", "gt", "o", "o_orderkey"))],
        filters=[{"field": ref("o", "o_orderkey"), "op": "is_null"},
                 {"field": ref("c", "c_name"), "op": "not_null"}]))


@query("""
SELECT n_name AS nation, count(*) AS orders, sum(o_totalprice) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1""".replace(
    "sum(o_totalprice)", "count(DISTINCT c_custkey)"))
def plan_inner_joins(spark, root):
    return whole(spark, root, plan(
        {"o": "orders", "c": "customer", "n": "nation", "r": "region"},
        [item("n", "n_name", "nation"), item(None, None, "orders", aggregate="count"),
         item("c", "c_custkey", "total", aggregate="count_distinct")],
        joins=[join("c", "inner", on("o", "o_custkey", "eq", "c", "c_custkey")),
               join("n", "inner", on("c", "c_nationkey", "eq", "n", "n_nationkey")),
               join("r", "inner", on("n", "n_regionkey", "eq", "r", "r_regionkey"))],
        filters=[{"field": ref("r", "r_name"), "op": "eq", "value": "ASIA"}], group=["nation"]))


@query("""
SELECT c_mktsegment AS segment, count(o_orderkey) AS orders, count(*) AS lines
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey >= c_custkey GROUP BY 1""")
def plan_left_join(spark, root):
    return whole(spark, root, plan(
        {"c": "customer", "o": "orders"},
        [item("c", "c_mktsegment", "segment"), item("o", "o_orderkey", "orders", aggregate="count"),
         item(None, None, "lines", aggregate="count")],
        joins=[join("o", "left", on("c", "c_custkey", "eq", "o", "o_custkey"),
                    on("c", "c_custkey", "lte", "o", "o_orderkey"))],
        group=["segment"]))


@query("""
SELECT p_partkey AS part_id, s_suppkey AS supplier_id, s_nationkey AS nation_id
FROM part FULL JOIN supplier ON p_partkey = s_suppkey AND p_size = s_nationkey""")
def plan_full_join(spark, root):
    return whole(spark, root, plan(
        {"p": "part", "s": "supplier"},
        [item("p", "p_partkey", "part_id"), item("s", "s_suppkey", "supplier_id"), item("s", "s_nationkey", "nation_id")],
        joins=[join("s", "full", on("p", "p_partkey", "eq", "s", "s_suppkey"), on("p", "p_size", "eq", "s", "s_nationkey"))]))


@query("""
SELECT l_returnflag AS flag, count(*) AS late FROM orders JOIN lineitem
ON o_orderkey = l_orderkey AND o_orderdate < l_shipdate GROUP BY 1""")
def plan_range_join(spark, root):
    return whole(spark, root, plan(
        {"o": "orders", "l": "lineitem"},
        [item("l", "l_returnflag", "flag"), item(None, None, "late", aggregate="count")],
        joins=[join("l", "inner", on("o", "o_orderkey", "eq", "l", "l_orderkey"),
                    on("o", "o_orderdate", "lt", "l", "l_shipdate"))],
        group=["flag"]))


@query("""
SELECT a.n_name AS name, count(b.n_nationkey) AS later_in_region
FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
JOIN customer ON a.n_nationkey = c_nationkey GROUP BY 1""")
def plan_self_join(spark, root):
    return whole(spark, root, plan(
        {"a": "nation", "b": "nation", "c": "customer"},
        [item("a", "n_name", "name"), item("b", "n_nationkey", "later_in_region", aggregate="count")],
        joins=[join("b", "left", on("a", "n_regionkey", "eq", "b", "n_regionkey"),
                    on("a", "n_nationkey", "lt", "b", "n_nationkey")),
               join("c", "inner", on("a", "n_nationkey", "eq", "c", "c_nationkey"))],
        group=["name"]))


@query("""
SELECT l_returnflag AS flag, CAST(sum(l_linenumber) AS BIGINT) AS total, avg(l_linenumber) AS mean,
       min(l_shipdate) AS first_day, max(l_quantity) AS most, count(l_tax) AS taxed, count(*) AS lines,
       count(DISTINCT l_suppkey) AS suppliers
FROM lineitem GROUP BY 1""")
def plan_aggregates(spark, root):
    return whole(spark, root, plan({"l": "lineitem"}, [
        item("l", "l_returnflag", "flag"),
        item("l", "l_linenumber", "total", aggregate="sum"), item("l", "l_linenumber", "mean", aggregate="avg"),
        item("l", "l_shipdate", "first_day", aggregate="min"), item("l", "l_quantity", "most", aggregate="max"),
        item("l", "l_tax", "taxed", aggregate="count"), item(None, None, "lines", aggregate="count"),
        item("l", "l_suppkey", "suppliers", aggregate="count_distinct")], group=["flag"]))


@query("""
SELECT count(*) AS lines, count(DISTINCT l_orderkey) AS orders, CAST(sum(l_linenumber) AS BIGINT) AS total
FROM lineitem WHERE l_quantity > 1000""")
def plan_global_aggregate_empty(spark, root):
    """A global aggregate over no rows is one row: counts 0, sum NULL."""
    return whole(spark, root, plan({"l": "lineitem"}, [
        item(None, None, "lines", aggregate="count"), item("l", "l_orderkey", "orders", aggregate="count_distinct"),
        item("l", "l_linenumber", "total", aggregate="sum")],
        filters=[{"field": ref("l", "l_quantity"), "op": "gt", "value": 1000}]))


@query("""
SELECT CAST(date_trunc('day', ts) AS DATE) AS day, CAST(date_trunc('month', ts) AS DATE) AS month,
       CAST(date_trunc('year', ts) AS DATE) AS year, count(*) AS events FROM events GROUP BY 1, 2, 3""")
def plan_date_bucket(spark, root):
    return whole(spark, root, plan({"e": "events"}, [
        item("e", "ts", "day", bucket="day"), item("e", "ts", "month", bucket="month"),
        item("e", "ts", "year", bucket="year"), item(None, None, "events", aggregate="count")],
        group=["day", "month", "year"]))


@query("""
SELECT o_orderkey AS id, o_custkey AS customer, o_totalprice AS price FROM orders
ORDER BY o_custkey DESC NULLS LAST, o_totalprice ASC NULLS FIRST, o_orderkey LIMIT 50""")
def plan_order_limit(spark, root):
    """Top 50 by three keys; the limit is the feature."""
    spec = plan({"o": "orders"}, [
        item("o", "o_orderkey", "id"), item("o", "o_custkey", "customer"), item("o", "o_totalprice", "price")],
        order=[("customer", "desc"), ("price", "asc"), ("id", "asc")], limit=50)
    return Q.run_plan(spec, tables(spark, root, spec))


@query("""
SELECT p_brand AS brand, p_type AS type, count(*) AS parts, (SELECT count(DISTINCT (p_brand, p_type)) > 40 FROM part)
       AS truncated
FROM part GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 40""")
def plan_limit_truncated(spark, root):
    """First 40 groups and whether there were more."""
    spec = plan({"p": "part"}, [
        item("p", "p_brand", "brand"), item("p", "p_type", "type"), item(None, None, "parts", aggregate="count")],
        group=["brand", "type"], order=[("parts", "desc"), ("brand", "asc"), ("type", "asc")], limit=40)
    rows, _, limit = Q.build_plan(spec, tables(spark, root, spec))
    top, flag = Q.limit_truncated(rows, limit)
    return top.withColumn("truncated", F.lit(flag.first()["truncated"]))


@query("""
SELECT l_orderkey, l_linenumber, (SELECT count(*) FROM lineitem) AS total,
       (SELECT count(*) > 50 FROM lineitem WHERE l_orderkey > 900 OR l_orderkey = 900 AND l_linenumber < 3) AS more
FROM lineitem WHERE l_orderkey > 900 OR l_orderkey = 900 AND l_linenumber < 3
ORDER BY l_orderkey, l_linenumber DESC LIMIT 50""")
def page(spark, root):
    """The page after line 3 of order 900, lines of an order from the last on; the page is the feature."""
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber")
    return Q.page(lines, [("l_orderkey", False), ("l_linenumber", True)], 50, {"l_orderkey": 900, "l_linenumber": 3})


@query("""
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS orders,
       count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""")
def chart_frame(spark, root):
    """Time series chart: x first, then the selected measures."""
    spec = plan({"o": "orders"}, [
        item(None, None, "orders", aggregate="count"), item("o", "o_orderdate", "month", bucket="month"),
        item("o", "o_custkey", "customers", aggregate="count_distinct")], group=["month"])
    rows, columns, _ = Q.build_plan(spec, tables(spark, root, spec))
    return Q.chart_frame(rows, {"title": "Orders", "type": "timeseries", "x": "month",
                                "y": ["orders", "customers"]}, columns)


@query("""
SELECT min(CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)) - INTERVAL 60 SECOND AS time_from,
       max(CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)) + INTERVAL 60 SECOND AS time_to FROM orders""")
def chart_range(spark, root):
    rows = table(spark, root, "orders").select(S.month_start(F.col("o_orderdate")).alias("month"))
    return Q.chart_range(rows, "month")
