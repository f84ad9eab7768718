"""Mart load on tiny sources: formula, rules, second load, rejection, publication."""

import pathlib
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from martweave.functions import scale
from martweave.functions import scalars as S
from martweave.operators import mart, quality
from martweave.operators.mart import Scope
from martweave.plans import load, reports
from martweave.sources import adapter, readers, sinks
from tests.conftest import rows, rules

SCOPE = Scope("2012-01-01", "2012-12-31")


def sources(spark, **change):
    data = {
        "product": [(1, "Bike", "P-1", 7), (2, "Bell", "P-2", None), (3, "Spare", "P-3", None)],
        "product_subcategory": [(7, "Road", 3)],
        "product_category": [(3, "Bikes")],
        "customer": [(1, None), (2, 5)],
        "sales_territory": [(5, "North", "US", "America")],
        "sales_order_header": [
            (10, datetime(2012, 1, 2, 8), 1, None, 5, None), (11, datetime(2012, 12, 31, 23, 59), 2, 5, 5, None),
            (12, datetime(2013, 1, 1), 2, 5, 5, None), (13, datetime(2012, 5, 5), 2, 5, 4, None),
            (14, datetime(2012, 5, 5), 2, 5, 5, 9)],
        "sales_order_detail": [
            (10, 1, 1, 2, D("10.0000"), D("0.1000"), D("18.000000")), (11, 1, 2, 1, D("0.5050"), D("0.0099"), D("0.500001")),
            (11, 2, 1, 1, D("0.5000"), D("0.0000"), D("0.500000")), (12, 1, 1, 1, D("1"), D("0"), D("1")),
            (13, 1, 1, 1, D("1"), D("0"), D("1")), (14, 1, 1, 1, D("1"), D("0"), D("1"))],
    }
    data.update(change)
    return {n: spark.createDataFrame(data[n], s) for n, s in readers.SOURCE_SCHEMAS.items()}


def test_read_sources_declares_types(spark, tmp_path):
    for name, df in sources(spark).items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    read = readers.read_sources(spark, str(tmp_path))
    assert set(read) == set(readers.SOURCE_SCHEMAS)
    assert dict(read["sales_order_detail"].dtypes)["unit_price"] == "decimal(19,4)"
    assert read["sales_order_header"].count() == 5


def test_jdbc_options():
    o = readers.jdbc_options("mssql", {"host": "h", "port": "1", "database": "d", "partitionColumn": "id",
                                       "lowerBound": 0, "upperBound": 9, "numPartitions": 3}, "dbo.t")
    assert o["url"] == "jdbc:sqlserver://h:1;databaseName=d" and o["queryTimeout"] == "30"
    assert (o["partitionColumn"], o["numPartitions"]) == ("id", "3")
    with pytest.raises(ValueError):
        readers.jdbc_options("sqlite", {}, "t")


def test_jdbc_reads_every_row_once(spark, tmp_path):
    place = {"database": f"{tmp_path}/source"}
    schema = "K bigint, V string, D decimal(19,4), T timestamp"
    data = [(i * i - 50, f"v{i}", D(f"{i}.1250"), datetime(2012, 1, 1, i % 24)) for i in range(200)] + [(None, "none", None, None), (None, "", D("1"), None)]
    df = spark.createDataFrame(data, schema)
    url = readers.EMBEDDED["derby"][0].format(**place)
    df.coalesce(1).write.jdbc(f"{url};create=true", "ROWS1", properties={"driver": readers.EMBEDDED["derby"][1]})
    read = readers.read_jdbc(spark, "derby", place, "ROWS1", split="K", rows_per_read=30)
    assert read.rdd.getNumPartitions() > 4 and rows(read) == rows(df)
    assert rows(readers.read_jdbc(spark, "derby", place, "ROWS1")) == rows(df)
    assert rows(readers.read_jdbc(spark, "derby", place, "(SELECT * FROM ROWS1 WHERE K IS NULL) N", split="K")) == rows(df.filter("K IS NULL"))
    assert readers.read_jdbc(spark, "derby", place, "(SELECT * FROM ROWS1 WHERE K = 12345) N", split="K").collect() == []


@pytest.mark.parametrize("low, high, parts", [(0, 0, 5), (-7, 9, 4), (1, 3, 10), (0, 10**12, 3)])
def test_ranges_hold_every_key_once(low, high, parts):
    found = [tuple(map(int, p.replace("k >= ", "").split(" AND k < "))) for p in readers.split_ranges("k", low, high, 0, parts)]
    assert found[0][0] == low and found[-1][1] == high + 1 and all(a < b for a, b in found)
    assert all(x[1] == y[0] for x, y in zip(found, found[1:]))
    assert readers.split_ranges("k", low, high, 2, parts)[-1] == "k IS NULL"


def test_rounding_is_half_up_once(spark):
    df = spark.sql("SELECT 1 AS q, CAST('0.5050' AS DECIMAL(19,4)) AS p, CAST('0.0099' AS DECIMAL(19,4)) AS d")
    got = df.select(S.line_net_amount(F.col("q"), F.col("p"), F.col("d"))).first()[0]
    assert got == D("0.500001")
    ratio = spark.sql("SELECT CAST('1.000001' AS DECIMAL(38,6)) AS s, 2L AS n, 0L AS z")
    assert ratio.select(S.average_order_value(F.col("s"), F.col("n"))).first()[0] == D("0.500001")
    assert ratio.select(S.average_order_value(F.col("s"), F.col("z"))).first()[0] is None


def test_load_reports_and_second_load(spark, tmp_path):
    root = str(tmp_path / "mart")
    receipt = load.load_mart(sources(spark), root, SCOPE).first()
    assert (receipt["target_fact_rows"], receipt["orders"], receipt["quantity"]) == (3, 2, 4)
    assert receipt["line_net_amount"] == D("19.000001") and receipt["aov"] == D("9.500001")
    assert len(receipt["receipt_sha256"]) == 64
    m = load.open_mart(spark, root)
    assert rows(m.fact, "sales_order_id", "sales_order_detail_id", "territory_key") == [(10, 1, 0), (11, 1, 1), (11, 2, 1)]
    assert m.dims["dim_date"].count() == 366 + 1
    assert len(m.view.columns) == 24
    assert rows(reports.sales_by_category(m.view)) == [("Bikes", D("18.500000")), ("Unknown", D("0.500001"))]
    summaries = load.refresh_summaries(m, root)
    assert summaries["monthly_category_summary"].count() == 3
    assert rules(quality.check_summary_rules(summaries["monthly_category_summary"], "product_category_id")) == set()

    # The same sources again change nothing.
    load.load_mart(sources(spark), root, SCOPE)
    again = load.open_mart(spark, root)
    assert rows(again.fact) == rows(m.fact)
    for name, dim in m.dims.items():
        assert rows(again.dims[name]) == rows(dim)
    assert rows(quality.table_fingerprint(again.fact)) == rows(quality.table_fingerprint(m.fact))

    # Renamed product, new product, customer association lost, corrected line.
    changed = sources(
        spark, product=[(1, "Bike 2", "P-1", 7), (2, "Bell", "P-2", None), (9, "Lamp", "P-9", 7)], customer=[(1, None), (2, None)],
        sales_order_detail=[(10, 1, 1, 3, D("10"), D("0.1"), D("27")), (11, 1, 2, 1, D("0.5050"), D("0.0099"), D("0.500001")),
                            (11, 2, 9, 1, D("0.5"), D("0"), D("0.5"))])
    load.load_mart(changed, root, SCOPE)
    third = load.open_mart(spark, root)
    products = {r["source_product_id"]: (r["product_key"], r["product_name"]) for r in third.dims["dim_product"].collect()}
    keys = {r["source_product_id"]: r["product_key"] for r in m.dims["dim_product"].collect()}
    assert products[1] == (keys[1], "Bike 2") and products[3] == (keys[3], "Spare")
    assert products[9] == (max(keys.values()) + 1, "Lamp")
    assert rows(third.dims["dim_customer"], "source_customer_id", "territory_key") == [(0, 0), (1, 0), (2, 0)]
    lines = {(r[0], r[1]): (r[2], r[3]) for r in rows(
        third.fact, "sales_order_id", "sales_order_detail_id", "order_qty", "product_key")}
    assert lines == {(10, 1): (3, keys[1]), (11, 1): (1, keys[2]), (11, 2): (1, products[9][0])}


def files_of(months):
    return {m: sorted(p.name for p in pathlib.Path(path).glob("*.parquet")) for m, path in months.items()}


def test_only_touched_months_are_rewritten(spark, tmp_path):
    root = str(tmp_path / "mart")

    def months():
        return load.fact_months(sinks.current_paths(spark, root))

    load.load_mart(sources(spark), root, SCOPE)
    first = months()
    assert sorted(first) == [201201, 201212]
    names = files_of(first)
    # The same lines again: no month is written.
    load.load_mart(sources(spark), root, SCOPE)
    assert months() == first and files_of(first) == names
    # A corrected line: its month is written, the other keeps its files.
    detail = [(10, 1, 1, 3, D("10.0000"), D("0.1000"), D("27.000000")), (11, 1, 2, 1, D("0.5050"), D("0.0099"), D("0.500001")),
              (11, 2, 1, 1, D("0.5000"), D("0.0000"), D("0.500000"))]
    load.load_mart(sources(spark, sales_order_detail=detail), root, SCOPE)
    second = months()
    assert second[201212] == first[201212] and second[201201] != first[201201] and files_of(second)[201212] == names[201212]
    # An order that moves to another month leaves its old one, which is gone when nothing is left in it.
    header = [(10, datetime(2012, 3, 4), 1, None, 5, None), (11, datetime(2012, 12, 31, 23, 59), 2, 5, 5, None)]
    load.load_mart(sources(spark, sales_order_header=header, sales_order_detail=detail), root, SCOPE)
    third = months()
    assert sorted(third) == [201203, 201212] and third[201212] == first[201212]
    fact = load.open_mart(spark, root).fact
    assert rows(fact, "sales_order_id", "sales_order_detail_id", "order_date_key", "order_qty") == [
        (10, 1, 20120304, 3), (11, 1, 20121231, 1), (11, 2, 20121231, 1)]
    # A load that is rejected leaves the months as they were.
    with pytest.raises(load.LoadRejected):
        load.load_mart(sources(spark, sales_order_header=header, sales_order_detail=detail[:1]), root, SCOPE)
    assert months() == third


def test_changed_facts_compare_whole_lines(spark):
    old = spark.createDataFrame([(1, 1, 20120101, 1, 1, 0, 5, None, 1, D("1"), D("0"), D("1"), D("1")),
                                 (1, 2, 20120101, 1, 1, 0, 5, None, 1, D("1"), D("0"), D("1"), D("1"))], mart.FACT_SCHEMA)
    new = old.withColumn("currency_rate_id", F.when(F.col("sales_order_detail_id") == 2, 7).cast("long")).unionByName(
        old.limit(1).withColumn("sales_order_id", F.lit(9).cast("long")).withColumn("order_date_key", F.lit(20120201)))
    assert rows(mart.changed_facts(old, new), "sales_order_id", "sales_order_detail_id", "old_month") == [(1, 2, 201201), (9, 1, None)]


def test_reconciliation_needs_the_whole_scope(spark, tmp_path):
    """A line that left the source keeps its fact, so source and target totals differ and nothing is published."""
    root = str(tmp_path / "mart")
    load.load_mart(sources(spark), root, SCOPE)
    less = sources(spark, sales_order_detail=[(10, 1, 1, 2, D("10"), D("0.1"), D("18"))])
    with pytest.raises(load.LoadRejected) as error:
        load.load_mart(less, root, SCOPE)
    assert "target_source_reconciliation_failed" in error.value.reasons
    assert load.open_mart(spark, root).fact.count() == 3


DETAIL = [(10, 1, 1, 2, D("10.0000"), D("0.1000"), D("18.000000"))]
HEADER = [(10, datetime(2012, 1, 2), 1, None, 5, None)]


@pytest.mark.parametrize("change, rule", [
    ({"product": [(1, "A", "P", None), (1, "B", "P", None)]}, "duplicate_product_id"),
    ({"product": [(0, "A", "P", None), (1, "B", "P", None)]}, "reserved_product_id_zero"),
    ({"sales_order_detail": DETAIL * 2}, "duplicate_fact_key"),
    ({"sales_order_detail": [(10, 1, 8, 2, D("10"), D("0.1"), D("18"))]}, "fact_product_orphan"),
    ({"sales_order_header": [(10, datetime(2012, 1, 2), 8, None, 5, None)]}, "fact_customer_orphan"),
    ({"sales_order_header": [(10, datetime(2012, 1, 2), 1, 8, 5, None)]}, "fact_territory_orphan"),
    ({"customer": [(1, 8)]}, "customer_territory_orphan"),
    ({"sales_order_detail": [(10, 1, 1, 0, D("10"), D("0.1"), D("0"))]}, "invalid_order_qty"),
    ({"sales_order_detail": [(10, 1, 1, 2, D("10"), D("1.1"), D("-2"))]}, "invalid_amount"),
    ({"sales_order_detail": [(10, 1, 1, 2, D("-10"), D("0.1"), D("-18"))]}, "invalid_amount"),
    ({"sales_order_detail": [(10, 1, 1, 2, D("10"), D("0.1"), D("18.000002"))]}, "line_total_mismatch"),
    ({"sales_order_header": [(10, datetime(2012, 1, 2), 1, None, 4, None)]}, "empty_approved_scope"),
    ({"product": [(1, "", "P-1", None)]}, "invalid_product_name"),
])
def test_rejected_sources(spark, change, rule):
    base = {"sales_order_header": HEADER, "sales_order_detail": DETAIL, "customer": [(1, None)], "product": [(1, "A", "P", None)]}
    with pytest.raises(load.LoadRejected) as error:
        load.prepare(sources(spark, **{**base, **change}), SCOPE)
    assert rule in error.value.reasons


def test_valid_small_difference_passes(spark):
    detail = [(10, 1, 1, 2, D("10"), D("0.1"), D("18.000001"))]
    rows_ = load.preview_load(sources(spark, sales_order_detail=detail), SCOPE)
    assert dict(rows(rows_))["line_net_amount"] == "18.000000"


def test_scope_rules_on_loaded_rows(spark):
    facts = mart.order_lines(*[sources(spark)[n] for n in ("sales_order_header", "sales_order_detail")])
    assert rules(quality.check_in_scope(facts, SCOPE)) == {
        "fact_outside_date_scope", "fact_status_out_of_scope", "fact_currency_out_of_scope"}


def test_altered_unknown_member(spark):
    dims = {d: mart.unknown_member(spark, d) for d in load.DIMENSIONS}
    assert mart.unknown_member_check(dims).first()["canonical"]
    for changed in (dims["dim_territory"].withColumn("territory_name", F.lit("unknown")),
                    dims["dim_territory"].filter("false"), dims["dim_territory"].union(dims["dim_territory"])):
        assert not mart.unknown_member_check({**dims, "dim_territory": changed}).first()["canonical"]


def test_coercion_reasons(spark):
    df = spark.createDataFrame([("1", "a", "1.23455", None), ("x", "", "1e30", "7")], "n string, t string, m string, o string")
    good, bad = quality.coerce_source(df, {"n": ("int", False), "t": ("text", False), "m": ("decimal4", False), "o": ("int", True)})
    assert rows(good) == [(1, "a", D("1.2346"), None)]
    assert bad.first()["reasons"] == ["invalid_n", "invalid_t", "invalid_m"]
    flags = spark.sql("SELECT true AS n, DATE'2020-01-01' AS d")
    good, bad = quality.coerce_source(flags, {"n": ("int", False), "d": ("date", False)})
    assert good.count() == 0 and bad.first()["reasons"] == ["invalid_n"]


def test_view_losing_a_row_is_seen_despite_other_rows(spark):
    fact = spark.createDataFrame(
        [(1, date(2012, 1, 1), 5, None, 1, D("1"), D("1")), (2, date(2020, 1, 1), 5, None, 1, D("1"), D("1"))],
        "sales_order_id int, order_date date, status int, currency_rate_id int, order_qty int,"
        " line_net_amount decimal(19,6), source_line_total decimal(19,6)")
    expected = quality.scope_totals(fact.filter("sales_order_id = 1"))
    lost = fact.filter("sales_order_id = 2")
    seen = quality.conditional_totals(mart.scope_flag(lost, SCOPE))
    assert seen.first()["view_count"] == 1
    assert quality.reconcile(expected, seen).filter("NOT same").count() == 5


def test_equal_totals_with_wrong_groups(spark):
    schema = "k string, line_count long, quantity long, net_sales decimal(38,6), source_line_total decimal(38,6)"
    expected = spark.createDataFrame([("a", 1, 1, D("1"), D("1")), ("b", 2, 2, D("2"), D("2"))], schema)
    actual = spark.createDataFrame([("b", 1, 1, D("1"), D("1")), ("a", 2, 2, D("2"), D("2"))], schema)
    assert rows(quality.summary_table_totals(expected)) == rows(quality.summary_table_totals(actual))
    assert rows(quality.diff_both_ways(expected, actual)) == [(2, 2, 2)]


def test_totals_with_a_reason(spark):
    empty = spark.createDataFrame([], "line_count long, quantity long, net_sales decimal(38,6), source_line_total decimal(38,6)")
    assert quality.table_totals(quality.summary_table_totals(empty)).first()["reason"] == "empty_or_invalid_source"


def test_replace_table_keeps_the_old_version_on_rejection(spark, tmp_path):
    root = str(tmp_path)
    sinks.replace_table(spark.range(3), root, "t")
    with pytest.raises(sinks.PublishRejected):
        sinks.replace_table(spark.range(5), root, "t", lambda df: df.count() == 4)
    assert sinks.read_current(spark, root, "t").count() == 3
    sinks.replace_table(spark.range(5), root, "t", lambda df: df.count() == 5)
    assert sinks.read_current(spark, root, "t").count() == 5


def test_panels_of_an_empty_range(spark, tmp_path):
    root = str(tmp_path / "mart")
    load.load_mart(sources(spark), root, SCOPE)
    picked = reports.dashboard_filter(load.open_mart(spark, root).view, "2030-01-01", "2030-02-01")
    assert rows(reports.kpi_sales(picked)) == [(None,)]
    assert rows(reports.kpi_orders(picked)) == [(0,)]
    assert rows(reports.kpi_aov(picked)) == [(None,)]
    assert rows(reports.quality_summary(picked)) == [(0, 0, None, None, None)]
    assert reports.monthly_trend(picked).count() == 0


def test_points_rules(spark):
    good = [(date(2014, 6, 1), "Bikes", D("120.500001")), (date(2014, 6, 1), "Clothing", D("0.300000"))]
    schema = "month date, category string, sales_amount decimal(38,6)"
    assert rules(quality.check_points(spark.createDataFrame(good, schema), "2014-06-10", "2014-06-30")) == set()
    bad = good + good[:1] + [(date(2014, 6, 2), "x\ny", D("-1")), (date(2014, 5, 1), "z" * 81, D("1e15"))]
    assert rules(quality.check_points(spark.createDataFrame(bad, schema), "2014-06-10", "2014-06-30")) == {
        "duplicate_point", "month_not_first_day", "label_invalid", "amount_out_of_range", "month_out_of_range"}


def test_staged_data_does_not_depend_on_recomputation(spark):
    noisy = spark.range(1000).withColumn("x", F.rand())
    staged = scale.stage(noisy)
    assert rows(staged) == rows(staged)


def test_ids_beyond_32_bits(spark):
    big = 2**31 + 5
    df = spark.createDataFrame([(big, "x")], "n bigint, t string")
    good, bad = quality.coerce_source(df, {"n": ("id", False), "t": ("text", False)})
    assert good.first()["n"] == big and bad.count() == 0
    keyed = mart.assign_keys(spark.range(3), ["id"], big, "key")
    assert rows(keyed, "id", "key") == [(0, big + 1), (1, big + 2), (2, big + 3)]


def test_money_is_rounded_once(spark):
    df = spark.createDataFrame([("0.00004999999999995",), ("0.00005",), ("x",)], "m string")
    good, bad = quality.coerce_source(df, {"m": ("decimal4", False)})
    assert sorted(str(r.m) for r in good.collect()) == ["0.0000", "0.0001"] and bad.count() == 1


def test_only_lines_in_scope_are_ranked(spark, monkeypatch):
    root, scope = "/root/testdata/sf0.001", Scope("1995-06-01", "2001-06-30")
    ranked, real = [], scale.grouped_rank
    monkeypatch.setattr(adapter.scale, "grouped_rank", lambda df, *a: ranked.append(df) or real(df, *a))
    header = adapter.sales_order_header(spark, root)
    found = mart.order_lines(header, adapter.mart_sources(spark, root, scope=scope)["sales_order_detail"], scope)
    every = mart.order_lines(header, adapter.sales_order_detail(spark, root), scope)
    assert rows(found) == rows(every)
    assert ranked[0].count() == every.count() < ranked[1].count()
