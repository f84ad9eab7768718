"""Data-quality rules and reconciliation.

Every check returns violations as (rule, key, detail) text columns; a load fails
when a blocking rule has rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martweave.functions.scale import one_row_differs, one_row_values
from martweave.functions.scalars import (
    MAX_AMOUNT, MICRO, amount_in_range, average_order_value, dec, finish_digest, set_digest,
)
from martweave.operators.mart import Scope


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def violation(df: DataFrame, rule: str, key: Sequence[str], detail: Column | str) -> DataFrame:
    value = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(
        F.lit(rule).alias("rule"),
        F.concat_ws("/", *[_text(F.col(k)) for k in key]).alias("key"),
        _text(value).alias("detail"),
    )


def all_violations(first: DataFrame, *rest: DataFrame) -> DataFrame:
    for part in rest:
        first = first.unionByName(part)
    return first


def rule_rows(df: DataFrame, key: Sequence[str], rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One pass for several row rules: {rule: (holds, detail)}; a NULL rule counts as broken."""
    broken = F.array(*[
        F.when(~F.coalesce(holds, F.lit(False)), F.struct(F.lit(r).alias("rule"), _text(d).alias("detail")))
        for r, (holds, d) in rules.items()
    ])
    rows = df.select(
        F.concat_ws("/", *[_text(F.col(k)) for k in key]).alias("key"),
        F.explode(F.filter(broken, lambda b: b.isNotNull())).alias("b"),
    )
    return rows.select("b.rule", "key", "b.detail")


# --- source coercion ---------------------------------------------------------------


def coerce_source(df: DataFrame, spec: dict[str, tuple[str, bool]]) -> tuple[DataFrame, DataFrame]:
    """Typed columns with a reason per bad cell: (good rows, rejected rows with ``reasons``).

    ``spec`` maps a column to (kind, nullable); kinds are int, id (64 bits), text, date,
    decimal4 and decimal6.
    """
    typed, reasons = [], []
    for name, (kind, nullable) in spec.items():
        value = _coerced(f"`{name}`", kind, df.schema[name].dataType)
        bad = f"`{name}` IS NOT NULL AND {value} IS NULL" if nullable else f"{value} IS NULL"
        typed.append(f"{value} AS `{name}`")
        reasons.append(f"CASE WHEN {bad} THEN 'invalid_{name}' END")
    others = [f"`{c}`" for c in df.columns if c not in spec]
    raw = ", ".join(f"CAST(`{c}` AS STRING) AS `{c}`" for c in spec)
    marked = df.selectExpr(
        *typed, *others, f"array_compact(array({', '.join(reasons)})) AS reasons", f"struct({raw}) AS raw")
    good = marked.filter("size(reasons) = 0").drop("reasons", "raw")
    return good, marked.filter("size(reasons) > 0")


def _coerced(name: str, kind: str, found: T.DataType) -> str:
    """SQL of the typed value, NULL when the cell cannot be that type."""
    if kind in ("int", "id"):
        sort = "INT" if kind == "int" else "BIGINT"
        return f"CAST(NULL AS {sort})" if isinstance(found, T.BooleanType) else f"try_cast({name} AS {sort})"
    if kind == "text":
        return f"nullif({name}, '')" if isinstance(found, T.StringType) else "CAST(NULL AS STRING)"
    if kind == "date":
        dated = isinstance(found, (T.DateType, T.TimestampType, T.TimestampNTZType))
        return f"CAST({name} AS DATE)" if dated else "CAST(NULL AS DATE)"
    if kind in ("decimal4", "decimal6"):
        places = int(kind[-1])
        # One rounding: a decimal cast rounds half up, straight from the text or the source decimal.
        exact = f"CAST({name} AS STRING)" if isinstance(found, (T.FloatType, T.DoubleType)) else name
        return f"try_cast({exact} AS DECIMAL(19,{places}))"
    raise ValueError("unknown_kind")


# --- load checks ----------------------------------------------------------------------


def check_unique(df: DataFrame, key: str, name: str) -> DataFrame:
    """Duplicate business keys, and key 0, which belongs to the Unknown member."""
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return violation(repeated, f"duplicate_{name}", [key], F.col("n")).unionByName(
        violation(df.filter(F.col(key) == 0), f"reserved_{name}_zero", [key], "0")
    )


def check_fact_key(facts: DataFrame) -> DataFrame:
    keys = ["sales_order_id", "sales_order_detail_id"]
    repeated = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return violation(repeated, "duplicate_fact_key", keys, F.col("n"))


def find_orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-NULL key has no parent."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti")


def orphan_violations(child: DataFrame, parent: DataFrame, key: str, rule: str) -> DataFrame:
    # Distinct keys first: a hot orphan is one violation row, not a third of the fact.
    keys = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return violation(keys.join(parent.select(key), key, "left_anti"), rule, [key], F.col("rows"))


_LINE = ["sales_order_id", "sales_order_detail_id"]


def _scope_rules(scope: Scope) -> dict[str, tuple[Column, Column]]:
    day = F.col("order_date")
    return {
        "fact_outside_date_scope": (
            (day >= F.lit(scope.start).cast("date")) & (day <= F.lit(scope.end).cast("date")), day),
        "fact_status_out_of_scope": (F.col("status") == scope.status, F.col("status")),
        "fact_currency_out_of_scope": (F.col("currency_rate_id").isNull(), F.col("currency_rate_id")),
    }


def _domain_rules() -> dict[str, tuple[Column, Column]]:
    discount = F.col("unit_price_discount")
    return {
        "invalid_order_qty": (F.col("order_qty") > 0, F.col("order_qty")),
        "invalid_amount": ((F.col("unit_price") >= 0) & (discount >= 0) & (discount <= 1),
                           F.concat_ws("|", _text(F.col("unit_price")), _text(discount))),
        "line_net_amount_out_of_range": (amount_in_range(F.col("line_net_amount")), F.col("line_net_amount")),
        "source_line_total_out_of_range": (F.abs("source_line_total") <= dec(MAX_AMOUNT),
                                           F.col("source_line_total")),
    }


def _formula_rules() -> dict[str, tuple[Column, Column]]:
    gap = F.abs(F.col("line_net_amount") - F.col("source_line_total"))
    return {"line_total_mismatch": (gap <= dec(MICRO), gap)}


def check_not_empty(facts: DataFrame) -> DataFrame:
    n = facts.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    return violation(n, "empty_approved_scope", ["n"], "0")


def check_in_scope(facts: DataFrame, scope: Scope) -> DataFrame:
    return rule_rows(facts, _LINE, _scope_rules(scope))


def check_domain(facts: DataFrame) -> DataFrame:
    return rule_rows(facts, _LINE, _domain_rules())


def check_formula(facts: DataFrame) -> DataFrame:
    return rule_rows(facts, _LINE, _formula_rules())


def check_lines(facts: DataFrame, scope: Scope) -> DataFrame:
    """All row rules of the fact in one pass over it."""
    return rule_rows(facts, _LINE, {**_scope_rules(scope), **_domain_rules(), **_formula_rules()})


def check_extract(inputs: dict[str, DataFrame], scope: Scope) -> DataFrame:
    products, customers = inputs["products"], inputs["customers"]
    territories, facts = inputs["territories"], inputs["facts"]
    return all_violations(
        check_not_empty(facts),
        check_unique(products, "source_product_id", "product_id"),
        check_unique(customers, "source_customer_id", "customer_id"),
        check_unique(territories, "source_territory_id", "territory_id"),
        check_fact_key(facts),
        orphan_violations(customers, territories, "source_territory_id", "customer_territory_orphan"),
        orphan_violations(facts, products, "source_product_id", "fact_product_orphan"),
        orphan_violations(facts, customers, "source_customer_id", "fact_customer_orphan"),
        orphan_violations(facts, territories, "source_territory_id", "fact_territory_orphan"),
        check_lines(facts, scope),
    )


def check_summary_rules(summary: DataFrame, id_column: str) -> DataFrame:
    key = ["month_start", id_column]
    rows = rule_rows(summary, key, {
        "month_start_not_first_day": (F.dayofmonth("month_start") == 1, F.col("month_start")),
        "order_count_invalid": ((F.col("order_count") > 0) & (F.col("order_count") <= F.col("line_count")),
                                F.concat_ws("|", _text(F.col("order_count")), _text(F.col("line_count")))),
        "quantity_invalid": (F.col("quantity") > 0, F.col("quantity")),
        "amount_invalid": ((F.col("net_sales") >= 0) & (F.col("source_line_total") >= 0), F.col("net_sales")),
    })
    repeated = summary.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.unionByName(violation(repeated, "duplicate_summary_key", key, F.col("n")))


# --- totals ---------------------------------------------------------------------------

TOTALS = ["fact_count", "quantity", "line_net_amount", "source_line_total", "order_count"]


def scope_totals(rows: DataFrame) -> DataFrame:
    """Five measures of in-scope lines; sums of nothing are 0 here."""
    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.col(name).cast("decimal(38,6)")), F.lit(0)).cast("decimal(38,6)")

    return rows.agg(
        F.count(F.lit(1)).alias("fact_count"),
        F.coalesce(F.sum(F.col("order_qty").cast("long")), F.lit(0)).alias("quantity"),
        total("line_net_amount").alias("line_net_amount"),
        total("source_line_total").alias("source_line_total"),
        F.count_distinct("sales_order_id").alias("order_count"),
    )


def target_totals(fact: DataFrame, dim_date: DataFrame, scope: Scope) -> DataFrame:
    """The same measures from fact and calendar; the date keys bound the fact scan as well."""
    low, high = (int(d.replace("-", "")) for d in (scope.start, scope.end))
    days = dim_date.filter(F.col("full_date").between(F.lit(scope.start).cast("date"), F.lit(scope.end).cast("date")))
    rows = fact.filter(
        F.col("order_date_key").between(low, high)
        & (F.col("status") == scope.status) & F.col("currency_rate_id").isNull()
    ).join(days, F.col("order_date_key") == F.col("date_key"), "left_semi")
    return scope_totals(rows)


def conditional_totals(flagged: DataFrame) -> DataFrame:
    """Whole-view count next to in-scope measures, in one pass with a single distinct count."""
    hit = F.col("in_scope")

    def total(name: str, kind: str) -> Column:
        return F.coalesce(F.sum(F.when(hit, F.col(name).cast(kind))), F.lit(0)).cast(kind)

    return flagged.agg(
        F.count(F.lit(1)).alias("view_count"),
        F.count_if(hit).alias("fact_count"),
        total("order_qty", "long").alias("quantity"),
        total("line_net_amount", "decimal(38,6)").alias("line_net_amount"),
        total("source_line_total", "decimal(38,6)").alias("source_line_total"),
        F.count_distinct(F.when(hit, F.col("sales_order_id"))).alias("order_count"),
    )


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(measure, left_value, right_value, same) over the five measures."""
    return one_row_differs(expected, actual, TOTALS)


def reconcile_all(rows: dict[str, DataFrame]) -> DataFrame:
    """(measure, <name>_value …, same) over the five measures of several one-row frames, in one job."""
    return one_row_values(rows, TOTALS)


SUMMARY_TOTALS = ["line_count", "quantity", "net_sales", "source_line_total"]


def fact_table_totals(fact: DataFrame) -> DataFrame:
    return fact.agg(
        F.count(F.lit(1)).alias("line_count"),
        F.sum(F.col("order_qty").cast("long")).alias("quantity"),
        F.sum(F.col("line_net_amount").cast("decimal(38,6)")).cast("decimal(38,6)").alias("net_sales"),
        F.sum(F.col("source_line_total").cast("decimal(38,6)")).cast("decimal(38,6)").alias("source_line_total"),
    )


def summary_table_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.sum("line_count").alias("line_count"),
        F.sum("quantity").alias("quantity"),
        F.sum("net_sales").cast("decimal(38,6)").alias("net_sales"),
        F.sum("source_line_total").cast("decimal(38,6)").alias("source_line_total"),
    )


def table_totals(totals: DataFrame) -> DataFrame:
    """Totals with a reason when they cannot be right (empty, no quantity, negative amount)."""
    return totals.withColumn("reason", F.when(
        F.coalesce(F.col("line_count"), F.lit(0)) <= 0, "empty_or_invalid_source",
    ).when(F.coalesce(F.col("quantity"), F.lit(0)) <= 0, "invalid_quantity").when(
        F.col("net_sales").isNull() | (F.col("net_sales") < 0)
        | F.col("source_line_total").isNull() | (F.col("source_line_total") < 0), "invalid_amount"))


def diff_both_ways(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Distinct rows missing and unexpected, and the row count of ``actual``.

    One aggregation over both frames keyed by the whole row replaces two EXCEPTs.
    """
    tagged = expected.withColumn("_e", F.lit(1)).withColumn("_a", F.lit(0)).unionByName(
        actual.withColumn("_e", F.lit(0)).withColumn("_a", F.lit(1)))
    rows = tagged.groupBy(*expected.columns).agg(F.sum("_e").alias("_e"), F.sum("_a").alias("_a"))
    return rows.agg(
        F.count_if((F.col("_e") > 0) & (F.col("_a") == 0)).alias("missing_groups"),
        F.count_if((F.col("_e") == 0) & (F.col("_a") > 0)).alias("unexpected_groups"),
        F.coalesce(F.sum("_a"), F.lit(0)).alias("summary_rows"),
    )


def reconcile_summary(fact: DataFrame, expected: DataFrame, summary: DataFrame) -> DataFrame:
    """(check, same): the four totals agree and no group differs."""
    totals = one_row_differs(fact_table_totals(fact), summary_table_totals(summary), SUMMARY_TOTALS)
    checks = totals.select(F.col("measure").alias("check"), "same")
    diffs = diff_both_ways(expected, summary)
    names = {"missing_groups": F.col("missing_groups") == 0, "unexpected_groups": F.col("unexpected_groups") == 0,
             "summary_rows": F.col("summary_rows") > 0}
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), c.alias("same")) for n, c in names.items()])
    return checks.unionByName(diffs.select(F.inline(pairs)))


def check_points(points: DataFrame, start: str, end: str) -> DataFrame:
    """Rules on (month, category, sales_amount) report rows."""
    low, high = F.trunc(F.lit(start).cast("date"), "month"), F.trunc(F.lit(end).cast("date"), "month")
    label, amount = F.col("category"), F.col("sales_amount")
    rows = rule_rows(points, ["month", "category"], {
        "month_not_first_day": (F.dayofmonth("month") == 1, F.col("month")),
        "month_out_of_range": (F.col("month").between(low, high), F.col("month")),
        "label_invalid": (F.length(label).between(1, 80) & ~label.rlike(r"[\x00-\x1f\x7f]"), label),
        "amount_out_of_range": ((amount >= 0) & (amount < F.lit(10**15)), amount),
    })
    repeated = points.groupBy("month", "category").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.unionByName(violation(repeated, "duplicate_point", ["month", "category"], F.col("n")))


def check_panels(panels: dict[str, DataFrame], start: str) -> DataFrame:
    """(check, left_value, right_value, same) between the panels of one dashboard state.

    Panels are reduced to one-row sums first and meet in a union.
    """
    def sums(panel: str, **measures: Column) -> DataFrame:
        """(name, value) rows of one panel, from one pass over it."""
        row = panels[panel].agg(*[c.cast("decimal(38,6)").alias(n) for n, c in measures.items()])
        return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in measures])))

    early = F.count_if(F.col("time") < F.lit(start).cast("date"))
    facts = [
        sums("sales", sales=F.sum("value")), sums("orders", orders=F.sum("value")), sums("aov", aov=F.sum("value")),
        sums("trend", trend_sum=F.sum("sales_amount"), early_points=early),
        sums("category", category_sum=F.sum("sales_amount")), sums("territory", territory_sum=F.sum("sales_amount")),
        sums("quality", **{f"quality_{c}": F.sum(c) for c in ("order_count", "line_net_amount", "source_line_total")}),
    ]
    values = facts[0]
    for part in facts[1:]:
        values = values.unionByName(part)
    wide = values.groupBy().pivot("name", [
        "sales", "orders", "aov", "trend_sum", "category_sum", "territory_sum", "early_points",
        "quality_order_count", "quality_line_net_amount", "quality_source_line_total",
    ]).agg(F.first("value"))
    near = dec(MICRO, 38, 6)

    def pair(check: str, left: Column, right: Column, tolerance: Column) -> Column:
        same = (left.isNull() & right.isNull()) | F.coalesce(F.abs(left - right) <= tolerance, F.lit(False))
        return F.struct(F.lit(check).alias("check"), left.alias("left_value"), right.alias("right_value"),
                        same.alias("same"))

    zero = dec("0", 38, 6)
    c = F.col
    aov = average_order_value(c("sales"), c("orders").cast("long"))
    pairs = [
        pair("orders_equal_quality_orders", c("orders"), c("quality_order_count"), zero),
        pair("quality_net_equals_sales", c("quality_line_net_amount"), c("sales"), near),
        pair("quality_source_equals_sales", c("quality_source_line_total"), c("sales"), near),
        pair("aov_rederived", c("aov"), aov, near),
        pair("trend_sums_to_sales", c("trend_sum"), c("sales"), near),
        pair("category_sums_to_sales", c("category_sum"), c("sales"), near),
        pair("territory_sums_to_sales", c("territory_sum"), c("sales"), near),
        pair("no_point_before_start", c("early_points"), zero, zero),
    ]
    return wide.select(F.inline(F.array(*pairs)))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows, schema digest, order-free content digest."""
    schema = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    return df.agg(*set_digest([F.col(f"`{c}`") for c in df.columns])).select(
        F.col("_rows").alias("rows"),
        F.sha2(F.lit(schema), 256).alias("schema_sha256"),
        finish_digest().alias("content_sha256"),
    )


def rollup_compare(points: DataFrame, totals: DataFrame) -> DataFrame:
    """Month-by-category points rolled up must equal independent category totals exactly."""
    rolled = points.groupBy("category").agg(F.sum("sales_amount").cast("decimal(38,6)").alias("rolled"))
    joined = rolled.join(totals.select("category", F.col("sales_amount").alias("independent")), "category", "full")
    return joined.select(
        "category", "rolled", "independent", F.col("rolled").eqNullSafe(F.col("independent")).alias("same")
    )
