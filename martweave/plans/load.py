"""The mart load: validate, upsert dimensions and fact into new versions, reconcile, publish."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martweave.functions import scale
from martweave.functions.scalars import average_order_value, canonical_digest
from martweave.operators import mart, quality
from martweave.operators.mart import Scope
from martweave.plans import reports
from martweave.sources.sinks import current_paths, folders, is_published, publish, replace_table, version_path

DIMENSIONS = ["dim_date", "dim_territory", "dim_product", "dim_customer"]

EXTRACT_SPECS = {
    "products": {
        "source_product_id": ("id", False),
        "product_name": ("text", False),
        "product_number": ("text", False),
        "source_product_subcategory_id": ("id", True),
        "product_subcategory_name": ("text", True),
        "source_product_category_id": ("id", True),
        "product_category_name": ("text", True),
    },
    "customers": {"source_customer_id": ("id", False), "source_territory_id": ("id", True)},
    "territories": {
        "source_territory_id": ("id", False),
        "territory_name": ("text", False),
        "country_region_code": ("text", False),
        "territory_group": ("text", False),
    },
    "facts": {
        "sales_order_id": ("id", False),
        "sales_order_detail_id": ("id", False),
        "order_date": ("date", False),
        "source_product_id": ("id", False),
        "source_customer_id": ("id", False),
        "source_territory_id": ("id", True),
        "status": ("int", False),
        "currency_rate_id": ("id", True),
        "order_qty": ("int", False),
        "unit_price": ("decimal4", False),
        "unit_price_discount": ("decimal4", False),
        "source_line_total": ("decimal6", False),
    },
}


class LoadRejected(RuntimeError):
    """The load stopped and what was current before is current; ``reasons`` holds rule counts."""

    def __init__(self, reasons: dict[str, int]):
        super().__init__(", ".join(f"{k}={v}" for k, v in sorted(reasons.items())))
        self.reasons = reasons


@dataclass
class Mart:
    fact: DataFrame
    dims: dict[str, DataFrame]

    @property
    def view(self) -> DataFrame:
        return mart.sales_view(self.fact, self.dims)

    @property
    def report_view(self) -> DataFrame:
        """The view without its customer column, for reports that do not use it."""
        return mart.sales_view(self.fact, self.dims, customer=False)


def _counts(violations: DataFrame) -> dict[str, int]:
    # Bounded by the number of rules.
    return {r["rule"]: r["n"] for r in violations.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).collect()}


def _require(violations: DataFrame) -> None:
    reasons = _counts(violations)
    if reasons:
        raise LoadRejected(reasons)


def prepare(sources: dict[str, DataFrame], scope: Scope) -> dict[str, DataFrame]:
    """Extract, coerce and validate; every input is written once and read from there on."""
    extracted = mart.extract(sources, scope)
    staged = scale.together({n: (lambda n=n, df=df: scale.stage(df, n)) for n, df in extracted.items()})
    inputs, problems = {}, None
    for name, df in staged.items():
        inputs[name], bad = quality.coerce_source(df, EXTRACT_SPECS[name])
        rows = bad.select(F.explode("reasons").alias("rule"))
        problems = rows if problems is None else problems.unionByName(rows)
    _require(problems.unionByName(quality.check_extract(inputs, scope).select("rule")))
    return inputs


def preview_load(sources: dict[str, DataFrame], scope: Scope) -> DataFrame:
    """Dry run: the five totals and source row counts, nothing written to the mart."""
    inputs = prepare(sources, scope)
    counts = [
        inputs[n].agg(F.count(F.lit(1)).cast("string").alias("value")).withColumn("measure", F.lit(f"source_{n}"))
        for n in ("products", "customers", "territories")
    ]
    totals = quality.scope_totals(inputs["facts"])
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("string").alias("value"))
                      for m in quality.TOTALS])
    result = totals.select(F.inline(pairs))
    for part in counts:
        result = result.unionByName(part)
    return result


TABLES = dict(mart.DIM_SCHEMAS)
_MONTH = "fact/"  # names of the fact's months in the version log


def _first_dimensions(spark: SparkSession) -> dict[str, DataFrame]:
    """The dimensions before a first load: only their Unknown members."""
    return {d: mart.unknown_member(spark, d) for d in DIMENSIONS}


def fact_months(paths: dict[str, str]) -> dict[int, str]:
    """Folder of every month of the fact among published paths."""
    return {int(name[len(_MONTH):]): path for name, path in paths.items() if name.startswith(_MONTH)}


def read_fact(spark: SparkSession, months: dict[int, str]) -> DataFrame:
    if not months:
        return spark.createDataFrame([], mart.FACT_SCHEMA)
    return spark.read.schema(mart.FACT_SCHEMA).parquet(*[months[m] for m in sorted(months)])


def write_fact(fact: DataFrame, root: str) -> dict[int, str]:
    """Write the lines as one version, a folder per month, and return the folders.

    Months are brought together by size: small ones share a task, a large one is split. Inside
    a folder lines are sorted by date, so statistics of files and row groups prune reports.
    """
    path = version_path(root, "fact")
    placed = fact.withColumn(mart.FACT_MONTH, mart.order_month()).hint("rebalance", mart.FACT_MONTH)
    placed.sortWithinPartitions(mart.FACT_MONTH, "order_date_key", *mart.FACT_KEY).write.partitionBy(mart.FACT_MONTH).parquet(path)
    lead = f"{mart.FACT_MONTH}="
    return {int(name[len(lead):]): f"{path}/{name}" for name in folders(fact.sparkSession, path) if name.startswith(lead)}


def update_fact(spark: SparkSession, root: str, current: dict[int, str], incoming: DataFrame) -> dict[int, str]:
    """Month folders after the incoming lines are merged in; months without a changed line keep theirs.

    A line that moves to another month is taken out of its old one. The months are those of a
    calendar, so the manifest stays small whatever the number of lines.
    """
    changed = scale.stage(mart.changed_facts(read_fact(spark, current), incoming), "fact-changes")
    both = F.explode(F.array(mart.order_month(), F.col("old_month"))).alias("m")
    touched = {r["m"] for r in changed.select(both).filter("m IS NOT NULL").distinct().collect()}
    if not touched:
        return current
    affected = read_fact(spark, {m: p for m, p in current.items() if m in touched})
    written = write_fact(mart.replace_lines(affected, changed), root)
    return {**{m: p for m, p in current.items() if m not in touched}, **written}


def _current_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    paths = current_paths(spark, root)
    dims = {name: spark.read.schema(TABLES[name]).parquet(paths[name]) for name in DIMENSIONS}
    return {**dims, "fact": read_fact(spark, fact_months(paths))}


def open_mart(spark: SparkSession, root: str) -> Mart:
    tables = _current_tables(spark, root)
    return Mart(tables["fact"], {d: tables[d] for d in DIMENSIONS})


def load_mart(sources: dict[str, DataFrame], root: str, scope: Scope) -> DataFrame:
    """Run one load into the mart at ``root`` and return its one-row receipt.

    A published mart at ``root`` is carried on: its members keep their keys and its other
    fact rows stay. Dimensions, and the months of the fact in which a line changed, are written
    as new versions, read back and checked as written; only then do all versions become
    current, in one step. Months without a change keep their files.
    """
    spark = sources["customer"].sparkSession
    inputs = prepare(sources, scope)
    current, exists = _first_dimensions(spark), is_published(spark, root)
    if exists:
        current = _current_tables(spark, root)
        if not mart.unknown_member_check({d: current[d] for d in DIMENSIONS}).first()["canonical"]:
            raise LoadRejected({"target_unknown_member_invalid": 1})

    written: dict[str, str] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        path = version_path(root, name)
        df.write.parquet(path)
        written[name] = path
        return spark.read.schema(TABLES[name]).parquet(path)

    def upsert(name: str, incoming: DataFrame, key: str, attrs: list[str], surrogate: str) -> DataFrame:
        return keep(name, mart.upsert_type1(current[name], incoming, key, attrs, surrogate))

    dims = scale.together({
        "dim_date": lambda: keep("dim_date", mart.insert_if_absent(
            current["dim_date"], mart.calendar(spark, scope), "date_key")),
        "dim_territory": lambda: upsert(
            "dim_territory", inputs["territories"], "source_territory_id",
            ["territory_name", "country_region_code", "territory_group"], "territory_key"),
        "dim_product": lambda: upsert(
            "dim_product", inputs["products"], "source_product_id", inputs["products"].columns[1:], "product_key"),
    })
    customers = mart.lookup_surrogate(
        inputs["customers"], dims["dim_territory"], "source_territory_id", "territory_key", optional=True)
    dims["dim_customer"] = upsert(
        "dim_customer", customers, "source_customer_id", ["source_territory_id", "territory_key"], "customer_key")

    incoming = mart.build_fact(inputs["facts"], dims)
    months = update_fact(spark, root, fact_months(current_paths(spark, root)), incoming) if exists else write_fact(incoming, root)
    written.update({f"{_MONTH}{m}": p for m, p in months.items()})
    fact = read_fact(spark, months)

    loaded = Mart(fact, dims)
    missing = mart.unresolved(fact, ["product_key", "customer_key", "territory_key"])
    _require(missing.select(F.concat(F.lit("unresolved_"), "surrogate").alias("rule")))
    # Five rows, one per measure.
    measures = quality.reconcile_all({
        "source": quality.scope_totals(inputs["facts"]),
        "target": quality.target_totals(fact, dims["dim_date"], scope),
        "view": quality.conditional_totals(mart.scope_flag(loaded.view, scope)),
    }).collect()
    for left, right, rule in (("source", "target", "target_source_reconciliation_failed"),
                              ("target", "view", "reporting_view_metrics_mismatch")):
        broken = sum(m[f"{left}_value"] != m[f"{right}_value"] for m in measures)
        if broken:
            raise LoadRejected({rule: broken})

    # The receipt is computed from the written versions before they are published: that is the read-back.
    receipt = scale.stage(run_receipt(inputs, loaded, scope), "receipt")
    row = receipt.select(*[F.col(c).cast("string") for c in RECEIPT_MEASURES.values()]).first()
    changed = sum(row[RECEIPT_MEASURES[m["measure"]]] != m["target_value"] for m in measures)
    if changed:
        raise LoadRejected({"readback_mismatch": changed})
    publish(spark, root, written)
    return receipt


RECEIPT_MEASURES = {
    "fact_count": "target_fact_rows", "quantity": "quantity", "line_net_amount": "line_net_amount",
    "source_line_total": "source_line_total", "order_count": "orders",
}


def run_receipt(inputs: dict[str, DataFrame], loaded: Mart, scope: Scope) -> DataFrame:
    """One row of counts, reconciliation amounts and average order value, with its digest."""
    view = quality.conditional_totals(mart.scope_flag(loaded.view, scope))
    marked = view.select(
        F.lit("target").alias("part"),
        F.col("fact_count").alias("target_fact_rows"),
        F.col("view_count").alias("reporting_view_rows"),
        "quantity", F.col("order_count").alias("orders"), "line_net_amount", "source_line_total",
    )
    for name in ("products", "customers", "territories", "facts"):
        n = inputs[name].agg(F.count(F.lit(1)).alias(f"source_{name}"))
        marked = marked.unionByName(n, allowMissingColumns=True)
    # Every part is one row with its own columns; max folds them into a single row.
    row = marked.agg(*[F.max(c).alias(c) for c in marked.columns if c != "part"])
    row = row.withColumn("aov", average_order_value(F.col("line_net_amount"), F.col("orders")))
    row = row.withColumns({"scope_start": F.lit(scope.start), "scope_end": F.lit(scope.end),
                           "status": F.lit("COMMITTED")})
    return row.withColumn("receipt_sha256", canonical_digest({c: F.col(c).cast("string") for c in row.columns}))


def refresh_summaries(loaded: Mart, root: str) -> dict[str, DataFrame]:
    """Rebuild both monthly summaries, each checked against the fact before it becomes current."""
    parts = {
        "monthly_category_summary": reports.monthly_category_summary(
            loaded.fact, loaded.dims["dim_date"], loaded.dims["dim_product"]),
        "monthly_territory_summary": reports.monthly_territory_summary(
            loaded.fact, loaded.dims["dim_date"], loaded.dims["dim_territory"]),
    }
    result = {}
    for name, expected in parts.items():
        def ok(written: DataFrame, expected: DataFrame = expected) -> bool:
            return quality.reconcile_summary(loaded.fact, expected, written).filter(~F.col("same")).isEmpty()

        result[name] = replace_table(expected, root, name, ok)
    return result
