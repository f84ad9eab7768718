"""Column functions: date buckets, exact money, URNs, names, snippets, digests."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_AMOUNT = "9999999999999.999999"  # largest decimal(19,6), the bound of a line amount
MICRO = "0.000001"

# Native type words by result kind.
NUMBER_WORDS = (
    "bigint", "int", "integer", "smallint", "tinyint", "decimal", "numeric", "number",
    "float", "real", "double", "double precision", "money", "smallmoney",
)
TIME_WORDS = (
    "date", "datetime", "datetime2", "smalldatetime", "datetimeoffset", "timestamp",
    "timestamp with time zone", "timestamp without time zone",
)
BOOLEAN_WORDS = ("boolean", "bool", "bit")


def dec(value: str, precision: int = 19, scale: int = 6) -> Column:
    return F.lit(value).cast(f"decimal({precision},{scale})")


def date_bucket(column: Column, bucket: str) -> Column:
    """First date of the day, month or year."""
    if bucket == "day":
        return F.to_date(column)
    if bucket not in ("month", "year"):
        raise ValueError("bucket_invalid")
    return F.trunc(column, bucket)


def month_start(column: Column) -> Column:
    return F.trunc(column, "month")


def date_key(column: Column) -> Column:
    return F.year(column) * 10000 + F.month(column) * 100 + F.dayofmonth(column)


def calendar_dim(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day of the closed range."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("full_date")
    )
    return days.select(
        date_key(F.col("full_date")).alias("date_key"),
        "full_date",
        F.year("full_date").alias("calendar_year"),
        F.quarter("full_date").alias("calendar_quarter"),
        F.month("full_date").alias("calendar_month"),
        F.date_format("full_date", "MMMM").alias("month_name"),
        F.dayofmonth("full_date").alias("day_of_month"),
    )


def line_net_amount(quantity: Column, price: Column, discount: Column) -> Column:
    """quantity * price * (1 - discount), rounded once to 6 places, half up.

    The inputs are int and decimal(19,4); the product type is decimal(38,6), so
    the multiplication itself carries the single rounding.
    """
    exact = quantity.cast("int") * price.cast("decimal(19,4)") * (F.lit(1) - discount.cast("decimal(19,4)"))
    return F.round(exact, 6).cast("decimal(38,6)")


def amount_in_range(amount: Column) -> Column:
    return (amount >= 0) & (amount <= dec(MAX_AMOUNT))


def average_order_value(total: Column, orders: Column) -> Column:
    """Ratio at 6 places, half away from zero; NULL when there are no orders."""
    return F.round(total.cast("decimal(38,6)") / F.nullif(orders, F.lit(0)), 6).cast("decimal(38,6)")


def unknown_label(column: Column) -> Column:
    return F.coalesce(column, F.lit("Unknown"))


def unknown_id(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def column_kind(native: Column) -> Column:
    """number / time / boolean / string from a native type word, length suffix ignored."""
    word = F.trim(F.split(F.lower(F.coalesce(native, F.lit(""))), r"\(")[0])
    return (
        F.when(word.isin(*NUMBER_WORDS), "number")
        .when(word.isin(*TIME_WORDS), "time")
        .when(word.isin(*BOOLEAN_WORDS), "boolean")
        .otherwise("string")
    )


def sorted_json(fields: dict[str, Column]) -> Column:
    """JSON text with keys in name order; NULL members are kept as null."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def canonical_digest(fields: dict[str, Column]) -> Column:
    return F.sha2(sorted_json(fields), 256)


def stable_id(prefix: str, scope: Column, kind: Column, local_id: Column) -> Column:
    """Content-independent identity of (scope, kind, local id)."""
    return F.concat(F.lit(prefix), F.sha2(F.to_json(F.array(scope, kind, local_id)), 256))


_URN = r"^urn:li:dataset:\(urn:li:dataPlatform:([^,()]+),([^,()]+),([^,()]+)\)$"


def parse_urn(urn: Column) -> tuple[Column, Column, Column]:
    """(platform, name, environment), NULL unless the URN has exactly three parts."""
    whole = F.when(urn.rlike(_URN), urn)
    return tuple(F.regexp_extract(whole, _URN, i) for i in (1, 2, 3))


def _nfkc(name: Column) -> Column:
    # Defined inside so it ships to executors by value, without installing the package there.
    @F.pandas_udf(StringType())
    def nfkc(names: pd.Series) -> pd.Series:
        return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))

    return nfkc(name)


def normalize_name(name: Column) -> Column:
    """NFKC, trimmed, inner whitespace collapsed, lower case; blanks that NFKC leaves are whitespace too."""
    return F.lower(F.trim(F.regexp_replace(_nfkc(name), r"[\s\u1680\u2028\u2029\uFEFF]+", " ")))


def contains_ci(needle: str, *columns: Column) -> Column:
    low = F.lit(needle.lower())
    hits = [F.coalesce(F.contains(F.lower(c), low), F.lit(False)) for c in columns]
    result = hits[0]
    for hit in hits[1:]:
        result = result | hit
    return result


def snippet(text: Column, needle: str, width: int = 80) -> tuple[Column, Column, Column]:
    """(before, match, after) of the first literal, case-insensitive hit, whitespace collapsed.

    Lower-casing must not change the text length for offsets to hold; letters for
    which it does (such as dotted capital I) are outside the guarantee.
    """
    size = len(needle)
    at = F.locate(needle.lower(), F.lower(text))

    def flat(c: Column) -> Column:
        return F.regexp_replace(c, r"\s+", " ")

    start = F.greatest(at - width, F.lit(1))
    before = F.ltrim(flat(F.substring(text, start, at - start)))
    before = F.concat(F.when(at - 1 > width, "...").otherwise(""), before)
    after = F.rtrim(flat(F.substring(text, at + size, F.lit(width))))
    after = F.concat(after, F.when(F.length(text) - (at + size - 1) > width, "...").otherwise(""))
    match = flat(F.substring(text, at, F.lit(size)))
    return (F.when(at > 0, before), F.when(at > 0, match), F.when(at > 0, after))


def json_at(text: Column, pointer: str) -> Column:
    """Value at an RFC 6901 pointer as text; NULL when missing, 'null' when a JSON null."""
    path = "$"
    for token in pointer.split("/")[1:]:
        token = token.replace("~1", "/").replace("~0", "~")
        path += f"[{token}]" if token.isdigit() else "['" + token.replace("'", "\\'") + "']"
    found = F.try_variant_get(F.try_parse_json(text), path, "variant")
    return F.when(found.isNotNull(), F.to_json(found))


def row_text(parts: Sequence[Column]) -> Column:
    """JSON array of the cells as text; NULL is null, so no cell can be taken for another or for a separator."""
    return F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"})


def digest_sums(parts: Sequence[Column]) -> dict[str, Column]:
    """What ``set_digest`` aggregates, by name; also usable over a window."""
    row = F.sha2(row_text(parts), 256)
    words = {f"_w{i}": F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)}
    return {"_rows": F.count(F.lit(1)), **words}


def set_digest(parts: Sequence[Column]) -> list[Column]:
    """Aggregates for an order-free digest of a row set: four decimal sums of digest words.

    One pass with partial aggregation; no row or task ever holds the set. Combine
    with ``finish_digest``.
    """
    return [total.alias(name) for name, total in digest_sums(parts).items()]


def finish_digest() -> Column:
    words = [F.coalesce(F.col(f"_w{i}"), F.lit(0)).cast("string") for i in range(4)]
    return F.sha2(F.concat_ws(":", F.col("_rows").cast("string"), *words), 256)
