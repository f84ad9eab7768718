"""Registered queries: name -> (callable(spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn: QueryFn) -> QueryFn:
        key = name or fn.__name__
        if key in REGISTRY:
            raise ValueError(key)
        REGISTRY[key] = (fn, sql)
        return fn

    return register


# SQL of the order-free set digest over rows with a hex digest column ``h``.
_WORD = "CAST(CAST(sum(CAST('0x' || substr(h, {0}, 15) AS BIGINT)) AS HUGEINT) AS VARCHAR)"
DIGEST = "sha256(CAST(count(*) AS VARCHAR) || ':' || " + " || ':' || ".join(_WORD.format(1 + 15 * i) for i in range(4)) + ")"


def row_sql(*cells: str) -> str:
    """SQL of ``scalars.row_text`` hashed: cells are SQL of text, or NULL."""
    return f"sha256(CAST(to_json([{', '.join(f'CAST({c} AS VARCHAR)' for c in cells)}]) AS VARCHAR))"
