"""Comparing two copies of a table by trees of digests.

Rows fall into leaves by the hash of their key. A leaf's digest is an order-free sum over its
rows, one aggregation per copy; a node's digest is made from those of its children. Trees are small
tables (at most 2^(6 x levels) leaves) that can be kept and compared later without the rows.
The comparison starts at the root and opens only nodes that differ; rows are read again only for
differing leaves. Equal copies end at the root.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martweave.functions.scalars import finish_digest, row_text, set_digest
from martweave.functions.scale import stage

FANOUT_BITS = 6
LEVELS = 3


def leaf_of(key: Sequence[str], levels: int = LEVELS) -> Column:
    """Leaf of a row: the first bits of its key's hash."""
    text = row_text([F.col(f"`{k}`") for k in key])
    return F.shiftrightunsigned(F.xxhash64(text), 64 - FANOUT_BITS * levels)


def digest_tree(df: DataFrame, key: Sequence[str], levels: int = LEVELS) -> DataFrame:
    """(level, node, rows, digest) of every node that has rows; level 0 is the root, the leaves are at ``levels``."""
    cells = [F.col(f"`{c}`") for c in sorted(df.columns)]
    leaves = df.groupBy(leaf_of(key, levels).alias("node")).agg(*set_digest(cells))
    level = stage(leaves.select(F.lit(levels).alias("level"), "node", F.col("_rows").alias("rows"), finish_digest().alias("digest")), "copy-leaves")
    tree = level
    for depth in range(levels - 1, -1, -1):
        children = level.groupBy(F.shiftright("node", FANOUT_BITS).alias("_node")).agg(
            F.sum("rows").alias("rows"), *set_digest([F.col("node"), F.col("digest")]))
        level = children.select(F.lit(depth).alias("level"), F.col("_node").alias("node"), "rows", finish_digest().alias("digest"))
        tree = tree.unionByName(level)
    return tree


def differing_leaves(left: DataFrame, right: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(node) of the leaves in which two trees differ, found from the root down."""
    open_: DataFrame | None = None
    for depth in range(levels + 1):
        sides = []
        for name, tree in (("left", left), ("right", right)):
            own = tree.filter(F.col("level") == depth).select("node", F.col("digest").alias(name))
            if open_ is not None:
                own = own.withColumn("_up", F.shiftright("node", FANOUT_BITS)).join(open_.select(F.col("node").alias("_up")), "_up", "left_semi").drop("_up")
            sides.append(own)
        met = sides[0].join(sides[1], "node", "full")
        open_ = stage(met.filter(~F.col("left").eqNullSafe(F.col("right"))).select("node"), "copy-nodes")
        if open_.isEmpty():
            break
    return open_


def compare_copies(left: DataFrame, right: DataFrame, key: Sequence[str], levels: int = LEVELS) -> DataFrame:
    """(key…, left_rows, right_rows, finding) of every key whose rows differ: missing, extra or changed.

    Rows are compared as multisets, NULL equal to NULL, column by column name; a copy with other
    columns or types is an error. Nothing is joined: rows of the differing leaves are counted
    by their text on both sides.
    """
    if {f.name: f.dataType for f in left.schema} != {f.name: f.dataType for f in right.schema}:
        raise ValueError("copies_have_different_columns")
    names = sorted(left.columns)
    leaves = differing_leaves(digest_tree(left, key, levels), digest_tree(right, key, levels), levels)

    def opened(df: DataFrame, side: str) -> DataFrame:
        own = df.withColumn("_b", leaf_of(key, levels)).join(leaves.withColumnRenamed("node", "_b"), "_b", "left_semi")
        return own.select(*[f"`{k}`" for k in key], F.sha2(row_text([F.col(f"`{c}`") for c in names]), 256).alias("_h"),
                          F.lit(int(side == "left")).alias("_l"), F.lit(int(side == "right")).alias("_r"))

    rows = opened(left, "left").unionByName(opened(right, "right"))
    keys = [f"`{k}`" for k in key]
    texts = rows.groupBy(*keys, "_h").agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    found = texts.groupBy(*keys).agg(F.sum("_l").alias("left_rows"), F.sum("_r").alias("right_rows"), F.count_if(F.col("_l") != F.col("_r")).alias("_n"))
    finding = F.when(F.col("right_rows") == 0, "missing").when(F.col("left_rows") == 0, "extra").otherwise("changed")
    return found.filter("_n > 0").select(*keys, "left_rows", "right_rows", finding.alias("finding"))


def column_totals(df: DataFrame) -> DataFrame:
    """(position, column, type, rows, nulls, total) per column: the sum of a number, the characters of a text, true values."""
    parts = []
    for i, f in enumerate(df.schema.fields):
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("byte", "short", "integer", "long") or kind.startswith("decimal"):
            scale_ = f.dataType.scale if kind.startswith("decimal") else 0
            total = F.sum(c.cast(f"decimal(38,{scale_})"))
        elif kind == "boolean":
            total = F.count_if(c)
        else:
            total = F.sum(F.length(c.cast("string")).cast("long"))
        parts.append((i, f, F.count_if(c.isNull()).alias(f"_n{i}"), total.cast("string").alias(f"_t{i}")))
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[n for _, _, n, _ in parts], *[t for _, _, _, t in parts])
    rows = F.array(*[F.struct(
        F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("_rows").alias("rows"),
        F.col(f"_n{i}").alias("nulls"), F.col(f"_t{i}").alias("total")) for i, f, _, _ in parts])
    return wide.select(F.inline(rows))


def compare_totals(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns whose type, rows, nulls or total differ between two copies, or that only one has."""
    fields = ["type", "rows", "nulls", "total"]
    one = lambda df, side: column_totals(df).select("column", F.struct(*fields).alias(side))
    met = one(left, "left").join(one(right, "right"), "column", "full")
    return met.filter(~F.col("left").eqNullSafe(F.col("right"))).select(
        "column", *[F.col(f"left.{c}").alias(f"left_{c}") for c in fields], *[F.col(f"right.{c}").alias(f"right_{c}") for c in fields])
