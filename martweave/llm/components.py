"""Connected components of an edge table, by alternating star contraction.

Each round hangs every neighbour of a node below the smallest one it knows (first from
the larger neighbours, then from the smaller), so chains fold in a logarithmic number of
rounds. Rounds are written tables; a hub's rows are summed before they are shuffled and
joined with splittable joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martweave.functions.scale import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. Large: larger neighbours move to the least node around; small: smaller ones do."""
    around = edges if not large else edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage(around.groupBy("u").agg(F.min("v").alias("m")), "star-least")
    if large:
        least = least.select("u", F.least("u", "m").alias("m"))
        moved = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from every node that has an edge; nulls and loops are ignored."""
    pairs = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    current = stage(pairs, "star-edges")
    mark = None
    while True:
        current = stage(_star(stage(_star(current, True), "star-large"), False), "star-edges")
        now = tuple(current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            break
        mark = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
