"""JSON documents as rows: one per value, addressed by its JSON pointer.

``flatten`` opens documents level by level: every round explodes the objects and arrays of the
level before and writes their members, until no container with members is left. There are as many rounds as the
deepest document has levels, a wide document becomes rows before it is opened further, and
no Python runs. Pointers follow RFC 6901 (``~`` is ``~0`` and ``/`` is ``~1`` in a name), so a
pointer that is data can be met by an equality join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martweave.functions.scale import stage

CONTAINERS = ("object", "array")


def value_kind(text: Column) -> Column:
    """object, array, string, boolean, null or number, from canonical JSON text."""
    first = F.substring(text, 1, 1)
    return (
        F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string")
        .when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number"))


def canonical_json(text: Column) -> Column:
    """JSON text with members in name order and no blanks; NULL when it is no JSON or repeats a name."""
    return F.to_json(F.try_parse_json(text))


def escape_token(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _plain_number(text: Column) -> Column:
    # 1.0 and 1 are one number; a whole double is written with its .0
    return F.regexp_replace(text, r"\.0$", "")


def flatten(docs: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys…, pointer, kind, text) for every value of the JSON in column ``text``.

    The root has the pointer ``''``; ``text`` is the value's canonical JSON, a whole number without
    its ``.0``. NULL, and text that is no JSON or repeats a member name, has no rows. Documents
    with equal keys are flattened side by side.
    """
    spark = docs.sparkSession

    def shaped(df: DataFrame, pointer: Column, value: Column) -> DataFrame:
        own = df.select(*keys, pointer.alias("pointer"), value.alias("text")).withColumn("kind", value_kind(F.col("text")))
        number = F.when(F.col("kind") == "number", _plain_number(F.col("text"))).otherwise(F.col("text"))
        return stage(own.select(*keys, "pointer", "kind", number.alias("text")), "json-level")

    root = docs.select(*keys, canonical_json(F.col(text)).alias("_v")).filter(F.col("_v").isNotNull())
    level = shaped(root, F.lit(""), F.col("_v"))
    levels = [level]
    while True:
        inside = level.filter(F.col("kind").isin(*CONTAINERS) & ~F.col("text").isin("{}", "[]"))
        if inside.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        children = inside.lateralJoin(spark.tvf.variant_explode(F.parse_json(F.col("text").outer())))
        token = F.when(F.col("kind") == "array", F.col("pos").cast("string")).otherwise(escape_token(F.col("key")))
        named = children.select(*keys, F.concat("pointer", F.lit("/"), token).alias("_p"), F.to_json("value").alias("_v"))
        level = shaped(named, F.col("_p"), F.col("_v"))
        levels.append(level)


def valid_pointer(pointer: Column) -> Column:
    """Empty or led by ``/``, and ``~`` only as ``~0`` or ``~1``."""
    return pointer.rlike(r"^(?:/(?:[^~]|~[01])*)?$")


def values_at(docs: DataFrame, keys: Sequence[str], text: str, pointers: DataFrame) -> DataFrame:
    """(keys…, pointer, kind, text) for pointers(keys…, pointer); kind and text are NULL where nothing is there.

    Only documents that a pointer names are opened.
    """
    asked = pointers.select(*keys, "pointer").distinct()
    opened = docs.join(asked.select(*keys).distinct(), list(keys), "left_semi")
    found = flatten(opened, keys, text)
    return asked.join(found, [*keys, "pointer"], "left")


def lost_values(old: DataFrame, new: DataFrame, keys: Sequence[str], stamps: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """What a new version of a document does not keep: (keys…, pointer, finding).

    old(keys…, text) and new(keys…, text) hold one document per key. Kept are all values in
    place: scalars unchanged, objects with all their members, arrays with all their elements at
    their index, so that objects may gain members and arrays may gain elements at the end, at any
    depth. Findings: ``value_missing``, ``value_changed``, ``kind_changed`` and, for an old text
    that is no JSON, ``old_unreadable``.

    ``stamps`` names audit stamps that may advance: pointer patterns per ``aspect``; ``old`` then
    also has ``aspect`` and ``stamp`` (JSON). A value at such a pointer is kept if the new value
    equals the stamp.
    """
    keys = list(keys)
    before = flatten(old, keys, "text")
    after = flatten(new, keys, "text").select(*keys, "pointer", F.col("kind").alias("_kind"), F.col("text").alias("_text"))
    met = before.join(after, [*keys, "pointer"], "left")
    scalar = ~F.col("kind").isin(*CONTAINERS)
    finding = (
        F.when(F.col("_kind").isNull(), "value_missing")
        .when(F.col("_kind") != F.col("kind"), "kind_changed")
        .when(scalar & (F.col("_text") != F.col("text")), "value_changed"))
    lost = met.withColumn("finding", finding).filter(F.col("finding").isNotNull()).select(*keys, "pointer", "finding")
    unreadable = old.filter(canonical_json(F.col("text")).isNull()).select(*keys, F.lit("").alias("pointer"), F.lit("old_unreadable").alias("finding"))
    if not stamps:
        return lost.unionByName(unreadable)
    return _without_stamps(lost, old, after, keys, stamps).unionByName(unreadable)


def _without_stamps(lost: DataFrame, old: DataFrame, after: DataFrame, keys: list[str], stamps: dict[str, Sequence[str]]) -> DataFrame:
    rule = F.lit(None).cast("string")
    for aspect, patterns in stamps.items():
        for pattern in patterns:
            at = F.regexp_extract("pointer", f"^({pattern})(?:/.*)?$", 1)
            rule = F.coalesce(rule, F.when((F.col("aspect") == aspect) & (at != ""), at))
    stamped = lost.join(old.select(*keys, "aspect"), keys).withColumn("_at", rule)
    places = stage(stamped.filter(F.col("_at").isNotNull()).select(*keys, "_at").distinct(), "stamp-places")
    # The new subtree at a place and the stamp are equal if they have as many values, and as many equal ones.
    relative = F.substring(F.col("pointer"), F.length("_at") + 1, F.length("pointer"))
    there = after.join(places, keys).filter((F.col("pointer") == F.col("_at")) | F.startswith("pointer", F.concat("_at", F.lit("/")))).select(
        *keys, "_at", relative.alias("pointer"), "_kind", F.when(~F.col("_kind").isin(*CONTAINERS), F.col("_text")).alias("_text"))
    stamp = flatten(old.join(places.select(*keys).distinct(), keys, "left_semi"), keys, "stamp").select(
        *keys, "pointer", "kind", F.when(~F.col("kind").isin(*CONTAINERS), F.col("text")).alias("text"))
    sizes = stamp.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    same = there.join(stamp, [*keys, "pointer"], "left").groupBy(*keys, "_at").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if((F.col("kind") == F.col("_kind")) & F.col("text").eqNullSafe(F.col("_text"))).alias("_equal"))
    advanced = same.join(sizes, keys).filter("_n = _size AND _equal = _size").select(*keys, "_at")
    return stamped.join(advanced, [*keys, "_at"], "left_anti").select(*keys, "pointer", "finding")
