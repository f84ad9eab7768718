"""Catalog and governance records as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martweave.functions import documents, scale
from martweave.functions.scalars import contains_ci, finish_digest, normalize_name, set_digest
from martweave.operators.lineage import visible_only
from martweave.operators.quality import all_violations, violation

# Association kinds, and the relationship types that use a definition.
ASSOCIATIONS = ("domain", "tag", "term")
USED_BY = {
    "domain": ("AssociatedWith", "IsPartOf"),
    "node": ("IsPartOf",),
    "term": ("TermedWith", "IsA", "HasA"),
    "tag": ("TaggedWith",),
}
# Audit stamps that an edit advances, as pointer patterns per aspect.
STAMPS = {
    "editableSchemaMetadata": ("/lastModified", "/editableSchemaFieldInfo/[^/]+/glossaryTerms/auditStamp"),
    "ownership": ("/lastModified",),
    "glossaryTerms": ("/auditStamp",),
}


# --- search and fields -----------------------------------------------------------------


def search_catalog(
    entities: DataFrame,
    associations: DataFrame,
    grants: DataFrame,
    actor: str,
    text: str = "",
    types: Sequence[str] | None = None,
    filters: Mapping[str, str] | None = None,
    browse_path: Sequence[str] | None = None,
    related_to: tuple[str, str] | None = None,
) -> DataFrame:
    """Visible entities(urn, type, name, description, platform, environment, browse_path) that match.

    ``related_to`` is (kind, value): an association of the asset itself or of any
    of its fields, from associations(asset, field, kind, value).
    """
    rows = entities
    if types is not None:
        rows = rows.filter(F.col("type").isin(*types))
    for column, value in (filters or {}).items():
        rows = rows.filter(F.col(column) == value)
    if browse_path is not None:
        rows = rows.filter(F.col("browse_path") == "/".join(browse_path))
    if text:
        rows = rows.filter(contains_ci(text, F.col("name"), F.col("description")))
    if related_to is not None:
        kind, value = related_to
        linked = associations.filter((F.col("kind") == kind) & (F.col("value") == value)).select(
            F.col("asset").alias("urn")).distinct()
        rows = rows.join(linked, "urn", "left_semi")
    return visible_only(rows, grants, actor, "urn")


def list_fields(
    fields: DataFrame, *, path: str | None = None, text: str | None = None, sort: str = "path"
) -> tuple[DataFrame, list[tuple[str, bool]]]:
    """Matching fields(dataset, path, native_type, type) and their order for ``page``: by path, or by type and path."""
    rows = fields
    if path is not None:
        rows = rows.filter(F.col("path") == path)
    elif text is not None:
        rows = rows.filter(contains_ci(text, F.col("path"), F.col("native_type"), F.col("type")))
    return rows, [(c, False) for c in (["native_type"] if sort == "type" else []) + ["path", "dataset"]]


def effective_description(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited description before the source one, both kept: fields and edits (dataset, path, description)."""
    edited = edits.select("dataset", "path", F.col("description").alias("edited_description"))
    return fields.join(edited, ["dataset", "path"], "left").select(
        "dataset", "path", F.col("description").alias("source_description"), "edited_description",
        F.coalesce("edited_description", "description").alias("description"))


def collect_references(places: Mapping[str, DataFrame]) -> DataFrame:
    """Distinct references per field with the places that named each; at most one entry per place."""
    tagged = None
    for source, df in places.items():
        one = df.select("dataset", "path", "kind", "urn", F.lit(source).alias("source"))
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy("dataset", "path", "kind", "urn").agg(
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


# --- vocabulary --------------------------------------------------------------------------


def find_duplicate_terms(terms: DataFrame) -> DataFrame:
    """terms(urn, kind, name, parent) -> per term how many others share its name.

    Same kind and normalized name is a duplicate; for nodes and terms another
    parent makes it a same name in another hierarchy. Counts and the smallest
    other-urn candidate per group are joined back, so a name used a million times
    costs a million rows, not their pairs.
    """
    named = terms.withColumn("normalized", normalize_name(F.col("name")))
    place = F.when(F.col("kind").isin("node", "term"), F.coalesce("parent", F.lit(""))).otherwise("")
    # Written once: three branches read the names, and normalizing them runs Python.
    named = scale.stage(named.withColumn("place", place), "names")
    here = named.groupBy("kind", "normalized", "place").agg(
        F.count(F.lit(1)).alias("_here"), F.min("urn").alias("first_urn"))
    everywhere = here.groupBy("kind", "normalized").agg(F.sum("_here").alias("_all"))
    return (
        named.join(here.filter("_here > 1"), ["kind", "normalized", "place"], "left")
        .join(everywhere.filter("_all > 1"), ["kind", "normalized"], "left")
        .filter(F.col("_all").isNotNull())
        .select(
            "urn", "kind", "normalized",
            (F.coalesce("_here", F.lit(1)) - 1).alias("duplicates"),
            (F.col("_all") - F.coalesce("_here", F.lit(1))).alias("same_name_other_hierarchy"),
            F.coalesce("first_urn", "urn").alias("group_urn"),
        )
    )


def candidate_conflicts(candidates: DataFrame) -> DataFrame:
    """candidates(asset, field, kind, operation, value) -> conflicting (asset, field, kind, member, reason)."""
    member = F.when(F.col("kind") == "property", F.col("value"))
    groups = candidates.withColumn("member", member).groupBy("asset", "field", "kind", "member").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("operation") == "set").alias("sets"),
        F.count_distinct("value").alias("values"),
    )
    association = F.col("kind").isin(*ASSOCIATIONS)
    reason = (
        F.when(F.col("n") < 2, None)
        .when(~association, "two_values_for_scalar")
        .when(F.col("sets") > 0, "competing_set")
        .when(F.col("values") < F.col("n"), "repeated_member")
    )
    return groups.select("asset", "field", "kind", "member", reason.alias("reason")).filter("reason IS NOT NULL")


def apply_associations(current: DataFrame, changes: DataFrame) -> DataFrame:
    """current(asset, kind, value, position), changes(asset, kind, operation, value, seq) -> new current.

    Operations are set, add and remove, free of conflicts. Kept values come first
    in their old order, new ones follow in the order asked for; positions start at 0.
    """
    key = ["asset", "kind"]
    is_set = changes.groupBy(*key).agg(F.bool_or(F.col("operation") == "set").alias("replaced"))
    wanted = changes.groupBy(*key, "value").agg(
        F.bool_or(F.col("operation") == "remove").alias("removed"),
        F.min(F.when(F.col("operation") != "remove", F.col("seq"))).alias("seq"))
    merged = current.select(*key, "value", F.col("position").cast("long").alias("old")).join(
        wanted, [*key, "value"], "full").join(is_set, key, "left")
    asked = F.col("seq").isNotNull()
    keep = F.when(F.coalesce("replaced", F.lit(False)), asked).otherwise(
        asked | (F.col("old").isNotNull() & ~F.coalesce("removed", F.lit(False))))
    left = merged.filter(keep & F.col("value").isNotNull()).select(
        *key, "value", F.col("old").isNull().alias("is_new"), F.coalesce("old", "seq").alias("spot"))
    ranked = scale.grouped_rank(left, key, ["is_new", "spot", "value"], "_rank")
    return ranked.select(*key, "value", (F.col("_rank") - 1).alias("position"))


def order_domains(associations: DataFrame) -> DataFrame:
    """associations(asset, domain, position, propagated): manual ones first, stable inside each group."""
    ranked = scale.grouped_rank(
        associations.withColumn("_late", F.coalesce("propagated", F.lit(False))), ["asset"],
        ["_late", "position", "domain"], "_rank")
    return ranked.select("asset", "domain", (F.col("_rank") - 1).alias("position"), F.col("_late").alias("propagated"))


def definition_impact(relationships: DataFrame, kind: str, scope: DataFrame, grants: DataFrame, actor: str) -> tuple[DataFrame, DataFrame]:
    """relationships(definition, entity, relationship) -> (listed users, per-definition counts)."""
    used = relationships.filter(F.col("relationship").isin(*USED_BY[kind]))
    inside = used.join(scope.select(F.col("urn").alias("entity")).distinct(), "entity", "left_semi")
    listed = visible_only(inside, grants, actor, "entity")
    counts = used.groupBy("definition").agg(F.count(F.lit(1)).alias("observed")).join(
        listed.groupBy("definition").agg(F.count(F.lit(1)).alias("listed")), "definition", "left")
    return listed, counts.select(
        "definition", "observed", F.coalesce("listed", F.lit(0)).alias("listed"),
        (F.col("observed") != F.coalesce("listed", F.lit(0))).alias("omitted"))


# --- scope and accounting --------------------------------------------------------------------


def scope_violations(members: DataFrame, datasets: DataFrame, fields: DataFrame, run_id: str) -> DataFrame:
    """members(urn), datasets(urn, removed, run_id, schema_version), fields(urn, path)."""
    joined = members.join(datasets, "urn", "left")
    mine = fields.join(members, "urn", "left_semi")
    twice = mine.groupBy("urn", "path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return all_violations(
        violation(joined.filter(F.col("schema_version").isNull()), "member_missing", ["urn"], "schema"),
        violation(joined.filter(F.coalesce("removed", F.lit(False))), "member_removed", ["urn"], "removed"),
        violation(joined.filter(F.col("schema_version").isNotNull() & ~F.col("run_id").eqNullSafe(F.lit(run_id))), "not_latest_run", ["urn"], F.col("run_id")),
        violation(twice, "duplicate_field", ["urn", "path"], F.col("n")),
        violation(mine.filter(F.coalesce("path", F.lit("")) == ""), "empty_field_path", ["urn"], "path"),
    )


def scope_fingerprint(members: DataFrame, datasets: DataFrame, fields: DataFrame) -> DataFrame:
    """One row: dataset and field counts and one digest over (urn, version, path), order-free."""
    versions = datasets.join(members, "urn", "left_semi").select("urn", "schema_version")
    rows = versions.select("urn", "schema_version", F.lit(None).cast("string").alias("path")).unionByName(
        fields.join(versions, "urn").select("urn", "schema_version", "path"))
    parts = [F.col("urn"), F.col("schema_version"), F.col("path")]
    return rows.agg(
        *set_digest(parts), F.count_if(F.col("path").isNull()).alias("dataset_count"),
        F.count("path").alias("field_count"),
    ).select("dataset_count", "field_count", finish_digest().alias("fingerprint"))


def scope_targets(fields: DataFrame) -> DataFrame:
    """Every asset (field NULL) and every asset field: fields(asset, field)."""
    assets = fields.select("asset", F.lit(None).cast("string").alias("field"))
    return assets.unionByName(fields.select("asset", "field")).distinct()


def missing_targets(fields: DataFrame, accounted: DataFrame) -> DataFrame:
    """Targets without a record; the asset itself matches on NULL field."""
    done = accounted.select(F.col("asset").alias("_a"), F.col("field").alias("_f")).distinct()
    targets = scope_targets(fields)
    return targets.join(done, (F.col("asset") == F.col("_a")) & F.col("field").eqNullSafe(F.col("_f")), "left_anti")


def scope_accounting(fields: DataFrame, accounted: DataFrame, pending: DataFrame) -> DataFrame:
    parts = scope_targets(fields).agg(F.count(F.lit(1)).alias("target_count"))
    parts = parts.unionByName(missing_targets(fields, accounted).agg(F.count(F.lit(1)).alias("missing_count")), True)
    parts = parts.unionByName(pending.agg(F.count(F.lit(1)).alias("pending_count")), True)
    row = parts.agg(*[F.max(c).alias(c) for c in ("target_count", "missing_count", "pending_count")])
    whole = (F.col("missing_count") == 0) & (F.col("pending_count") == 0)
    return row.select(
        "target_count", (F.col("target_count") - F.col("missing_count")).alias("accounted_count"), "missing_count",
        "pending_count",
        F.when(whole, "SCOPE_ACCOUNTED_WITH_ITEM_RECEIPTS").otherwise("INCOMPLETE_OR_UNVERIFIED").alias("status"))


def asset_accounting(scope: DataFrame, items: DataFrame) -> DataFrame:
    """scope(asset), items(id, asset, definition, supersedes) -> active items per asset."""
    superseded = items.select(F.col("supersedes").alias("id")).filter("id IS NOT NULL").distinct()
    active = items.join(superseded, "id", "left_anti").filter("NOT definition")
    counts = active.groupBy("asset").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return scope.select("asset").distinct().join(counts, "asset", "left").select(
        "asset", n.alias("active_items"), (n > 0).alias("accounted"))


def asset_totals(accounting: DataFrame) -> DataFrame:
    return accounting.agg(
        F.count(F.lit(1)).alias("asset_count"), F.count_if("accounted").alias("accounted_assets"),
        F.count_if(~F.col("accounted")).alias("unprepared_assets"))


# --- descriptions and aspects ------------------------------------------------------------------


def plan_descriptions(
    targets: DataFrame, statements: DataFrame, prior: DataFrame, allowed: DataFrame, *,
    approved: bool = True, mode: str = "AUTO", agent_updates: bool = False,
) -> DataFrame:
    """What to do with each target's description, and who decides.

    targets(asset, field, before), statements(asset, field, text), prior(asset,
    field, status, schema_unchanged), allowed(asset, field). ``field`` is '' for the
    asset itself. Statements count as different after trimming.
    """
    key = ["asset", "field"]
    said = statements.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).filter("text <> ''").groupBy(*key).agg(
        F.count_distinct("text").alias("meanings"), F.min("text").alias("text"))
    base = targets.join(said, key, "left").join(
        prior.select(*key, F.col("status").alias("prior_status"), "schema_unchanged"), key, "left")
    base = base.join(allowed.select(*key).distinct().withColumn("permitted", F.lit(True)), key, "left")
    meanings = F.coalesce("meanings", F.lit(0))
    after = F.when(meanings == 1, F.col("text"))
    verified = (F.col("prior_status") == "VERIFIED_AGENT_BASELINE") & F.col("schema_unchanged")
    disposition = (
        F.when(meanings == 0, "INSUFFICIENT_EVIDENCE")
        .when(meanings > 1, "AMBIGUOUS_MEANING")
        .when(F.col("before").eqNullSafe(after), "KEEP")
        .when(F.col("before").isNull(), "ADD")
        .when(F.coalesce(verified, F.lit(False)), "UPDATE_AGENT")
        .otherwise("REVIEW_HUMAN_OR_CHANGED_VALUE")
    )
    rows = base.withColumns({"after": after, "disposition": disposition})
    d = F.col("disposition")
    person = (
        F.lit(mode == "REVIEW") | (d == "REVIEW_HUMAN_OR_CHANGED_VALUE")
        | ((d == "UPDATE_AGENT") & F.lit(not agent_updates))
    )
    routing = (
        F.when(F.col("prior_status") == "UNVERIFIED_AGENT_BASELINE", "BLOCKED_UNVERIFIED_ATTEMPT")
        .when(F.col("after").isNull(), "NEEDS_EVIDENCE")
        .when(d == "KEEP", "NO_WRITE")
        .when(F.lit(not approved), "READ_ONLY")
        .when(F.col("permitted").isNull(), "POLICY_DENIED")
        .when(person, "HUMAN_REVIEW")
        .otherwise("OPERATOR_POLICY")
    )
    return rows.select(*key, "before", "after", "disposition", routing.alias("routing"))


def diff_aspects(desired: DataFrame, heads: DataFrame, observed: DataFrame) -> DataFrame:
    """desired(urn, aspect, value), heads(urn, head_status), observed(urn, aspect, value) -> state per aspect.

    Values are compared by digest of their canonical JSON text.
    """
    # A parsed value keeps its keys in order, so the order in the text does not matter.
    canonical = F.sha2(F.coalesce(F.to_json(F.try_parse_json("value")), F.col("value")), 256)
    want = desired.select("urn", "aspect", canonical.alias("after"))
    have = observed.select("urn", "aspect", canonical.alias("before"))
    stored = observed.select("urn").distinct().withColumn("_stored", F.lit(True))
    joined = want.join(heads, "urn", "left").join(have, ["urn", "aspect"], "left").join(stored, "urn", "left").withColumn(
        "_stored", F.coalesce("_stored", F.lit(False)))
    state = (
        F.when(F.col("head_status").isNull(), "CATALOG_UNOBSERVED")
        .when((F.col("head_status") == 404) & F.col("_stored"), "HEAD_CONTRADICTS_ASPECTS")
        .when(F.col("head_status") == 404, "CONDITIONAL_NEW")
        .when(F.col("before").isNull(), "ASPECT_UNOBSERVED")
        .when(F.col("before") == F.col("after"), "UNCHANGED")
        .otherwise("CONFLICT")
    )
    return joined.select("urn", "aspect", state.alias("state"))


def preserves_array(old: Column, new: Column) -> Column:
    """Every old entry is still there, in place; only additions at the end."""
    return (F.size(new) >= F.size(old)) & (F.slice(new, F.lit(1), F.size(old)) == old)


def preserves_map(old: Column, new: Column) -> Column:
    """Every old key is still there with its value."""
    same = F.map_filter(old, lambda k, v: ~F.try_element_at(new, k).eqNullSafe(v) | ~F.map_contains_key(new, k))
    return F.size(same) == 0


def preserves_existing(old: DataFrame, new: DataFrame, keys: Sequence[str], stamps: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(keys…, lost, preserved) for every old document: how many of its values the new version does not keep, at any depth.

    See ``documents.lost_values`` for the rules and for ``stamps`` (``STAMPS`` are those of the catalog).
    """
    lost = documents.lost_values(old, new, keys, stamps).groupBy(*keys).agg(F.count(F.lit(1)).alias("lost"))
    rows = old.select(*keys).join(lost, list(keys), "left")
    return rows.select(*keys, F.coalesce("lost", F.lit(0).cast("long")).alias("lost"), F.col("lost").isNull().alias("preserved"))


_STATEMENT = r"^- `([A-Za-z][A-Za-z0-9_]*) = [^`]{3,}`"


def extract_metric_statements(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Lines "- `Name = expression`" of docs(dataset, path, text) matched to their dataset's fields(dataset, field), case ignored."""
    lines = docs.select("dataset", "path", F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    found = lines.select(
        "dataset", "path", (F.col("at") + 1).alias("line_number"),
        F.regexp_extract("line", _STATEMENT, 1).alias("subject"),
        F.regexp_extract("line", _STATEMENT, 0).alias("hit"),
    ).filter("subject <> ''")
    statements = found.select(
        "dataset", "path", "line_number", F.lower("subject").alias("_k"),
        F.expr("substring(hit, 4, length(hit) - 4)").alias("statement"))
    return statements.join(fields.withColumn("_k", F.lower("field")), ["dataset", "_k"]).select(
        "dataset", "field", "path", "line_number", "statement")
