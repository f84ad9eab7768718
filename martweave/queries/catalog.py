"""Catalog and governance queries over records that Spark derives from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martweave.functions import documents as D
from martweave.functions import scalars as S
from martweave.operators import catalog as C
from martweave.plans.query import page
from martweave.queries.registry import DIGEST, query, row_sql
from martweave.sources.adapter import table
from martweave.sources.readers import allowlist_tables


def _id(kind: str, column: str):
    return F.concat(F.lit(kind + ":"), F.col(column).cast("string"))


# Parts are datasets, suppliers dashboards; line items associate suppliers' nations with parts.


def entities(spark, root) -> DataFrame:
    parts = table(spark, root, "part").select(
        _id("part", "p_partkey").alias("urn"), F.lit("DATASET").alias("type"), F.col("p_name").alias("name"),
        F.concat_ws(" ", F.lit("Holds"), "p_type", "p_brand").alias("description"), F.col("p_brand").alias("platform"),
        F.when(F.col("p_size") % 2 == 0, "PROD").otherwise("TEST").alias("environment"),
        F.concat_ws("/", "p_type", "p_brand").alias("browse_path"))
    boards = table(spark, root, "supplier").select(
        _id("supplier", "s_suppkey").alias("urn"), F.lit("DASHBOARD").alias("type"), F.col("s_name").alias("name"),
        F.lit(None).cast("string").alias("description"), F.lit("charts").alias("platform"), F.lit("PROD").alias("environment"),
        F.lit("boards").alias("browse_path"))
    return parts.unionByName(boards)


def associations(spark, root) -> DataFrame:
    return table(spark, root, "lineitem").select(
        _id("part", "l_partkey").alias("asset"), F.when(F.col("l_linenumber") > 2, _id("f", "l_linenumber")).alias("field"),
        F.when(F.col("l_linestatus") == "F", "tag").otherwise("term").alias("kind"), _id("supplier", "l_suppkey").alias("value"))


def grants(spark, root) -> DataFrame:
    return table(spark, root, "part").filter("p_size <= 40").select(
        F.lit("analyst").alias("actor"), _id("part", "p_partkey").alias("urn")).unionByName(
        table(spark, root, "supplier").select(F.lit("analyst").alias("actor"), _id("supplier", "s_suppkey").alias("urn")))


_ENTITIES = """
WITH entities AS (
  SELECT 'part:' || p_partkey AS urn, 'DATASET' AS type, p_name AS name, 'Holds ' || p_type || ' ' || p_brand AS description,
         p_brand AS platform, CASE WHEN p_size % 2 = 0 THEN 'PROD' ELSE 'TEST' END AS environment,
         p_type || '/' || p_brand AS browse_path, p_size FROM part
  UNION ALL SELECT 'supplier:' || s_suppkey, 'DASHBOARD', s_name, NULL, 'charts', 'PROD', 'boards', 0 FROM supplier),
visible AS (SELECT * EXCLUDE (p_size) FROM entities WHERE p_size <= 40),
associations AS (
  SELECT 'part:' || l_partkey AS asset, CASE WHEN l_linestatus = 'F' THEN 'tag' ELSE 'term' END AS kind,
         'supplier:' || l_suppkey AS value FROM lineitem)
"""


@query(_ENTITIES + """
SELECT * FROM visible WHERE type IN ('DATASET', 'DASHBOARD') AND environment = 'PROD'
  AND (lower(name) LIKE '%ring%' OR coalesce(lower(description) LIKE '%ring%', false))""")
def search_catalog(spark, root):
    return C.search_catalog(
        entities(spark, root), associations(spark, root), grants(spark, root), "analyst", "RING",
        ["DATASET", "DASHBOARD"], {"environment": "PROD"})


@query(_ENTITIES + """
SELECT * FROM visible WHERE browse_path = 'LARGE/Brand#7'
UNION ALL SELECT * FROM visible WHERE platform = 'Brand#3'
  AND urn IN (SELECT asset FROM associations WHERE kind = 'tag' AND value = 'supplier:5')""")
def search_related(spark, root):
    """By browse path, and by platform plus association."""
    args = entities(spark, root), associations(spark, root), grants(spark, root), "analyst"
    return C.search_catalog(*args, browse_path=["LARGE", "Brand#7"]).unionByName(
        C.search_catalog(*args, filters={"platform": "Brand#3"}, related_to=("tag", "supplier:5")))


def catalog_fields(spark, root) -> DataFrame:
    """A field per distinct (part, supplier)."""
    kind = F.col("l_suppkey") % 4
    return table(spark, root, "lineitem").select("l_partkey", "l_suppkey").distinct().select(
        _id("part", "l_partkey").alias("dataset"), F.concat(F.lit("Supp_"), F.col("l_suppkey").cast("string")).alias("path"),
        F.when(kind == 0, "decimal(19,4)").when(kind == 1, "DateTime2").when(kind == 2, "bit").otherwise("nvarchar(50)")
        .alias("native_type"),
        F.when(kind == 0, "NUMBER").otherwise("OTHER").alias("type"),
        F.when(F.col("l_suppkey") % 3 == 0, _id("source", "l_suppkey")).alias("description"))


_FIELDS = """
WITH fields AS (
  SELECT 'part:' || l_partkey AS dataset, 'Supp_' || l_suppkey AS path,
         CASE l_suppkey % 4 WHEN 0 THEN 'decimal(19,4)' WHEN 1 THEN 'DateTime2' WHEN 2 THEN 'bit' ELSE 'nvarchar(50)' END AS native_type,
         CASE WHEN l_suppkey % 4 = 0 THEN 'NUMBER' ELSE 'OTHER' END AS type,
         CASE WHEN l_suppkey % 3 = 0 THEN 'source:' || l_suppkey END AS description, l_partkey, l_suppkey
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem))"""


@query(_FIELDS + """
, hit AS (SELECT * FROM fields WHERE lower(path) LIKE '%supp_7%' OR lower(native_type) LIKE '%supp_7%' OR lower(type) LIKE '%supp_7%')
SELECT dataset, path, native_type, (SELECT count(*) FROM hit) AS total,
       (SELECT count(*) > 50 FROM hit WHERE (native_type, path, dataset) > ('bit', 'Supp_7', 'part:2')) AS more
FROM hit WHERE (native_type, path, dataset) > ('bit', 'Supp_7', 'part:2') ORDER BY native_type, path, dataset LIMIT 50""")
def list_fields(spark, root):
    """A page of the fields that match a text, by type then path."""
    rows, order = C.list_fields(catalog_fields(spark, root), text="supp_7", sort="type")
    after = {"native_type": "bit", "path": "Supp_7", "dataset": "part:2"}
    return page(rows.select("dataset", "path", "native_type"), order, 50, after)


@query(_FIELDS + """
SELECT dataset, path, CASE native_type WHEN 'decimal(19,4)' THEN 'number' WHEN 'DateTime2' THEN 'time' WHEN 'bit' THEN 'boolean'
       ELSE 'string' END AS kind FROM fields""")
def column_kind(spark, root):
    return catalog_fields(spark, root).select("dataset", "path", S.column_kind(F.col("native_type")).alias("kind"))


@query(_FIELDS + """
SELECT dataset, path, native_type FROM fields WHERE lower(native_type) LIKE '%time%' OR lower(type) LIKE '%time%'""")
def contains_ci(spark, root):
    return catalog_fields(spark, root).filter(
        S.contains_ci("TIME", F.col("native_type"), F.col("type"))).select("dataset", "path", "native_type")


@query(_FIELDS + """
SELECT dataset, path, description AS source_description,
       CASE WHEN l_partkey % 5 = 0 THEN 'edited' END AS edited_description,
       CASE WHEN l_partkey % 5 = 0 THEN 'edited' ELSE description END AS description FROM fields""")
def effective_description(spark, root):
    fields = catalog_fields(spark, root)
    edited = fields.filter(F.substring_index("dataset", ":", -1).cast("long") % 5 == 0)
    return C.effective_description(fields, edited.withColumn("description", F.lit("edited")))


@query("""
WITH places AS (
  SELECT 'part:' || l_partkey AS dataset, 'f:' || l_linenumber AS path, CASE WHEN l_linestatus = 'F' THEN 'Tag' ELSE 'Term' END AS kind,
         'u:' || l_suppkey AS urn, CASE l_returnflag WHEN 'A' THEN 'SCHEMA_METADATA' WHEN 'N' THEN 'EDITABLE_SCHEMA'
         ELSE 'SCHEMA_FIELD_ENTITY' END AS source FROM lineitem)
SELECT dataset, path, kind, urn, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM places GROUP BY ALL""")
def collect_references(spark, root):
    rows = table(spark, root, "lineitem").select(
        _id("part", "l_partkey").alias("dataset"), _id("f", "l_linenumber").alias("path"),
        F.when(F.col("l_linestatus") == "F", "Tag").otherwise("Term").alias("kind"), _id("u", "l_suppkey").alias("urn"), "l_returnflag")
    return C.collect_references({
        "SCHEMA_METADATA": rows.filter("l_returnflag = 'A'"), "EDITABLE_SCHEMA": rows.filter("l_returnflag = 'N'"),
        "SCHEMA_FIELD_ENTITY": rows.filter("l_returnflag = 'R'")})


@query("""
WITH t AS (
  SELECT 'term:' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS urn, CASE WHEN p_size % 3 = 0 THEN 'tag' ELSE 'term' END AS kind,
         p_name || ' ' || lower(p_type) AS normalized, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS place FROM part),
g AS (SELECT kind, normalized, place, count(*) AS here, min(urn) AS first_urn FROM t GROUP BY ALL),
e AS (SELECT kind, normalized, sum(here) AS total FROM g GROUP BY ALL HAVING sum(here) > 1)
SELECT urn, t.kind, t.normalized, here - 1 AS duplicates, CAST(total - here AS BIGINT) AS same_name_other_hierarchy,
       first_urn AS group_urn
FROM t JOIN g USING (kind, normalized, place) JOIN e ON e.kind = t.kind AND e.normalized = t.normalized""")
def find_duplicate_terms(spark, root):
    """Terms named after parts, with stray case and spaces; brands are the parents."""
    return C.find_duplicate_terms(table(spark, root, "part").select(
        F.concat(F.lit("term:"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("urn"),
        F.when(F.col("p_size") % 3 == 0, "tag").otherwise("term").alias("kind"),
        F.concat(F.lit("  "), F.initcap("p_name"), F.lit("   "), "p_type", F.lit(" ")).alias("name"), F.col("p_brand").alias("parent")))


@query("SELECT p_partkey, lower(p_name || ' ' || p_type) AS normalized FROM part")
def normalize_name(spark, root):
    name = F.concat(F.lit("\t"), F.upper("p_name"), F.lit(" \n "), "p_type", F.lit(" "))
    return table(spark, root, "part").select("p_partkey", S.normalize_name(name).alias("normalized"))


@query("""
WITH c AS (
  SELECT l_orderkey AS asset, l_linenumber AS field,
         CASE WHEN l_returnflag = 'A' THEN 'tag' WHEN l_returnflag = 'N' THEN 'description' ELSE 'property' END AS kind,
         CASE WHEN l_tax = 0 THEN 'set' WHEN l_tax < 0.05 THEN 'add' ELSE 'remove' END AS op, l_suppkey % 5 AS value FROM lineitem),
g AS (SELECT asset, field, kind, CASE WHEN kind = 'property' THEN CAST(value AS VARCHAR) END AS member, count(*) AS n,
             count(*) FILTER (op = 'set') AS sets, count(DISTINCT value) AS vals FROM c GROUP BY 1, 2, 3, 4)
SELECT asset, field, kind, member, CASE WHEN kind <> 'tag' THEN 'two_values_for_scalar' WHEN sets > 0 THEN 'competing_set'
       ELSE 'repeated_member' END AS reason FROM g WHERE n > 1 AND (kind <> 'tag' OR sets > 0 OR vals < n)""")
def candidate_conflicts(spark, root):
    tax = F.col("l_tax")
    return C.candidate_conflicts(table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("asset"), F.col("l_linenumber").alias("field"),
        F.when(F.col("l_returnflag") == "A", "tag").when(F.col("l_returnflag") == "N", "description").otherwise("property").alias("kind"),
        F.when(tax == 0, "set").when(tax < 0.05, "add").otherwise("remove").alias("operation"),
        (F.col("l_suppkey") % 5).cast("string").alias("value")))


@query("""
WITH cur AS (SELECT l_suppkey AS asset, 'tag' AS kind, l_partkey AS value, min(l_orderkey) AS position FROM lineitem
             WHERE l_linestatus = 'F' GROUP BY 1, 2, 3),
o AS (SELECT l_suppkey AS asset, 'tag' AS kind, l_partkey AS value, min(l_orderkey) AS seq,
             CASE WHEN l_suppkey % 3 = 0 THEN 'set' WHEN l_partkey % 2 = 0 THEN 'add' ELSE 'remove' END AS op
      FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'A' GROUP BY 1, 2, 3, 5),
m AS (SELECT asset, kind, value, c.position, o.seq, o.op FROM cur c FULL JOIN o USING (asset, kind, value)),
k AS (SELECT *, position IS NULL AS is_new, coalesce(position, seq) AS spot FROM m
      WHERE CASE WHEN asset % 3 = 0 AND asset IN (SELECT asset FROM o) THEN op = 'set'
                 ELSE coalesce(op = 'add', false) OR (position IS NOT NULL AND coalesce(op, '') <> 'remove') END)
SELECT asset, kind, value, row_number() OVER (PARTITION BY asset, kind ORDER BY is_new, spot, value) - 1 AS position FROM k""")
def apply_associations(spark, root):
    """Suppliers' ordered part tags; every third supplier gets a new set, others add and remove."""
    li = table(spark, root, "lineitem")
    current = li.filter("l_linestatus = 'F'").groupBy(F.col("l_suppkey").alias("asset"), F.col("l_partkey").alias("value")).agg(
        F.min("l_orderkey").alias("position"))
    op = F.when(F.col("l_suppkey") % 3 == 0, "set").when(F.col("l_partkey") % 2 == 0, "add").otherwise("remove")
    changes = li.filter("l_linestatus = 'O' AND l_returnflag = 'A'").groupBy(
        F.col("l_suppkey").alias("asset"), F.col("l_partkey").alias("value"), op.alias("operation")).agg(F.min("l_orderkey").alias("seq"))
    kind = F.lit("tag").alias("kind")
    return C.apply_associations(current.select("*", kind), changes.select("*", kind))


@query(f"""
SELECT l_orderkey AS asset, l_partkey AS domain, l_returnflag = 'R' AS propagated,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R', l_linenumber, l_partkey, l_suppkey) - 1 AS position
FROM lineitem""")
def order_domains(spark, root):
    position = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    return C.order_domains(table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("asset"), F.col("l_partkey").alias("domain"), position.alias("position"),
        (F.col("l_returnflag") == "R").alias("propagated")))


def _impact(spark, root):
    relationships = table(spark, root, "lineitem").select(
        F.col("l_suppkey").alias("definition"), _id("part", "l_partkey").alias("entity"),
        F.when(F.col("l_returnflag") == "A", "TermedWith").when(F.col("l_returnflag") == "N", "IsA").otherwise("TaggedWith")
        .alias("relationship"))
    scope = table(spark, root, "part").filter("p_type <> 'PROMO'").select(_id("part", "p_partkey").alias("urn"))
    return C.definition_impact(relationships, "term", scope, grants(spark, root), "analyst")


_IMPACT = """
WITH r AS (SELECT l_suppkey AS definition, 'part:' || l_partkey AS entity,
                  CASE WHEN l_returnflag = 'A' THEN 'TermedWith' ELSE 'IsA' END AS relationship,
                  p_type <> 'PROMO' AND p_size <= 40 AS ok
           FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'R')"""


@query(_IMPACT + " SELECT definition, entity, relationship FROM r WHERE ok")
def definition_impact(spark, root):
    return _impact(spark, root)[0]


@query(_IMPACT + """
SELECT definition, count(*) AS observed, count(*) FILTER (ok) AS listed, count(*) <> count(*) FILTER (ok) AS omitted
FROM r GROUP BY 1""")
def definition_impact_counts(spark, root):
    return _impact(spark, root)[1]


# --- scope and accounting ------------------------------------------------------------------


def _scope(spark, root):
    part = table(spark, root, "part")
    members = part.filter("p_type <> 'PROMO'").select(_id("part", "p_partkey").alias("urn"))
    datasets = part.filter("p_size <> 13").select(
        _id("part", "p_partkey").alias("urn"), (F.col("p_size") == 17).alias("removed"),
        F.when(F.col("p_size") == 19, "old").when(F.col("p_size") != 21, "run").alias("run_id"), F.col("p_brand").alias("schema_version"))
    fields = table(spark, root, "lineitem").select(
        _id("part", "l_partkey").alias("urn"), F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("path"))
    return members, datasets, fields


_SCOPE = """
WITH f AS (SELECT p_partkey, 'part:' || l_partkey AS urn, 'f' || l_suppkey AS path, count(*) AS n FROM lineitem
           JOIN part ON p_partkey = l_partkey WHERE p_type <> 'PROMO' GROUP BY ALL)"""


@query(_SCOPE + """
SELECT 'member_missing' AS rule, 'part:' || p_partkey AS "key", 'schema' AS detail FROM part WHERE p_type <> 'PROMO' AND p_size = 13
UNION ALL SELECT 'member_removed', 'part:' || p_partkey, 'removed' FROM part WHERE p_type <> 'PROMO' AND p_size = 17
UNION ALL SELECT 'not_latest_run', 'part:' || p_partkey, CASE WHEN p_size = 19 THEN 'old' ELSE 'null' END FROM part WHERE p_type <> 'PROMO' AND p_size IN (19, 21)
UNION ALL SELECT 'duplicate_field', urn || '/' || path, CAST(n AS VARCHAR) FROM f WHERE n > 1""")
def scope_violations(spark, root):
    return C.scope_violations(*_scope(spark, root), "run")


@query(f"""
WITH rows AS (
  SELECT 'part:' || p_partkey AS urn, p_brand AS v, NULL AS path FROM part WHERE p_type <> 'PROMO' AND p_size <> 13
  UNION ALL SELECT 'part:' || l_partkey, p_brand, 'f' || l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
  JOIN part ON p_partkey = l_partkey WHERE p_type <> 'PROMO' AND p_size <> 13),
hashed AS (SELECT path, {row_sql('urn', 'v', 'path')} AS h FROM rows)
SELECT count(*) FILTER (path IS NULL) AS dataset_count, count(path) AS field_count, {DIGEST} AS fingerprint FROM hashed""")
def scope_fingerprint(spark, root):
    members, datasets, fields = _scope(spark, root)
    return C.scope_fingerprint(members, datasets, fields.distinct())


def _accounting(spark, root):
    fields = table(spark, root, "lineitem").select(
        _id("part", "l_partkey").alias("asset"), _id("f", "l_suppkey").alias("field"), "l_returnflag")
    done = fields.filter("l_returnflag = 'A'").select("asset", "field").unionByName(
        table(spark, root, "part").filter("p_size < 25").select(_id("part", "p_partkey").alias("asset"), F.lit(None).cast("string").alias("field")))
    return fields.drop("l_returnflag"), done


_TARGETS = """
WITH t AS (SELECT DISTINCT 'part:' || l_partkey AS asset, NULL AS field FROM lineitem
           UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'f:' || l_suppkey FROM lineitem),
d AS (SELECT DISTINCT 'part:' || l_partkey AS asset, 'f:' || l_suppkey AS field FROM lineitem WHERE l_returnflag = 'A'
      UNION ALL SELECT 'part:' || p_partkey, NULL FROM part WHERE p_size < 25),
missing AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.asset = t.asset AND d.field IS NOT DISTINCT FROM t.field))"""


@query(_TARGETS + " SELECT * FROM missing")
def missing_targets(spark, root):
    return C.missing_targets(*_accounting(spark, root))


@query(_TARGETS + """
SELECT (SELECT count(*) FROM t) AS target_count, (SELECT count(*) FROM t) - (SELECT count(*) FROM missing) AS accounted_count,
       (SELECT count(*) FROM missing) AS missing_count, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS pending_count,
       'INCOMPLETE_OR_UNVERIFIED' AS status""")
def scope_accounting(spark, root):
    fields, done = _accounting(spark, root)
    return C.scope_accounting(fields, done, table(spark, root, "orders").filter("o_orderstatus = 'O'"))


def _items(spark, root):
    scope = table(spark, root, "customer").select(F.col("c_custkey").alias("asset"))
    key = F.col("o_orderkey")
    items = table(spark, root, "orders").select(
        key.alias("id"), F.col("o_custkey").alias("asset"), (F.col("o_orderpriority") == "5-LOW").alias("definition"),
        F.when(F.col("o_orderstatus") == "O", key + 1).alias("supersedes"))
    return scope, items


_ACTIVE = """
WITH gone AS (SELECT o_orderkey + 1 AS id FROM orders WHERE o_orderstatus = 'O'),
a AS (SELECT c_custkey AS asset, count(o_orderkey) AS active_items FROM customer LEFT JOIN (
        SELECT * FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderkey NOT IN (SELECT id FROM gone)) ON o_custkey = c_custkey
      GROUP BY 1)"""


@query(_ACTIVE + " SELECT asset, active_items, active_items > 0 AS accounted FROM a")
def asset_accounting(spark, root):
    return C.asset_accounting(*_items(spark, root))


@query(_ACTIVE + """
SELECT count(*) AS asset_count, count(*) FILTER (active_items > 0) AS accounted_assets,
       count(*) FILTER (active_items = 0) AS unprepared_assets FROM a""")
def asset_totals(spark, root):
    return C.asset_totals(C.asset_accounting(*_items(spark, root)))


# --- descriptions and aspects ----------------------------------------------------------------


@query("""
WITH t AS (SELECT l_partkey, CASE WHEN l_quantity > 49 THEN l_returnflag ELSE chr(CAST(65 + l_partkey % 3 AS INTEGER)) END AS t FROM lineitem),
s AS (SELECT l_partkey, count(DISTINCT t) AS n, min(t) AS t FROM t GROUP BY 1),
b AS (
  SELECT p_partkey AS asset, '' AS field, CASE WHEN p_size % 4 = 0 THEN 'A' WHEN p_size % 4 = 1 THEN 'old' END AS before,
         CASE WHEN n = 1 THEN t END AS after, coalesce(n, 0) AS n,
         CASE WHEN p_size % 5 = 0 THEN 'VERIFIED_AGENT_BASELINE' WHEN p_size % 5 = 1 THEN 'UNVERIFIED_AGENT_BASELINE' END AS prior,
         p_size % 10 < 5 AS unchanged, p_type <> 'SMALL' AS permitted
  FROM part LEFT JOIN s ON l_partkey = p_partkey),
d AS (SELECT *, CASE WHEN n = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN n > 1 THEN 'AMBIGUOUS_MEANING' WHEN before = after THEN 'KEEP'
                WHEN before IS NULL THEN 'ADD' WHEN prior = 'VERIFIED_AGENT_BASELINE' AND unchanged THEN 'UPDATE_AGENT'
                ELSE 'REVIEW_HUMAN_OR_CHANGED_VALUE' END AS disposition FROM b)
SELECT asset, field, before, after, disposition,
       CASE WHEN prior = 'UNVERIFIED_AGENT_BASELINE' THEN 'BLOCKED_UNVERIFIED_ATTEMPT' WHEN after IS NULL THEN 'NEEDS_EVIDENCE'
            WHEN disposition = 'KEEP' THEN 'NO_WRITE' WHEN NOT permitted THEN 'POLICY_DENIED'
            WHEN disposition IN ('REVIEW_HUMAN_OR_CHANGED_VALUE', 'UPDATE_AGENT') THEN 'HUMAN_REVIEW' ELSE 'OPERATOR_POLICY' END AS routing
FROM d""")
def plan_descriptions(spark, root):
    """Statements about parts come from line items, trimmed before they are compared; large ones may differ from the rest."""
    part, size = table(spark, root, "part"), F.col("p_size")
    key = [F.col("p_partkey").alias("asset"), F.lit("").alias("field")]
    targets = part.select(*key, F.when(size % 4 == 0, "A").when(size % 4 == 1, "old").alias("before"))
    statements = table(spark, root, "lineitem").select(
        F.col("l_partkey").alias("asset"), F.lit("").alias("field"),
        F.concat(F.when(F.col("l_quantity") > 49, F.col("l_returnflag")).otherwise(F.char(65 + F.col("l_partkey") % 3)), F.when(F.col("l_linenumber") > 3, "  ").otherwise("")).alias("text"))
    prior = part.filter("p_size % 5 < 2").select(
        *key, F.when(size % 5 == 0, "VERIFIED_AGENT_BASELINE").otherwise("UNVERIFIED_AGENT_BASELINE").alias("status"),
        (size % 10 < 5).alias("schema_unchanged"))
    return C.plan_descriptions(targets, statements, prior, part.filter("p_type <> 'SMALL'").select(*key))


@query("""
SELECT o_orderkey AS urn, 'status' AS aspect, CASE WHEN o_orderpriority = '1-URGENT' THEN 'CATALOG_UNOBSERVED'
       WHEN o_orderpriority = '2-HIGH' THEN CASE WHEN o_orderstatus = 'P' OR o_orderkey % 2 = 1 THEN 'CONDITIONAL_NEW' ELSE 'HEAD_CONTRADICTS_ASPECTS' END
       WHEN o_orderstatus = 'P' THEN 'ASPECT_UNOBSERVED'
       WHEN o_orderstatus = 'F' THEN 'UNCHANGED' ELSE 'CONFLICT' END AS state FROM orders""")
def diff_aspects(spark, root):
    o = table(spark, root, "orders")
    urn, status = F.col("o_orderkey").alias("urn"), F.lit("status").alias("aspect")
    desired = o.select(urn, status, S.sorted_json({"customer": F.col("o_custkey"), "removed": F.lit(False)}).alias("value"))
    heads = o.filter("o_orderpriority <> '1-URGENT'").select(
        urn, F.when(F.col("o_orderpriority") == "2-HIGH", 404).otherwise(204).alias("head_status"))
    # Stored with its keys in the other order and with blanks.
    text = F.format_string('{ "removed": %s, "customer": %d }', (F.col("o_orderstatus") == "O").cast("string"), F.col("o_custkey"))
    observed = o.filter("o_orderstatus <> 'P' AND (o_orderpriority > '3' OR o_orderpriority = '2-HIGH' AND o_orderkey % 2 = 0)").select(
        urn, status, text.alias("value"))
    return C.diff_aspects(desired, heads, observed)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag <> 'R' AND l_linestatus = 'F' AS array_kept,
       l_returnflag <> 'A' AND l_tax > 0 AS map_kept FROM lineitem""")
def preserves_existing(spark, root):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    new = F.when(status != "F", F.array(p)).when(flag == "R", F.array(s + 1000000, p, s)).otherwise(F.array(p, s, F.lit(1).cast("long")))
    tax = F.col("l_tax").cast("string")
    new_map = F.when(flag == "A", F.create_map(F.lit("t"), tax)).otherwise(F.create_map(
        F.lit("f"), flag, F.lit("t"), F.when(F.col("l_tax") > 0, tax).otherwise("none"), F.lit("n"), status))
    return table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        C.preserves_array(F.array(p, s), new).alias("array_kept"),
        C.preserves_map(F.create_map(F.lit("f"), flag, F.lit("t"), tax), new_map).alias("map_kept"))


# An order as a nested document; the new version gains members, gains or loses elements, or changes values by its key.
@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 9 AS c FROM orders)
SELECT k, '/tags/0/n' AS pointer, 'value_changed' AS finding FROM o WHERE c = 2
UNION ALL SELECT k, p, 'value_missing' FROM o, (SELECT unnest(['/tags/1', '/tags/1/n']) AS p) WHERE c = 3
UNION ALL SELECT k, '/owner/a~1b', 'value_missing' FROM o WHERE c = 4
UNION ALL SELECT k, '/owner', 'kind_changed' FROM o WHERE c = 5
UNION ALL SELECT k, p, 'value_missing' FROM o, (SELECT unnest(['/owner/id', '/owner/a~1b', '/owner/lastModified']) AS p) WHERE c = 5
UNION ALL SELECT k, '/lastModified/time', 'value_changed' FROM o WHERE c = 7
UNION ALL SELECT k, '/owner/lastModified', 'value_changed' FROM o WHERE c = 8""")
def preserves_nested(spark, root):
    """Values of nested documents that a new version does not keep."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
    case = key % 9

    def tag(n: Column, more: bool = False) -> Column:
        members = [n.alias("n"), *([F.lit(True).alias("new")] if more else [])]
        return F.to_json(F.struct(*members))

    def document(tags: Column, owner: Column, time: Column) -> Column:
        return F.concat(F.lit('{"tags": ['), tags, F.lit('], "owner": '), owner, F.lit(', "status": null, "lastModified": {"time": '), time, F.lit("}}"))

    def owner(at: Column) -> Column:
        return F.concat(F.lit('{"id": "'), price, F.lit('", "a/b": 1.50, "lastModified": '), at, F.lit("}"))

    first, second = tag(key), tag(key + 1)
    old = document(F.concat_ws(", ", first, second), owner(F.lit("1")), F.lit("1"))
    tags = (F.when(case == 1, F.concat_ws(", ", tag(key, more=True), second, F.lit('"more"'))).when(case == 2, F.concat_ws(", ", second, second))
            .when(case == 3, first).otherwise(F.concat_ws(", ", first, second)))
    held = (F.when(case == 4, F.concat(F.lit('{"id": "'), price, F.lit('", "lastModified": 1}'))).when(case == 5, F.lit("[1]"))
            .when(case == 8, owner(F.lit("5"))).otherwise(owner(F.lit("1.0"))))
    time = F.when(case == 6, "5").when(case == 7, "6").otherwise("1")
    orders = table(spark, root, "orders")
    before = orders.select(key.alias("k"), old.alias("text"), F.lit("ownership").alias("aspect"), F.lit('{"time": 5}').alias("stamp"))
    return D.lost_values(before, orders.select(key.alias("k"), document(tags, held, time).alias("text")), ["k"], C.STAMPS)


@query("""
SELECT 'd' || l.lang AS dataset, upper(l.source) AS field, doc_id AS path,
       2 + length(text) - length(replace(text, chr(10), '')) AS line_number, d.source || ' = count of ' || d.lang AS statement
FROM documents d JOIN (SELECT DISTINCT lang, source FROM documents WHERE lang <> 'fr') l USING (lang, source)""")
def extract_metric_statements(spark, root):
    """Whole documents with one metric line appended, matched to the fields of their language."""
    docs = table(spark, root, "documents")
    line = F.concat(F.lit("\n- `"), "source", F.lit(" = count of "), "lang", F.lit("` and more"))
    fields = docs.filter("lang <> 'fr'").select(
        F.concat(F.lit("d"), "lang").alias("dataset"), F.upper("source").alias("field")).distinct()
    return C.extract_metric_statements(docs.select(
        F.concat(F.lit("d"), "lang").alias("dataset"), F.col("doc_id").alias("path"), F.concat("text", line).alias("text")), fields)


@query("""
SELECT DISTINCT 'mart.dm.' || replace(p_name, ' ', '_') AS name, p_type AS kind FROM part
WHERE p_name IN ('red widget', 'blue bolt', 'small ring') OR p_name LIKE 'green %'""")
def allowlist_tables(spark, root, _rows=allowlist_tables):
    names = table(spark, root, "part").select(
        F.concat(F.lit("mart.dm."), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"), F.col("p_type").alias("kind"))
    return _rows(names, "name", [r"^mart\.dm\.(red_widget|blue_bolt|small_ring)$", r"^mart\.dm\.green_[a-z]+$"])
