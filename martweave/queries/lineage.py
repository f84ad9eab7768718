"""Lineage and binding queries over graphs that Spark derives from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martweave.functions import scalars as S
from martweave.operators import lineage as L
from martweave.queries.registry import DIGEST, query, row_sql
from martweave.sources.adapter import table

# --- graph contract: parts are assets, suppliers operations, both have a port ----------------


def graph_nodes(spark, root) -> DataFrame:
    part, supplier = table(spark, root, "part"), table(spark, root, "supplier")
    nid = lambda kind, local: L.node_id("sf", F.lit(kind), local)
    asset = F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))
    step = F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string"))
    field = "array<struct<path:string,native_type:string>>"

    def fields(n):
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
            F.concat(F.lit("f"), i.cast("string")).alias("path"), F.lit("int").alias("native_type")))

    none = F.lit(None).cast("string")
    first = F.array(F.struct(F.lit("f1").alias("path"), F.lit("int").alias("native_type")))
    assets = part.select(F.explode(F.sequence(F.lit(1), F.when(F.col("p_size") == 50, 2).otherwise(1))), "*").select(
        nid("asset", asset).alias("id"), F.lit("asset").alias("kind"), asset.alias("local_id"),
        none.alias("owner"), F.lit(None).cast(field).alias("fields"))
    steps = supplier.select(
        nid("operation", F.when(F.col("s_acctbal") < 0, F.concat(step, F.lit("x"))).otherwise(step)).alias("id"),
        F.lit("operation").alias("kind"), step.alias("local_id"), none.alias("owner"),
        F.lit(None).cast(field).alias("fields"))
    out = F.concat(asset, F.lit(":out"))
    outputs = part.select(
        nid("port", out).alias("id"), F.lit("port").alias("kind"), out.alias("local_id"),
        F.when(F.col("p_size") == 1, "node_missing").otherwise(nid("asset", asset)).alias("owner"),
        F.when(F.col("p_size") == 7, F.concat(fields(F.col("p_size") % 4 + 1), first))
        .otherwise(fields(F.col("p_size") % 4 + 1)).cast(field).alias("fields"))
    into = F.concat(step, F.lit(":in"))
    inputs = supplier.select(
        nid("port", into).alias("id"), F.lit("port").alias("kind"), into.alias("local_id"),
        nid("operation", step).alias("owner"), fields(F.lit(3)).cast(field).alias("fields"))
    return assets.unionByName(steps).unionByName(outputs).unionByName(inputs)


def graph_edges(spark, root) -> DataFrame:
    nid = lambda kind, local: L.node_id("sf", F.lit(kind), local)
    asset = F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))
    step = F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string"))
    out, into = nid("port", F.concat(asset, F.lit(":out"))), nid("port", F.concat(step, F.lit(":in")))
    flag, quantity = F.col("l_returnflag"), F.col("l_quantity").cast("int")
    kind = F.when(flag == "A", "reads").when(flag == "N", "value_dependency").otherwise("condition_dependency")

    def end(node, name):
        return F.struct(node.alias("node"), name.alias("field")).cast("struct<node:string,field:string>")

    none = F.lit(None).cast("string")
    plain_asset = end(nid("asset", asset), none)
    sources = (
        F.when(flag == "A", F.array(end(nid("asset", asset), F.when(F.col("l_linenumber") == 7, "f1"))))
        .when(flag == "N", F.array(end(out, F.concat(F.lit("f"), (F.col("l_linenumber") % 5 + 1).cast("string")))))
        .when(quantity > 40, F.array(end(out, F.lit("f1")), plain_asset))
        .otherwise(F.array(end(out, F.lit("f1"))))
    )
    target_node = F.when(quantity == 50, "node_missing").when(flag == "A", nid("operation", step)).otherwise(into)
    target_field = F.when(flag == "N", F.concat(F.lit("f"), (quantity % 4 + 1).cast("string")))
    return table(spark, root, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("edge_id"),
        kind.alias("kind"), sources.alias("sources"), end(target_node, target_field).alias("target"))


_NID = "'node_' || sha256('[\"sf\",\"' || {0} || '\",\"' || {1} || '\"]')"


def _nid(kind: str, local: str) -> str:
    return _NID.format(f"'{kind}'", local)


GRAPH_SQL = f"""
WITH nodes AS (
  SELECT {_nid('asset', "'part:' || p_partkey")} AS id, 'asset' AS kind, 'part:' || p_partkey AS local_id,
         CAST(NULL AS VARCHAR) AS owner, 0 AS n, p_size
  FROM part, LATERAL (SELECT unnest(CASE WHEN p_size = 50 THEN [1, 2] ELSE [1] END))
  UNION ALL SELECT {_nid('operation', "'supplier:' || s_suppkey || CASE WHEN s_acctbal < 0 THEN 'x' ELSE '' END")},
         'operation', 'supplier:' || s_suppkey, NULL, 0, 0 FROM supplier
  UNION ALL SELECT {_nid('port', "'part:' || p_partkey || ':out'")}, 'port', 'part:' || p_partkey || ':out',
         CASE WHEN p_size = 1 THEN 'node_missing' ELSE {_nid('asset', "'part:' || p_partkey")} END, p_size % 4 + 1, p_size
  FROM part
  UNION ALL SELECT {_nid('port', "'supplier:' || s_suppkey || ':in'")}, 'port', 'supplier:' || s_suppkey || ':in',
         {_nid('operation', "'supplier:' || s_suppkey")}, 3, 0 FROM supplier),
kinds AS (SELECT id AS node, max(kind) AS node_kind FROM nodes GROUP BY id),
port_fields AS (SELECT id AS node, 'f' || unnest(range(1, n + 1)) AS field FROM nodes WHERE kind = 'port'),
li AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS edge_id,
         CASE l_returnflag WHEN 'A' THEN 'reads' WHEN 'N' THEN 'value_dependency' ELSE 'condition_dependency' END AS kind,
         l_returnflag AS flag, CAST(l_quantity AS INTEGER) AS q, l_linenumber AS ln,
         'part:' || l_partkey AS a, 'supplier:' || l_suppkey AS s FROM lineitem),
ends AS (
  SELECT edge_id, kind, 'source' AS role, {_nid('asset', 'a')} AS node, CASE WHEN ln = 7 THEN 'f1' END AS field
  FROM li WHERE flag = 'A'
  UNION ALL SELECT edge_id, kind, 'source', {_nid('port', "a || ':out'")}, 'f' || (ln % 5 + 1) FROM li WHERE flag = 'N'
  UNION ALL SELECT edge_id, kind, 'source', {_nid('port', "a || ':out'")}, 'f1' FROM li WHERE flag = 'R'
  UNION ALL SELECT edge_id, kind, 'source', {_nid('asset', 'a')}, NULL FROM li WHERE flag = 'R' AND q > 40
  UNION ALL SELECT edge_id, kind, 'target', CASE WHEN q = 50 THEN 'node_missing'
         WHEN flag = 'A' THEN {_nid('operation', 's')} ELSE {_nid('port', "s || ':in'")} END,
         CASE WHEN flag = 'N' THEN 'f' || (q % 4 + 1) END FROM li),
known AS (SELECT e.*, k.node_kind FROM ends e LEFT JOIN kinds k USING (node))"""


@query(GRAPH_SQL + f"""
SELECT 'duplicate_node' AS rule, id AS "key", CAST(count(*) AS VARCHAR) AS detail FROM nodes GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'identity_mismatch', id, local_id FROM nodes WHERE id <> {_NID.format('kind', 'local_id')}
UNION ALL SELECT 'port_owner_invalid', id, owner FROM nodes WHERE kind = 'port'
  AND owner NOT IN (SELECT node FROM kinds WHERE node_kind IN ('asset', 'operation'))
UNION ALL SELECT 'duplicate_field', id || '/f1', '2' FROM nodes WHERE kind = 'port' AND p_size = 7
UNION ALL SELECT 'dangling_edge', edge_id || '/' || role, node FROM known WHERE node_kind IS NULL
UNION ALL SELECT 'unknown_field', edge_id || '/' || role, field FROM known k WHERE field IS NOT NULL
  AND node_kind IS NOT NULL AND NOT EXISTS (SELECT 1 FROM port_fields p WHERE p.node = k.node AND p.field = k.field)
UNION ALL SELECT 'value_edge_requires_ports', edge_id || '/' || role, node_kind FROM known
  WHERE kind <> 'reads' AND node_kind <> 'port'
UNION ALL SELECT 'structural_edge_invalid', edge_id, kind FROM li WHERE flag = 'A' AND ln = 7""")
def validate_graph(spark, root):
    return L.validate_graph(graph_nodes(spark, root), graph_edges(spark, root), "sf")


@query("""
SELECT 'file_not_covered' AS rule, CAST(doc_id AS VARCHAR) AS "key", '0' AS detail FROM documents WHERE source = 'src3'
UNION ALL SELECT 'file_covered_twice', CAST(doc_id AS VARCHAR), '2' FROM documents WHERE source = 'src4'
UNION ALL SELECT 'covered_file_unknown', 'x' || doc_id, '1' FROM documents WHERE source = 'src5'
UNION ALL SELECT 'unsupported_without_finding', CAST(doc_id AS VARCHAR), 'unsupported' FROM documents
  WHERE lang = 'de' AND source NOT IN ('src3', 'src6')""")
def validate_coverage(spark, root):
    docs = table(spark, root, "documents").select(F.col("doc_id").cast("string").alias("path"), "lang", "source")
    state = F.when(F.col("lang") == "de", "unsupported").otherwise("analyzed").alias("state")
    coverage = docs.filter("source <> 'src3'").select("path", state).unionByName(
        docs.filter("source = 'src4'").select("path", state)).unionByName(
        docs.filter("source = 'src5'").select(F.concat(F.lit("x"), "path").alias("path"), F.lit("analyzed").alias("state")))
    findings = docs.filter("source = 'src6'").select("path", F.lit("language_unsupported").alias("code"))
    return L.validate_coverage(docs, coverage, findings)


@query("""
SELECT (SELECT count(*) FROM documents WHERE lang <> 'de') AS analyzed,
       (SELECT count(*) FROM documents WHERE lang = 'de') AS unsupported,
       (SELECT count(*) FROM documents WHERE lang = 'de') AS findings,
       (SELECT count(*) FROM part) AS nodes, false AS complete""")
def coverage_complete(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "lang")
    state = F.when(F.col("lang") == "de", "unsupported").otherwise("analyzed").alias("state")
    return L.coverage_complete(docs.select(state), docs.filter("lang = 'de'"), table(spark, root, "part"))


@query("""
WITH e AS (
  SELECT doc_id, CASE WHEN source = 'src3' THEN 'x' ELSE '' END || doc_id AS path,
         sha256(CASE WHEN lang = 'es' THEN text || 'x' ELSE text END) AS sha, source, n_chars % 5 AS first,
         n_chars % 9 + 1 AS last, sha256(text) AS real,
         length(text) - length(replace(text, chr(10), '')) + 1 AS line_count FROM documents)
SELECT 'evidence_path_unknown' AS rule, doc_id || '/' || path AS "key", 'path' AS detail FROM e WHERE source = 'src3'
UNION ALL SELECT 'evidence_digest_mismatch', doc_id || '/' || path, 'sha256' FROM e WHERE source <> 'src3' AND sha <> real
UNION ALL SELECT 'evidence_line_out_of_range', doc_id || '/' || path, first || '-' || last FROM e
  WHERE source <> 'src3' AND NOT (first >= 1 AND first <= last AND last <= line_count)""")
def validate_evidence(spark, root):
    docs = table(spark, root, "documents")
    corpus = docs.select(F.col("doc_id").cast("string").alias("path"), "text")
    evidence = docs.select(
        F.col("doc_id").alias("subject"),
        F.concat(F.when(F.col("source") == "src3", "x").otherwise(""), F.col("doc_id").cast("string")).alias("path"),
        F.sha2(F.when(F.col("lang") == "es", F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("file_sha256"),
        (F.col("n_chars") % 5).alias("start_line"), (F.col("n_chars") % 9 + 1).alias("end_line"))
    return L.validate_evidence(evidence, corpus)


@query("""
WITH f AS (SELECT count(*) AS n FROM documents WHERE lang = 'xx'), c AS (SELECT count(*) AS n FROM documents)
SELECT c.n AS analyzed, f.n AS unsupported, f.n AS findings, (SELECT count(*) FROM part) AS nodes, f.n = 0 AS complete FROM f, c""")
def coverage_of_known_languages(spark, root):
    """Coverage in which every language is supported, so the analysis is complete."""
    docs = table(spark, root, "documents").select("doc_id", "lang")
    state = F.when(F.col("lang") == "xx", "unsupported").otherwise("analyzed").alias("state")
    return L.coverage_complete(docs.select(state), docs.filter("lang = 'xx'"), table(spark, root, "part"))


_POINTED = """
WITH e AS (
  SELECT event_id AS id, 'e' || event_id AS path,
         CASE WHEN event_id % 11 = 0 THEN 'no json {' ELSE replace(props, '}', ', "a/b": [null, {"c": 1}]}') END AS text,
         CASE event_id % 7 WHEN 0 THEN '/k' WHEN 1 THEN '/none' WHEN 2 THEN '/a~1b/0' WHEN 3 THEN '/a~1b/01' WHEN 4 THEN '/a~2b'
              WHEN 5 THEN '/a~1b/1/c' END AS pointer,
         CASE WHEN event_id % 5 = 0 THEN 'other' ELSE 'sf' END AS scope_id, event_id % 13 = 0 AS bare FROM events)"""


@query(_POINTED + """
SELECT 'evidence_scope_mismatch' AS rule, id || '/' || path AS "key", scope_id AS detail FROM e WHERE scope_id <> 'sf' AND NOT bare
UNION ALL SELECT 'evidence_pointer_invalid', id || '/' || path, pointer FROM e
  WHERE NOT bare AND pointer IS NOT NULL AND (id % 11 = 0 OR pointer IN ('/none', '/a~1b/01', '/a~2b'))
UNION ALL SELECT 'missing_evidence', CAST(id AS VARCHAR), NULL FROM e WHERE bare""")
def evidence_pointers(spark, root):
    """Evidence for every event's JSON, with pointers of all kinds, foreign scopes and events without evidence."""
    id_ = F.col("event_id")
    text = F.when(id_ % 11 == 0, "no json {").otherwise(F.replace("props", F.lit("}"), F.lit(', "a/b": [null, {"c": 1}]}')))
    pointers = F.array(*[F.lit(p) for p in ("/k", "/none", "/a~1b/0", "/a~1b/01", "/a~2b", "/a~1b/1/c", None)])
    events = table(spark, root, "events").select(id_.alias("subject"), F.concat(F.lit("e"), id_.cast("string")).alias("path"), text.alias("text"))
    evidence = events.filter("subject % 13 <> 0").select(
        "subject", "path", F.sha2("text", 256).alias("file_sha256"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
        F.get(pointers, (F.col("subject") % 7).cast("int")).alias("pointer"),
        F.when(F.col("subject") % 5 == 0, "other").otherwise("sf").alias("scope_id"))
    return L.validate_evidence(evidence, events.select("path", "text"), scope="sf", subjects=events)


# --- candidates ------------------------------------------------------------------------------


def candidates(spark, root) -> tuple[DataFrame, DataFrame]:
    """A candidate per line item, its source being the supplier."""
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    lines = table(spark, root, "lineitem").select(
        F.col("l_suppkey").alias("source_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("candidate_id"),
        F.when(flag == "A", "relationship").when(flag == "N", "field_mapping").when(
            F.col("l_suppkey") % 3 == 0, "asset").when(line == 2, "unresolved").otherwise("governance_proposal").alias("kind"),
        F.when((flag == "R") & (line == 2), "unresolved").when((line == 3) & (F.col("l_suppkey") % 3 == 1), "inferred")
        .otherwise("resolved").alias("status"),
        F.when((line != 7) | (F.col("l_suppkey") % 4 != 0), F.col("l_partkey").cast("string")).alias("object"),
        F.create_map(
            F.lit("relation_type"), F.when((F.col("l_suppkey") % 5 == 0) & (line == 1), "guesses").otherwise("reads"),
            F.lit("source_field"), F.lit("a"), F.lit("target_field"),
            F.when((F.col("l_suppkey") % 7 == 0) & (line == 5), "").otherwise("b")).alias("attributes"),
        "l_partkey", (line == 6).alias("sixth"), (line == 4).alias("fourth"), ((F.col("l_suppkey") % 11 == 0) & (F.col("l_tax") > 0.07)).alias("bare"),
    )
    # The evidence of a candidate is the name or the size in the JSON description of its part.
    parts = table(spark, root, "part").select(
        F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("path"), F.to_json(F.struct("p_name", F.struct("p_size").alias("is"))).alias("text"))
    digests = parts.select("path", F.sha2("text", 256).alias("file_sha256"))
    evidence = lines.filter("NOT bare").select(
        "source_id", "candidate_id", F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("path"),
        F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
        F.when(F.col("sixth") & (F.col("source_id") % 13 == 0), "other").otherwise("sf").alias("scope_id"),
        F.when(F.col("fourth") & (F.col("source_id") % 17 == 0), "/p_size").when(F.col("fourth"), "/is/p_size").otherwise("/p_name").alias("pointer"))
    keys = ["source_id", "candidate_id"]
    found = L.evidence_findings(evidence.join(digests, "path"), parts, keys, scope="sf", subjects=lines)
    return lines.drop("l_partkey", "sixth", "fourth", "bare"), found.select(*keys, F.col("rule").alias("reason"))


_CANDIDATES = """
WITH c AS (
  SELECT l_suppkey AS source_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS candidate_id,
         CASE WHEN l_returnflag = 'A' THEN 'relationship' WHEN l_returnflag = 'N' THEN 'field_mapping'
              WHEN l_suppkey % 3 = 0 THEN 'asset' WHEN l_linenumber = 2 THEN 'unresolved' ELSE 'governance_proposal' END AS kind,
         CASE WHEN l_returnflag = 'R' AND l_linenumber = 2 THEN 'unresolved'
              WHEN l_linenumber = 3 AND l_suppkey % 3 = 1 THEN 'inferred' ELSE 'resolved' END AS status,
         CASE WHEN l_linenumber <> 7 OR l_suppkey % 4 <> 0 THEN l_partkey END AS object,
         l_suppkey % 5 = 0 AND l_linenumber = 1 AS bad_relation, l_suppkey % 7 = 0 AND l_linenumber = 5 AS bad_fields,
         l_suppkey % 11 = 0 AND l_tax > 0.07 AS bare, l_linenumber AS line
  FROM lineitem),
reasons AS (
  SELECT source_id, candidate_id, 'invalid_relation_type' AS reason FROM c WHERE kind = 'relationship' AND bad_relation
  UNION SELECT source_id, candidate_id, 'relationship_missing_object' FROM c WHERE kind = 'relationship' AND object IS NULL
  UNION SELECT source_id, candidate_id, 'field_mapping_missing_fields' FROM c WHERE kind = 'field_mapping' AND bad_fields
  UNION SELECT source_id, candidate_id, 'resolved_mapping_without_source' FROM c
    WHERE kind = 'field_mapping' AND object IS NULL AND status = 'resolved'
  UNION SELECT source_id, candidate_id, 'unresolved_kind_status_mismatch' FROM c
    WHERE kind = 'unresolved' AND status <> 'unresolved'
  UNION SELECT source_id, candidate_id, 'missing_evidence' FROM c GROUP BY ALL HAVING bool_and(bare)
  UNION SELECT source_id, candidate_id, 'evidence_scope_mismatch' FROM c WHERE NOT bare AND line = 6 AND source_id % 13 = 0
  UNION SELECT source_id, candidate_id, 'evidence_pointer_invalid' FROM c WHERE NOT bare AND line = 4 AND source_id % 17 = 0
  UNION SELECT source_id, candidate_id, 'duplicate_candidate_id' FROM c GROUP BY ALL HAVING count(*) > 1),
one AS (SELECT source_id, candidate_id, arg_max(kind, kind) AS kind, arg_max(status, kind) AS status FROM c GROUP BY 1, 2),
rows AS (
  SELECT o.source_id, o.candidate_id, status,
         CASE WHEN r.candidate_id IS NOT NULL THEN 'rejected'
              WHEN kind = 'unresolved' OR status = 'unresolved' THEN 'unresolved'
              WHEN kind <> 'governance_proposal' AND status = 'resolved' THEN 'publishable' ELSE 'held' END AS disposition
  FROM one o LEFT JOIN (SELECT DISTINCT source_id, candidate_id FROM reasons) r
    ON r.source_id = o.source_id AND r.candidate_id = o.candidate_id)"""


@query(_CANDIDATES + " SELECT * FROM reasons")
def candidate_reasons(spark, root):
    return L.candidate_reasons(*candidates(spark, root))


@query(_CANDIDATES + """
SELECT source_id, CASE WHEN bool_or(disposition = 'rejected') THEN 'FAIL'
         WHEN bool_or(disposition = 'unresolved' OR status = 'inferred') THEN 'INCONCLUSIVE' ELSE 'PASS' END AS status,
       CASE WHEN bool_or(disposition = 'rejected') THEN 0 ELSE count(*) FILTER (disposition <> 'rejected') END AS valid_candidates,
       CASE WHEN bool_or(disposition = 'rejected') THEN 0 ELSE count(*) FILTER (disposition = 'publishable') END
         AS publishable_candidates,
       count(*) FILTER (disposition = 'unresolved') AS unresolved_candidates
FROM rows GROUP BY source_id
UNION ALL SELECT s_suppkey + 1000000000, 'INCONCLUSIVE', 0, 0, 0 FROM supplier""")
def validate_candidates(spark, root):
    """Every supplier and a second source for it that has no candidates."""
    key = F.col("s_suppkey")
    sources = table(spark, root, "supplier").select(F.explode(F.array(key, key + 1000000000)).alias("source_id"))
    return L.validate_candidates(*candidates(spark, root), sources)[1]


@query(_CANDIDATES + " SELECT source_id, candidate_id, disposition FROM rows")
def candidate_dispositions(spark, root):
    return L.validate_candidates(*candidates(spark, root))[0]


# --- traversal ---------------------------------------------------------------------------------


def catalog_edges(spark, root) -> DataFrame:
    """region -> nation -> customer -> order -> part, as (src, dst, relationship)."""
    def urn(kind, c):
        return F.concat(F.lit(kind + ":"), F.col(c).cast("string"))

    n, c = table(spark, root, "nation"), table(spark, root, "customer")
    o, li = table(spark, root, "orders"), table(spark, root, "lineitem")
    frames = [
        n.select(urn("region", "n_regionkey").alias("src"), urn("nation", "n_nationkey").alias("dst"),
                 F.lit("Contains").alias("relationship")),
        c.select(urn("nation", "c_nationkey").alias("src"), urn("customer", "c_custkey").alias("dst"),
                 F.lit("Contains").alias("relationship")),
        o.select(urn("customer", "o_custkey").alias("src"), urn("order", "o_orderkey").alias("dst"),
                 F.lit("Produces").alias("relationship")),
        li.select("l_orderkey", "l_partkey").distinct().select(
            urn("order", "l_orderkey").alias("src"), urn("part", "l_partkey").alias("dst"), F.lit("Consumes").alias("relationship")),
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


def grants(spark, root) -> DataFrame:
    """The analyst sees everything but large parts and cancelled-looking orders."""
    actor = F.lit("analyst").alias("actor")
    name = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string")).alias("urn")
    return (
        table(spark, root, "part").filter("p_size <= 40").select(actor, name("part", "p_partkey"))
        .unionByName(table(spark, root, "orders").filter("o_orderstatus <> 'P'").select(actor, name("order", "o_orderkey")))
        .unionByName(table(spark, root, "customer").select(actor, name("customer", "c_custkey")))
        .unionByName(table(spark, root, "nation").select(actor, name("nation", "n_nationkey")))
        .unionByName(table(spark, root, "region").select(actor, name("region", "r_regionkey")))
    )


EDGES_SQL = """
WITH RECURSIVE edges AS (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'Contains' AS relationship FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'Contains' FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'Produces' FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'Consumes' FROM lineitem),
seen AS (
  SELECT 'part:' || p_partkey AS urn FROM part WHERE p_size <= 40
  UNION ALL SELECT 'order:' || o_orderkey FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL SELECT 'customer:' || c_custkey FROM customer UNION ALL SELECT 'nation:' || n_nationkey FROM nation
  UNION ALL SELECT 'region:' || r_regionkey FROM region)"""


@query(EDGES_SQL + """
SELECT * FROM edges WHERE src IN (SELECT urn FROM seen) AND dst IN (SELECT urn FROM seen)""")
def visible_only(spark, root):
    """Edges with both ends granted to the actor."""
    return L.visible_only(catalog_edges(spark, root), grants(spark, root), "analyst", "src", "dst")


@query(EDGES_SQL + """
SELECT * FROM edges WHERE dst = 'part:17' AND src IN (SELECT urn FROM seen)
UNION ALL SELECT * FROM edges WHERE src = 'nation:3' AND dst IN (SELECT urn FROM seen)""")
def lineage_hop(spark, root):
    edges, g = catalog_edges(spark, root), grants(spark, root)
    return L.lineage_hop(edges, "part:17", "UPSTREAM", g, "analyst").unionByName(
        L.lineage_hop(edges, "nation:3", "DOWNSTREAM", g, "analyst"))


_WALK = """
, reach(node, distance) AS (
  SELECT '{start}', 0
  UNION
  SELECT e.{far}, r.distance + 1 FROM reach r JOIN edges e ON e.{near} = r.node),
best AS (SELECT node, min(distance) AS distance FROM reach GROUP BY node)
SELECT b.node, CAST(b.distance AS INTEGER) AS distance, min(p.node) AS parent
FROM best b LEFT JOIN edges e ON e.{far} = b.node LEFT JOIN best p ON p.node = e.{near} AND p.distance = b.distance - 1
GROUP BY b.node, b.distance"""


@query(EDGES_SQL + _WALK.format(start="region:2", near="src", far="dst"))
def lineage_walk(spark, root):
    """Everything below one region, with distance and parent."""
    return L.lineage_walk(catalog_edges(spark, root), "region:2", "DOWNSTREAM")


@query(EDGES_SQL + _WALK.format(start="region:2", near="src", far="dst").replace("SELECT b.node", ", w AS (SELECT b.node") + """),
p(target, position, step) AS (
  SELECT node, distance, node FROM w WHERE starts_with(node, 'part:') UNION ALL
  SELECT p.target, p.position - 1, w.parent FROM p JOIN w ON w.node = p.step WHERE w.parent IS NOT NULL)
SELECT target, CAST(position AS INTEGER) AS position, step FROM p""")
def lineage_paths(spark, root):
    """The path from one region to every part below it."""
    walk = L.lineage_walk(catalog_edges(spark, root), "region:2", "DOWNSTREAM")
    return L.walk_paths(walk, walk.filter(F.startswith("node", F.lit("part:"))))


@query(EDGES_SQL + _WALK.format(start="part:11", near="dst", far="src"))
def lineage_walk_up(spark, root):
    """Everything above one part."""
    return L.lineage_walk(catalog_edges(spark, root), "part:11", "UPSTREAM")


@query("""
WITH RECURSIVE r AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R'),
a AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'A'),
step AS (SELECT DISTINCT a.s AS x, r.s AS y FROM a JOIN r ON a.p = r.p),
reach(x, y) AS (SELECT x, y FROM step UNION SELECT reach.x, step.y FROM reach JOIN step ON step.x = reach.y),
near AS (SELECT x, y FROM reach UNION SELECT s, s FROM r UNION SELECT s, s FROM a),
back AS (SELECT DISTINCT near.x AS s, a.p FROM near JOIN a ON a.s = near.y),
forth AS (SELECT DISTINCT near.y AS s, r.p FROM near JOIN r ON r.s = near.x)
SELECT 'part:' || r.p AS src, 'supplier:' || r.s AS dst, b.s IS NOT NULL AS on_cycle FROM r LEFT JOIN back b ON b.s = r.s AND b.p = r.p
UNION ALL
SELECT 'supplier:' || a.s, 'part:' || a.p, f.s IS NOT NULL FROM a LEFT JOIN forth f ON f.s = a.s AND f.p = a.p""")
def edges_on_cycles(spark, root):
    """Returned sales point part -> supplier, accepted ones supplier -> part."""
    li = table(spark, root, "lineitem")
    part = F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))
    supplier = F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string"))
    back = li.filter("l_returnflag = 'R'").select(part.alias("src"), supplier.alias("dst"))
    kept = li.filter("l_returnflag = 'A'").select(supplier.alias("src"), part.alias("dst"))
    return L.edges_on_cycles(back.unionByName(kept))


@query("""
WITH RECURSIVE n AS (
  SELECT o_orderkey AS node, CASE WHEN o_orderkey > 0 THEN o_orderkey // 2 END AS parent, o_orderstatus = 'F' AS listed
  FROM orders),
up(node, cur, depth) AS (
  SELECT node, parent, 1 FROM n WHERE parent IS NOT NULL
  UNION ALL SELECT u.node, n.parent, u.depth + 1 FROM up u JOIN n ON n.node = u.cur WHERE n.parent IS NOT NULL)
SELECT n.node, first.nearest FROM n LEFT JOIN (
  SELECT u.node, arg_min(u.cur, u.depth) AS nearest FROM up u JOIN n p ON p.node = u.cur AND p.listed GROUP BY u.node) first
ON first.node = n.node""")
def nearest_parent(spark, root):
    """Orders form a binary tree by key; finished orders are listed."""
    key = F.col("o_orderkey")
    return L.nearest_parent(table(spark, root, "orders").select(
        key.alias("node"), F.when(key > 0, F.floor(key / 2)).cast("long").alias("parent"),
        (F.col("o_orderstatus") == "F").alias("listed")))


# --- column lineage ------------------------------------------------------------------------------


def group_members(spark, root) -> DataFrame:
    """Group per order: its parts are upstream fields, its customer the downstream field."""
    up = table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("group_id"), F.lit("upstream").alias("side"), F.lit("part").alias("dataset"),
        F.col("l_partkey").cast("string").alias("field")).distinct()
    down = table(spark, root, "orders").select(
        F.col("o_orderkey").alias("group_id"), F.lit("downstream").alias("side"), F.lit("customer").alias("dataset"),
        F.col("o_custkey").cast("string").alias("field"))
    return up.unionByName(down)


def visible_fields(spark, root) -> DataFrame:
    parts = table(spark, root, "part").filter("p_size <= 45").select(
        F.lit("part").alias("dataset"), F.col("p_partkey").cast("string").alias("field"))
    customers = table(spark, root, "customer").filter("c_mktsegment <> 'MACHINERY'").select(
        F.lit("customer").alias("dataset"), F.col("c_custkey").cast("string").alias("field"))
    return parts.unionByName(customers)


GROUPS_SQL = """
WITH members AS (
  SELECT DISTINCT l_orderkey AS group_id, 'upstream' AS side, 'part' AS dataset, CAST(l_partkey AS VARCHAR) AS field
  FROM lineitem
  UNION ALL SELECT o_orderkey, 'downstream', 'customer', CAST(o_custkey AS VARCHAR) FROM orders),
hidden AS (
  SELECT 'part' AS dataset, CAST(p_partkey AS VARCHAR) AS field FROM part WHERE p_size > 45
  UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'MACHINERY'),
broken AS (SELECT DISTINCT group_id FROM members JOIN hidden USING (dataset, field)),
whole AS (SELECT group_id FROM members GROUP BY group_id HAVING count(DISTINCT side) = 2)
SELECT m.* FROM members m JOIN whole USING (group_id) WHERE group_id NOT IN (SELECT group_id FROM broken)"""


@query(GROUPS_SQL)
def complete_groups(spark, root):
    return L.complete_groups(group_members(spark, root), visible_fields(spark, root))


@query(GROUPS_SQL + """ AND group_id IN (SELECT group_id FROM members WHERE dataset = 'part' AND field = '42')""")
def column_lineage(spark, root):
    return L.column_lineage(group_members(spark, root), visible_fields(spark, root), "part", "42", "DOWNSTREAM")


@query("""
WITH e AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS edge_id, l_linenumber = 6 AS wrong_type,
         l_partkey AS a, CASE WHEN l_linenumber = 5 THEN l_partkey ELSE l_suppkey END AS b, l_linenumber = 4 AS two_down,
         l_returnflag = 'A' AS copied, l_extendedprice / 50000 AS confidence, l_suppkey AS s FROM lineitem)
SELECT edge_id,
       CASE WHEN wrong_type OR two_down OR a = b THEN 'shape_unsupported'
            WHEN NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = a AND p_size <= 45)
              OR NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = b AND p_size <= 45)
              OR NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = s AND p_size <= 45) THEN 'hidden_or_unresolved' END AS omitted,
       CASE WHEN copied THEN 'COPY' ELSE 'DERIVED_OR_UNSPECIFIED' END AS transform,
       CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END AS confidence, 2 AS upstream_count
FROM e""")
def lineage_evidence(spark, root):
    """Field edges per line item from two part fields to one."""
    p, s, line = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber")
    edges = table(spark, root, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("edge_id"),
        F.when(line == 6, "FIELD").otherwise("FIELD_SET").alias("upstream_type"), F.lit("FIELD").alias("downstream_type"),
        F.array(p, F.when(line == 5, p).otherwise(s)).alias("upstreams"),
        F.when(line == 4, F.array(s, p)).otherwise(F.array(s)).alias("downstreams"),
        (F.col("l_extendedprice") / 50000).alias("confidence"),
        F.when(F.col("l_returnflag") == "A", "COPY: same").otherwise("SUM").alias("transform"))
    approved = table(spark, root, "part").filter("p_size <= 45").select(F.col("p_partkey").cast("string").alias("field"))
    return L.lineage_evidence(edges, approved)


def field_facts(spark, root):
    """Schema fields are the (part, supplier) of line items and one more per part; large line items declare, small ones omit and generate."""
    lines, field = table(spark, root, "lineitem"), F.lit(-1).cast("long").alias("field")
    schema = lines.select(F.col("l_partkey").alias("dataset"), F.col("l_suppkey").alias("field")).distinct().union(
        table(spark, root, "part").select("p_partkey", field))
    declarations = lines.filter("l_quantity > 10").select(
        F.col("l_partkey").alias("dataset"), F.col("l_suppkey").alias("field"), (F.col("l_tax") < 0.08).alias("resolved"),
        (F.col("l_returnflag") == "A").alias("has_origin"), (F.col("l_returnflag") == "N").alias("has_generated"),
        (F.col("l_linestatus") == "F").alias("has_constant"))
    small = lines.filter("l_quantity <= 10")
    omissions = small.select(F.col("l_partkey").alias("dataset"), F.col("l_suppkey").alias("field"))
    generations = small.filter("l_returnflag <> 'R'").select(
        F.col("l_partkey").alias("dataset"), F.col("l_suppkey").alias("field"))
    return schema, declarations, omissions, generations


FIELDS_SQL = """
WITH s AS (SELECT DISTINCT l_partkey AS dataset, l_suppkey AS field FROM lineitem UNION ALL SELECT p_partkey, -1 FROM part),
d AS (SELECT l_partkey AS dataset, l_suppkey AS field, bool_and(l_tax < 0.08) AS resolved,
             bool_or(l_returnflag = 'A') AS o, bool_or(l_returnflag = 'N') AS g, bool_or(l_linestatus = 'F') AS k
      FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2),
m AS (SELECT l_partkey AS dataset, l_suppkey AS field, bool_or(l_returnflag <> 'R') AS made
      FROM lineitem WHERE l_quantity <= 10 GROUP BY 1, 2),
c AS (
  SELECT s.dataset, s.field, d.resolved IS NULL AS undeclared,
         CASE WHEN (m.made IS NOT NULL AND NOT m.made) OR NOT coalesce(d.resolved, true) THEN 'UNRESOLVED'
              WHEN coalesce(d.o, false) THEN 'SOURCE_FIELDS' WHEN coalesce(d.g, false) OR coalesce(m.made, false) THEN 'DECLARED_GENERATED'
              WHEN coalesce(d.k, false) THEN 'CONSTANT' WHEN d.resolved IS NULL AND m.made IS NULL THEN 'PRESERVED_EXISTING_VALUE'
              ELSE 'UNRESOLVED' END AS classification
  FROM s LEFT JOIN d USING (dataset, field) LEFT JOIN m USING (dataset, field))"""


@query(FIELDS_SQL + """
SELECT dataset, field, classification, CASE WHEN classification = 'UNRESOLVED' THEN CASE WHEN undeclared
  THEN 'omitted_field_generation_unproven' ELSE 'value_origin_unresolved' END END AS reason FROM c""")
def classify_fields(spark, root):
    return L.classify_fields(*field_facts(spark, root))


@query(FIELDS_SQL + """
SELECT count(*) AS expected_fields, count(*) FILTER (classification <> 'UNRESOLVED') AS classified_fields,
       count(*) FILTER (classification = 'UNRESOLVED') AS unresolved_fields,
       count(*) FILTER (classification = 'UNRESOLVED') = 0 AS complete FROM c""")
def classification_counts(spark, root):
    return L.classification_counts(L.classify_fields(*field_facts(spark, root)))


# --- step graph and binding ------------------------------------------------------------------------


def bindings(spark, root) -> DataFrame:
    """Every order is a step that reads its parts and writes its customer."""
    reads = table(spark, root, "lineitem").select(
        F.concat(F.lit("step:"), F.col("l_orderkey").cast("string")).alias("context"),
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("dataset"),
        F.when(F.col("l_linenumber") == 7, "inspects").otherwise("reads").alias("relation"),
        F.when(F.col("l_quantity") > 48, "UNRESOLVED").otherwise("CATALOG_BOUND").alias("status"),
        F.when(F.col("l_quantity") > 49, "dataset_outside_host_allowlist").alias("reason"))
    writes = table(spark, root, "orders").select(
        F.concat(F.lit("step:"), F.col("o_orderkey").cast("string")).alias("context"),
        F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("dataset"), F.lit("writes").alias("relation"),
        F.lit("CATALOG_BOUND").alias("status"), F.lit(None).cast("string").alias("reason"))
    return reads.unionByName(writes)


BINDINGS_SQL = """
WITH b AS (
  SELECT 'step:' || l_orderkey AS context, 'part:' || l_partkey AS dataset,
         CASE WHEN l_linenumber = 7 THEN 'inspects' ELSE 'reads' END AS relation,
         CASE WHEN l_quantity > 48 THEN 'UNRESOLVED' ELSE 'CATALOG_BOUND' END AS status,
         CASE WHEN l_quantity > 49 THEN 'dataset_outside_host_allowlist' END AS reason FROM lineitem
  UNION ALL SELECT 'step:' || o_orderkey, 'customer:' || o_custkey, 'writes', 'CATALOG_BOUND', NULL FROM orders)"""


@query(BINDINGS_SQL + """
SELECT DISTINCT CASE WHEN relation = 'reads' THEN dataset ELSE context END AS src,
       CASE WHEN relation = 'reads' THEN context ELSE dataset END AS dst, relation AS kind
FROM b WHERE status = 'CATALOG_BOUND' AND relation <> 'inspects'""")
def dataflow_graph_edges(spark, root):
    return L.dataflow_graph(bindings(spark, root))[1]


@query(BINDINGS_SQL + """
SELECT DISTINCT context AS node, 'step' AS kind FROM b
UNION ALL SELECT DISTINCT dataset, 'dataset' FROM b WHERE status = 'CATALOG_BOUND'""")
def dataflow_graph_nodes(spark, root):
    return L.dataflow_graph(bindings(spark, root))[0]


@query(BINDINGS_SQL + """
SELECT CASE WHEN status <> 'CATALOG_BOUND' THEN coalesce(reason, 'dataset_binding_incomplete')
       ELSE 'unsupported_relation_kind' END AS reason, count(*) AS count
FROM b WHERE status <> 'CATALOG_BOUND' OR relation = 'inspects' GROUP BY 1""")
def blocker_counts(spark, root):
    return L.blocker_counts(L.dataflow_graph(bindings(spark, root))[2])


def findings(spark, root) -> DataFrame:
    own = F.concat(F.lit("file"), F.col("l_suppkey").cast("string"))
    both = F.when(F.col("l_partkey") % 2 == 1, F.array(F.lit("common"), own)).otherwise(F.array(own, F.lit("common")))
    return table(spark, root, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("candidate_id"),
        F.col("l_returnflag").alias("method"), F.when(F.col("l_linenumber") != 6, F.col("l_linestatus")).alias("attributes"),
        F.col("l_linenumber").alias("line"), (F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("end_line"),
        F.posexplode(F.when(F.col("l_quantity") < 18, both).otherwise(F.array(own))).alias("position", "path"))


# A second file is evidence of every third line, before the first one for odd parts.
_FINDINGS = f"""
WITH f AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS candidate_id, l_returnflag AS method,
         CASE WHEN l_linenumber <> 6 THEN l_linestatus END AS attributes, l_linenumber AS line, l_linenumber + CAST(l_quantity AS INTEGER) AS end_line,
         CASE WHEN l_quantity < 18 THEN CASE WHEN l_partkey % 2 = 1 THEN ['common', 'file' || l_suppkey] ELSE ['file' || l_suppkey, 'common'] END
              ELSE ['file' || l_suppkey] END AS files FROM lineitem),
e AS (SELECT *, unnest(range(len(files))) AS position, unnest(files) AS path FROM f),
h AS (SELECT *, {row_sql('position', 'path')} AS h FROM e),
lists AS (SELECT candidate_id, method, attributes, count(*) AS files, min(line) AS first_line, max(end_line) AS last_line, {DIGEST} AS d FROM h GROUP BY ALL),
g AS (SELECT *, {row_sql('method', 'attributes', 'd')} AS group_id FROM lists)"""


@query(_FINDINGS + """
SELECT group_id, method, attributes, files, count(*) AS candidates, min(first_line) AS first_line, max(last_line) AS last_line
FROM g GROUP BY ALL""")
def finding_groups(spark, root):
    return L.finding_groups(findings(spark, root))[0]


@query(_FINDINGS + """
SELECT DISTINCT group_id, position, path FROM e JOIN g ON e.candidate_id = g.candidate_id AND e.method = g.method
  AND e.attributes IS NOT DISTINCT FROM g.attributes""")
def finding_files(spark, root):
    return L.finding_groups(findings(spark, root))[1]


@query(_FINDINGS + """
SELECT group_id, e.candidate_id, position, line, end_line FROM e JOIN g ON e.candidate_id = g.candidate_id AND e.method = g.method
  AND e.attributes IS NOT DISTINCT FROM g.attributes""")
def finding_members(spark, root):
    return L.finding_groups(findings(spark, root))[2]


COVERAGE_SQL = """
WITH s AS (SELECT o_custkey AS process, bool_and(o_orderstatus <> 'P') AS ok FROM orders GROUP BY 1),
r AS (
  SELECT o_orderkey AS candidate_id, CASE WHEN o_orderpriority < '4' AND coalesce(ok, false) THEN 'BOUND_SELECTED_WRITE'
         WHEN o_orderstatus <> 'F' THEN 'OUTSIDE_SELECTED_PYTHON_ENTRYPOINT' ELSE 'UNRESOLVED_SELECTED_SOURCE' END AS disposition
  FROM orders LEFT JOIN s ON s.process = o_custkey + 1)"""


def coverage_rows(spark, root) -> DataFrame:
    o = table(spark, root, "orders")
    items = o.select(
        F.col("o_orderkey").alias("candidate_id"), (F.col("o_custkey") + 1).alias("process"),
        F.when(F.col("o_orderpriority") < "4", "sql_mapping_scan").otherwise("other").alias("method"),
        (F.col("o_orderstatus") == "F").alias("selected"))
    statements = o.select(F.col("o_custkey").alias("process"), (F.col("o_orderstatus") != "P").alias("described"))
    return L.source_coverage(items, statements)


@query(COVERAGE_SQL + " SELECT * FROM r")
def source_coverage(spark, root):
    return coverage_rows(spark, root)


@query(COVERAGE_SQL + """
SELECT disposition, count(*) AS count, (SELECT count(*) FROM r WHERE disposition = 'UNRESOLVED_SELECTED_SOURCE') = 0 AS complete FROM r GROUP BY 1""")
def source_coverage_counts(spark, root):
    return L.source_coverage_counts(coverage_rows(spark, root))


@query(COVERAGE_SQL + """
SELECT disposition, count(*) AS count, (SELECT count(*) FROM orders WHERE o_orderstatus = 'X') = 0 AS complete
FROM r WHERE disposition <> 'UNRESOLVED_SELECTED_SOURCE' GROUP BY 1""")
def source_coverage_complete(spark, root):
    """What is resolved or outside, with all contexts bound and no findings in the trace: complete in every row."""
    resolved = coverage_rows(spark, root).filter("disposition <> 'UNRESOLVED_SELECTED_SOURCE'")
    orders = table(spark, root, "orders")
    contexts = orders.select(F.when(F.col("o_orderstatus") == "F", "CATALOG_BOUND").otherwise("NO_DATASET_DEPENDENCIES").alias("status"))
    return L.source_coverage_counts(resolved, contexts, orders.filter("o_orderstatus = 'X'"))


@query("""
WITH r AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS ref_id, l_suppkey AS process,
         CASE l_linenumber WHEN 1 THEN 'Part_' || l_partkey WHEN 2 THEN 'DM.Part_' || l_partkey
              WHEN 3 THEN 'Mart.DM.Part_' || l_partkey WHEN 4 THEN 'Other.DM.Part_' || l_partkey
              WHEN 5 THEN '[Part_' || l_partkey ELSE '[dm].Part_' || l_partkey END AS identifier,
         l_linenumber AS ln, 'mart.dm.part_' || l_partkey AS folded, l_partkey FROM lineitem),
x AS (
  SELECT r.*, CASE WHEN process % 10 = 9 THEN 'connection_scope_unresolved' WHEN ln = 5 THEN 'unsupported_sql_identifier'
         WHEN ln = 1 AND process % 10 = 8 THEN 'default_schema_unresolved' WHEN ln = 4 THEN 'database_outside_host_scope'
         WHEN p_size > 45 THEN 'dataset_outside_host_allowlist' WHEN p_size = 45 THEN 'catalog_key_missing'
         WHEN p_size = 42 THEN 'catalog_key_mismatch' WHEN p_size = 44 THEN 'catalog_status_missing_or_removed'
         WHEN p_size = 43 THEN 'catalog_schema_missing_or_empty' WHEN p_size = 41 THEN 'catalog_schema_platform_mismatch'
         WHEN p_size IN (39, 40) THEN 'catalog_schema_fields_invalid' END AS reason
  FROM r JOIN part ON p_partkey = l_partkey)
SELECT ref_id, process, CASE WHEN reason IS NULL THEN 'CATALOG_BOUND' ELSE 'UNRESOLVED' END AS status,
       CASE WHEN reason IS NULL THEN 'urn:li:dataset:(urn:li:dataPlatform:mssql,' || folded || ',PROD)' END AS dataset, reason
FROM x""")
def bind_tables(spark, root):
    """Line items refer to part tables by names of one to three parts, suppliers are the processes."""
    line, name = F.col("l_linenumber"), F.concat(F.lit("Part_"), F.col("l_partkey").cast("string"))
    references = table(spark, root, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ref_id"),
        F.col("l_suppkey").alias("process"),
        F.when(line == 1, name).when(line == 2, F.concat(F.lit("DM."), name))
        .when(line == 3, F.concat(F.lit("Mart.DM."), name)).when(line == 4, F.concat(F.lit("Other.DM."), name))
        .when(line == 5, F.concat(F.lit("["), name)).otherwise(F.concat(F.lit("[dm]."), name)).alias("identifier"))
    scopes = table(spark, root, "supplier").filter("s_suppkey % 10 <> 9").select(
        F.col("s_suppkey").alias("process"), F.lit("mart").alias("scope_id"), F.lit("Mart").alias("database"),
        F.when(F.col("s_suppkey") % 10 != 8, "dm").alias("default_schema"), F.lit("PROD").alias("env"),
        F.lit(True).alias("lowercase"))
    urn = F.concat(F.lit("urn:li:dataset:(urn:li:dataPlatform:mssql,mart.dm.part_"), F.col("p_partkey").cast("string"),
                   F.lit(",PROD)"))
    part = table(spark, root, "part")
    allowed = part.filter("p_size <= 45").select(F.lit("mart").alias("scope_id"), urn.alias("urn"))
    catalog = part.filter("p_size <> 45").select(
        urn.alias("urn"), (F.col("p_size") == 44).alias("removed"),
        F.when(F.col("p_size") == 43, 0).otherwise(3).alias("field_count"), F.lit("mssql").alias("key_platform"),
        F.concat(F.lit("mart.dm.part_"), F.when(F.col("p_size") == 42, "x").otherwise(F.col("p_partkey").cast("string"))).alias("key_name"),
        F.lit("PROD").alias("key_origin"), F.when(F.col("p_size") != 41, "mssql").alias("schema_platform"),
        F.when(F.col("p_size") == 40, F.array(F.lit("a"), F.lit("a"))).when(F.col("p_size") == 39, F.array(F.lit("a"), F.lit("")))
        .otherwise(F.array(F.lit("a"), F.lit("b"))).alias("fields"))
    return L.bind_tables(references, scopes, allowed, catalog)


@query("""
WITH named AS (SELECT *, CASE WHEN p_brand < 'Brand#3' THEN lower(p_name) ELSE p_name END AS k,
                      CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS stored FROM part),
f AS (SELECT p_brand AS dataset, CASE WHEN p_brand < 'Brand#3' THEN lower(stored) ELSE stored END AS k,
                  count(*) AS n, min(CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END) AS path
           FROM named WHERE p_size < 30 GROUP BY 1, 2)
SELECT p_partkey AS ref_id, CASE WHEN n = 1 THEN path END AS field,
       CASE WHEN coalesce(n, 0) <> 1 THEN 'catalog_column_missing_or_ambiguous' END AS reason
FROM named LEFT JOIN f ON f.dataset = p_brand AND f.k = named.k""")
def resolve_field(spark, root):
    part = table(spark, root, "part")
    columns = part.select(F.col("p_partkey").alias("ref_id"), F.col("p_brand").alias("dataset"), F.col("p_name").alias("column"))
    fields = part.filter("p_size < 30").select(
        F.col("p_brand").alias("dataset"),
        F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("path"))
    folding = part.filter("p_brand < 'Brand#3'").select(F.col("p_brand").alias("dataset"))
    return L.resolve_field(columns, fields, folding)


@query("""
WITH a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R'),
b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F' OR l_returnflag <> 'R')
SELECT l_orderkey, count(*) FILTER (b.l_partkey IS NULL) AS only_left, count(*) FILTER (a.l_partkey IS NULL) AS only_right,
       count(*) FILTER (a.l_partkey IS NULL OR b.l_partkey IS NULL) = 0 AS same
FROM a FULL JOIN b USING (l_orderkey, l_partkey) GROUP BY l_orderkey""")
def same_set(spark, root):
    li = table(spark, root, "lineitem")
    return L.same_set(li.filter("l_returnflag <> 'R'"), li.filter("l_linestatus = 'F' OR l_returnflag <> 'R'"),
                      ["l_orderkey"], ["l_partkey"])


@query("""
WITH li AS (SELECT l_orderkey AS panel, l_linenumber AS position, l_partkey AS field, l_suppkey AS origin,
                   l_returnflag, l_linestatus, l_tax FROM lineitem)
SELECT o_orderkey AS panel,
       CASE WHEN reason IS NULL THEN 'urn:' || o_orderkey END AS urn, reason
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'query_identity_unresolved'
        WHEN o_orderpriority = '5-LOW' THEN 'query_changed'
        WHEN EXISTS (SELECT panel, position, field FROM li WHERE panel = o_orderkey AND NOT (l_returnflag = 'A' AND l_linestatus = 'O')
                     EXCEPT SELECT panel, position, field FROM li WHERE panel = o_orderkey)
          OR EXISTS (SELECT panel, position, field FROM li WHERE panel = o_orderkey EXCEPT
                     SELECT panel, position, field FROM li WHERE panel = o_orderkey AND NOT (l_returnflag = 'A' AND l_linestatus = 'O'))
          THEN 'projection_changed'
        WHEN EXISTS (SELECT field, origin FROM li WHERE panel = o_orderkey EXCEPT
                     SELECT field, origin FROM li WHERE panel = o_orderkey AND l_tax < 0.08) THEN 'lineage_changed' END AS reason
      FROM orders)""")
def bind_panels(spark, root):
    """Orders are panels, their lines the projected fields and origins; some observations differ."""
    o, li = table(spark, root, "orders"), table(spark, root, "lineitem")
    panel, sha = F.col("o_orderkey").alias("panel"), F.sha2(F.col("o_orderkey").cast("string"), 256)
    declared = o.select(panel, sha.alias("query_sha256"))
    observed = o.filter("o_orderstatus <> 'P'").select(
        panel, F.concat(F.lit("urn:"), F.col("o_orderkey").cast("string")).alias("urn"),
        F.when(F.col("o_orderpriority") == "5-LOW", "changed").otherwise(sha).alias("query_sha256"))
    fields = li.select(F.col("l_orderkey").alias("panel"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("field"),
                       F.col("l_suppkey").alias("origin"), "l_returnflag", "l_linestatus", "l_tax")
    return L.bind_panels(declared, observed, fields, fields.filter("NOT (l_returnflag = 'A' AND l_linestatus = 'O')"),
                         fields, fields.filter("l_tax < 0.08"))


@query("""
WITH u AS (SELECT DISTINCT l_orderkey AS datasource, l_partkey AS urn FROM lineitem),
a AS (SELECT p_partkey AS urn, 'even' AS scope_id FROM part WHERE p_size % 2 = 0 UNION ALL
      SELECT p_partkey, 'small' FROM part WHERE p_size < 30 UNION ALL SELECT p_partkey, 'large' FROM part WHERE p_size >= 25),
full_scopes AS (
  SELECT datasource, scope_id FROM u JOIN a USING (urn) GROUP BY 1, 2
  HAVING count(*) = (SELECT count(*) FROM u u2 WHERE u2.datasource = u.datasource)),
k AS (SELECT datasource, count(*) AS n, min(scope_id) AS scope_id FROM full_scopes GROUP BY 1)
SELECT d.datasource, CASE WHEN n = 1 THEN scope_id END AS scope_id,
       CASE WHEN coalesce(n, 0) <> 1 THEN 'scope_ambiguous_or_unapproved' END AS reason
FROM (SELECT DISTINCT datasource FROM u) d LEFT JOIN k USING (datasource)""")
def resolve_scope(spark, root):
    upstreams = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("datasource"), F.col("l_partkey").alias("urn"))
    part = table(spark, root, "part")

    def scope(name, rule):
        return part.filter(rule).select(F.lit(name).alias("scope_id"), F.col("p_partkey").alias("urn"))

    allowed = scope("even", "p_size % 2 = 0").unionByName(scope("small", "p_size < 30")).unionByName(
        scope("large", "p_size >= 25"))
    return L.resolve_scope(upstreams, allowed)


# --- tables and jobs ------------------------------------------------------------------------------


@query("""
SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey <> l_partkey""")
def table_lineage(spark, root):
    origins = table(spark, root, "lineitem").select(
        F.col("l_partkey").alias("dataset"), F.col("l_linenumber").alias("field"),
        F.col("l_suppkey").alias("origin_dataset"), F.col("l_returnflag").alias("role"))
    return L.table_lineage(origins)


def job_steps(spark, root) -> DataFrame:
    """Suppliers are jobs, line items their steps over parts, in ship order."""
    return table(spark, root, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("job"),
        (F.unix_date(F.to_date("l_shipdate")) * 10 + F.col("l_linenumber")).alias("step"),
        F.when(F.col("l_returnflag") == "A", "writes").otherwise("reads").alias("relation"),
        F.col("l_partkey").alias("dataset"))


STEPS_SQL = """
WITH steps AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS job, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) * 10
         + l_linenumber AS step, CASE WHEN l_returnflag = 'A' THEN 'writes' ELSE 'reads' END AS relation, l_partkey AS dataset
  FROM lineitem)"""


@query(STEPS_SQL + """
SELECT job, relation, dataset, count(DISTINCT step) AS steps, CAST(min(step) AS INTEGER) AS first_step,
       CAST(max(step) AS INTEGER) AS last_step, array_to_string(list_sort(list(DISTINCT CAST(step AS INTEGER))), ',') AS step_ids
FROM steps GROUP BY 1, 2, 3""")
def job_io(spark, root):
    return L.job_io(job_steps(spark, root), ids=True).withColumns(
        {c: F.col(c).cast("int") for c in ("first_step", "last_step")} | {"step_ids": F.array_join(F.col("step_ids").cast("array<string>"), ",")})


@query(STEPS_SQL + " SELECT DISTINCT job, relation, dataset, CAST(step AS INTEGER) AS step FROM steps")
def job_touches(spark, root):
    return L.job_touches(job_steps(spark, root)).withColumn("step", F.col("step").cast("int"))


@query(STEPS_SQL + """
, s AS (SELECT DISTINCT * FROM steps),
w AS (SELECT dataset, job, step, row_number() OVER (PARTITION BY dataset ORDER BY step, job) AS n FROM s WHERE relation = 'writes')
SELECT w.dataset, w.job, 'writes' AS relation, CAST(w.step AS INTEGER) AS step, w.n AS write_number,
       CAST(NULL AS BIGINT) AS writes_before, CAST(NULL AS BIGINT) AS depends_on_writes FROM w
UNION ALL
SELECT r.dataset, r.job, 'reads', CAST(r.step AS INTEGER), NULL, count(w.job), count(w.job) FILTER (w.job <> r.job)
FROM s r LEFT JOIN w ON w.dataset = r.dataset AND w.step < r.step
WHERE r.relation = 'reads' GROUP BY r.dataset, r.job, r.step""")
def job_dependencies(spark, root):
    return L.job_dependencies(job_steps(spark, root)).withColumn("step", F.col("step").cast("int"))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, [CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)] AS u,
                  [CAST(l_orderkey AS VARCHAR)] AS d, l_linestatus FROM lineitem),
cur AS (SELECT list_sort(u) AS u, d FROM c WHERE l_linestatus = 'F'),
des AS (SELECT DISTINCT list_sort(u) AS u, d FROM c WHERE l_linenumber <= 4)
SELECT array_to_string(u, ',') AS upstreams, d[1] AS downstream, 'current' AS origin FROM cur
UNION ALL SELECT array_to_string(u, ','), d[1], 'added' FROM (SELECT * FROM des EXCEPT SELECT * FROM cur)""")
def merge_lineage(spark, root):
    """Desired edges list their upstreams in the other order."""
    p, s = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    down = F.array(F.col("l_orderkey").cast("string")).alias("downstreams")
    kinds = [F.lit("FIELD_SET").alias("upstream_type"), F.lit("FIELD").alias("downstream_type")]
    li = table(spark, root, "lineitem")
    current = li.filter("l_linestatus = 'F'").select(*kinds, F.array(p, s).alias("upstreams"), down)
    desired = li.filter("l_linenumber <= 4").select(*kinds, F.array(s, p).alias("upstreams"), down)
    merged = L.merge_lineage(current, desired)
    return merged.select(F.array_join(F.array_sort("upstreams"), ",").alias("upstreams"),
                         F.col("downstreams")[0].alias("downstream"), "origin")


@query("""
WITH c AS (SELECT DISTINCT l_orderkey AS job, l_partkey AS dataset FROM lineitem WHERE l_returnflag <> 'N'),
d AS (SELECT DISTINCT l_orderkey AS job, l_partkey AS dataset FROM lineitem WHERE l_linestatus = 'F')
SELECT *, 'added' AS change FROM (SELECT * FROM d EXCEPT SELECT * FROM c)
UNION ALL SELECT *, 'conflict' FROM (SELECT * FROM c EXCEPT SELECT * FROM d)""")
def extend_only(spark, root):
    li = table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("job"), F.col("l_partkey").alias("dataset"), "l_returnflag", "l_linestatus")
    return L.extend_only(li.filter("l_returnflag <> 'N'"), li.filter("l_linestatus = 'F'"), ["job"], "dataset")


@query("""
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_observation(spark, root):
    rows = table(spark, root, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return L.latest_observation(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""
SELECT p_partkey, regexp_extract(urn, 'dataPlatform:([^,]+),', 1) AS platform, p_name AS name, 'S' || p_size AS environment
FROM (SELECT *, 'urn:li:dataset:(urn:li:dataPlatform:' || p_brand || ',' || p_name || ',S' || p_size || ')' AS urn FROM part)
WHERE p_size > 3
UNION ALL SELECT p_partkey, NULL, NULL, NULL FROM part WHERE p_size <= 3""")
def parse_urn(spark, root):
    """Small parts get an extra comma and therefore no valid key."""
    urn = F.concat(F.lit("urn:li:dataset:(urn:li:dataPlatform:"), "p_brand", F.lit(","), "p_name",
                   F.when(F.col("p_size") <= 3, ",x").otherwise(""), F.lit(",S"), F.col("p_size").cast("string"), F.lit(")"))
    platform, name, environment = S.parse_urn(urn)
    return table(spark, root, "part").select(
        "p_partkey", platform.alias("platform"), name.alias("name"), environment.alias("environment"))
