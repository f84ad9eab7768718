"""Documents, JSON documents, conversations, session logs and row export."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from martweave.functions import scalars as S
from martweave.functions.documents import values_at
from martweave.operators import quality
from martweave.operators import sessions as T
from martweave.queries.registry import DIGEST, query, row_sql
from martweave.sources import declared, readers
from martweave.sources.adapter import table
from martweave.sources.sinks import to_wire as wire


@query("SELECT doc_id AS path, sha256(text) AS sha256, strlen(text) AS size_bytes FROM documents")
def corpus_manifest(spark, root):
    return readers.corpus_manifest(table(spark, root, "documents"), F.col("doc_id"), F.col("text"))


@query(f"""
WITH hashed AS (SELECT strlen(text) AS size, {row_sql('doc_id', 'sha256(text)', 'strlen(text)')} AS h FROM documents)
SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS total_bytes, {DIGEST} AS manifest_sha256 FROM hashed""")
def manifest_digest(spark, root):
    return readers.manifest_digest(readers.corpus_manifest(table(spark, root, "documents"), F.col("doc_id"), F.col("text")))


# --- JSON documents built from the tables -----------------------------------------------------


def dashboards(spark, root):
    """A dashboard per supplier: two panels, a row with a panel and another row inside, two variables."""
    k, balance = F.col("s_suppkey"), F.col("s_acctbal")
    key = k.cast("string")

    def source(kind):
        return F.struct(kind.alias("type"), F.concat(F.lit("ds"), (k % 3).cast("string")).alias("uid"))

    mssql = F.lit("mssql")
    kind = F.when(k % 5 == 0, "postgres").otherwise("mssql")

    def target(sql):
        return F.struct(F.lit("A").alias("refId"), sql.alias("rawSql"))

    one = F.array(target(F.concat(F.lit("SELECT "), key)))
    two = F.array(target(F.lit("SELECT 1")), target(F.lit("SELECT 2")))
    empty = F.filter(one, lambda t: F.lit(False))

    def panel(number, type_, targets, ds, panels):
        return F.struct(number.alias("id"), type_.alias("type"), targets.alias("targets"), ds.alias("datasource"), panels.alias("panels"))

    deepest = F.array(F.struct(F.lit(4).alias("id"), F.lit("stat").alias("type"), one.alias("targets"), source(mssql).alias("datasource")))
    inner = F.array(
        panel(F.lit(3), F.lit("stat"), one, source(mssql), F.filter(deepest, lambda p: F.lit(False))),
        panel(F.lit(11), F.lit("row"), empty, source(mssql), deepest))
    none = F.filter(inner, lambda p: F.lit(False))
    panels = F.array(
        panel(F.lit(1), F.lit("stat"), one, source(kind), none),
        panel(F.when(k % 7 == 0, 1).otherwise(2), F.lit("table"), F.when(k % 4 == 0, two).otherwise(one), source(mssql), none),
        panel(F.lit(9), F.lit("row"), empty, source(mssql), inner))
    variables = F.array(
        F.struct(F.lit("territory").alias("name"), F.lit("query").alias("type"), F.lit("SELECT t").alias("query"), source(mssql).alias("datasource")),
        F.struct(F.when(k % 11 == 0, "territory").otherwise("span").alias("name"), F.lit("interval").alias("type"), F.lit("1d").alias("query"), source(mssql).alias("datasource")))
    board = F.struct(
        F.when(balance >= 0, F.concat(F.lit("d"), key)).alias("uid"), panels.alias("panels"),
        F.struct(variables.alias("list")).alias("templating"))
    wrapped = F.when(k % 2 == 0, F.to_json(F.struct(board.alias("dashboard")))).otherwise(F.to_json(board))
    return table(spark, root, "supplier").select(key.alias("path"), wrapped.alias("text"))


@query("""
WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS path, s_suppkey AS k, 'd' || s_suppkey AS dashboard_uid, 'ds' || (s_suppkey % 3) AS ds,
                  'SELECT ' || s_suppkey AS sql1 FROM supplier WHERE s_acctbal >= 0 AND s_suppkey % 11 <> 0)
SELECT CAST(s_suppkey AS VARCHAR) AS path, NULL AS dashboard_uid, 'dashboard' AS kind, NULL AS id, NULL AS ref_id, NULL AS datasource_uid,
       NULL AS sql, 'dashboard_identity_missing' AS reason FROM supplier WHERE s_acctbal < 0
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'd' || s_suppkey, 'dashboard', NULL, NULL, NULL, NULL, 'variable_identity_invalid'
FROM supplier WHERE s_acctbal >= 0 AND s_suppkey % 11 = 0
UNION ALL SELECT path, dashboard_uid, 'panel', '1', 'A', ds, sql1,
       CASE WHEN k % 5 = 0 THEN 'datasource_binding_required' END FROM s
UNION ALL SELECT path, dashboard_uid, 'panel', CASE WHEN k % 7 = 0 THEN '1' ELSE '2' END, 'A', ds, CASE WHEN k % 4 = 0 THEN 'SELECT 1' ELSE sql1 END,
       CASE WHEN k % 7 = 0 OR k % 4 = 0 THEN 'panel_structure_unsupported' END FROM s
UNION ALL SELECT path, dashboard_uid, 'panel', unnest(['3', '4']), 'A', ds, sql1, NULL FROM s
UNION ALL SELECT path, dashboard_uid, 'variable', 'territory', NULL, ds, 'SELECT t', NULL FROM s
UNION ALL SELECT path, dashboard_uid, 'variable', 'span', NULL, ds, '1d', 'variable_type_unsupported' FROM s""")
def explode_dashboards(spark, root):
    return declared.explode_dashboards(dashboards(spark, root))


def api_specs(spark, root):
    """An API document per part with one to three paths, references and members that are not described."""
    k, n, key = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey").cast("string")
    plain = '{"content":{"application/json":{"schema":{"type":"object"}}}}'
    referred = lambda name: F.lit('{"$ref":"#/components/responses/%s"}' % name)
    answer = (F.when(k % 8 == 1, referred("near")).when(k % 8 == 3, referred("none")).when(k % 8 == 5, referred("loop"))
              .when(k % 8 == 7, '{"$ref":"#/components","summary":"s"}').otherwise(plain))
    ok = F.format_string(
        '{"get":{%s"responses":{"200":%s,"%s":%s}},"post":{"requestBody":{"content":{"%s":{"schema":{}}}},"responses":{"204":%s}}%s%s}',
        F.when(n % 4 == 0, '"parameters":[],"callbacks":{},').otherwise(""), answer,
        F.when(n % 5 == 0, "abc").otherwise("4XX"), F.when(n % 9 == 0, '{"headers":{}}').otherwise("{}"),
        F.when(n % 3 == 0, "text/csv").otherwise("application/json"), F.when(n % 11 == 0, '{"content":[]}').otherwise("{}"),
        F.when(n % 7 == 0, ',"fetch":{},"x-team":1,"summary":"s"').otherwise(""), F.when(n % 6 == 0, ',"parameters":[]').otherwise(""))
    bare = F.when(k % 12 == 0, '{"delete":1}').otherwise('{"delete":{"responses":{}}}')
    reference = F.lit('{"$ref":"#/elsewhere"}')
    parts = F.lit(',"components":{"responses":{"near":{"$ref":"#/components/responses/far"},"far":%s,"loop":{"$ref":"#/components/responses/pool"},'
                  '"pool":{"$ref":"#/components/responses/loop"}}}' % plain)
    doc = F.when(n == 50, '{"openapi":"3.0.1","info":1}').when(n == 49, '{"swagger":"2.0","paths":{"/x":{}}}').otherwise(F.concat(
        F.lit('{"openapi":"3.0.0","paths":{"/parts/'), key, F.lit('":'), ok, F.lit(',"/parts/'), key, F.lit('/old":'), bare,
        F.when(k % 2 == 0, F.concat(F.lit(',"/ref":'), reference)).otherwise(""), F.lit("}"), parts,
        F.when(k % 10 == 0, ',"servers":[]').otherwise(""), F.lit("}")))
    # A split of this narrow table makes far more documents than it has bytes, so its keys are spread first.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, root, "part").select("p_partkey", "p_size").repartition(tasks, "p_partkey").select(key.alias("path"), doc.alias("text"))


@query("""
WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS doc, p_partkey AS k, p_size AS n, '/parts/' || p_partkey AS route FROM part WHERE p_size < 49)
SELECT CAST(p_partkey AS VARCHAR) AS doc, NULL AS route, NULL AS method, NULL AS role, NULL AS media,
       CASE p_size WHEN 50 THEN 'paths_missing' ELSE 'document_unsupported' END AS reason
FROM part WHERE p_size >= 49
UNION ALL SELECT doc, NULL, NULL, NULL, NULL, 'global_servers_not_projected' FROM p WHERE k % 10 = 0
UNION ALL SELECT doc, '/ref', NULL, NULL, NULL, 'path_unsupported' FROM p WHERE k % 2 = 0
UNION ALL SELECT doc, route || '/old', 'delete', NULL, NULL, CASE WHEN k % 12 = 0 THEN 'operation_invalid' ELSE 'responses_missing' END FROM p
UNION ALL SELECT doc, route, 'fetch', NULL, NULL, 'path_member_unsupported' FROM p WHERE n % 7 = 0
UNION ALL SELECT doc, route, NULL, NULL, NULL, 'path_parameters_not_projected' FROM p WHERE n % 6 = 0
UNION ALL SELECT doc, route, 'get', NULL, NULL, unnest(['parameters_not_projected', 'callbacks_not_projected']) FROM p WHERE n % 4 = 0
UNION ALL SELECT doc, route, 'get', 'response:200', 'application/json', NULL FROM p WHERE k % 8 NOT IN (3, 5, 7)
UNION ALL SELECT doc, route, 'get', 'response:200', NULL, unnest([
         CASE k % 8 WHEN 3 THEN 'reference_missing' WHEN 5 THEN 'reference_cycle' ELSE 'reference_unsupported' END, 'content_invalid'])
FROM p WHERE k % 8 IN (3, 5, 7)
UNION ALL SELECT doc, route, 'get', CASE WHEN n % 5 = 0 THEN 'response:abc' ELSE 'response:4XX' END, NULL,
       CASE WHEN n % 5 = 0 THEN 'response_status_unsupported' END FROM p
UNION ALL SELECT doc, route, 'get', 'response:4XX', NULL, 'response_metadata_not_projected' FROM p WHERE n % 9 = 0 AND n % 5 <> 0
UNION ALL SELECT doc, route, 'post', 'request', CASE WHEN n % 3 = 0 THEN 'text/csv' ELSE 'application/json' END,
       CASE WHEN n % 3 = 0 THEN 'media_schema_unsupported' END FROM p
UNION ALL SELECT doc, route, 'post', 'response:204', NULL, CASE WHEN n % 11 = 0 THEN 'content_invalid' END FROM p""")
def explode_api_specs(spark, root):
    return declared.explode_api_specs(api_specs(spark, root))


# Per-user gap lists: JSON values of the event log.
@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, CAST(NULL AS VARCHAR) AS missing,
       CASE WHEN user_id % 2 = 0 THEN 'null' END AS explicit_null FROM events""")
def json_at(spark, root):
    """A value, a missing member and, for even users, an explicit null."""
    props = F.col("props")
    with_null = F.when(F.col("user_id") % 2 == 0, F.replace(props, F.lit("}"), F.lit(', "a/b": [null]}'))).otherwise(props)
    return table(spark, root, "events").select(
        "event_id", S.json_at(props, "/k").alias("k"), S.json_at(props, "/none").alias("missing"),
        S.json_at(with_null, "/a~1b/0").alias("explicit_null"))


@query("""
WITH e AS (SELECT event_id, replace(props, '}', ', "a/b": [' || user_id || ', "x"]}') AS t,
                  CAST(json_extract(props, '$.k') AS VARCHAR) AS k, user_id, unnest(['/k', '/a~1b', '/a~1b/1', '/a~1b/2']) AS pointer FROM events)
SELECT event_id, pointer, CASE pointer WHEN '/k' THEN 'number' WHEN '/a~1b' THEN 'array' WHEN '/a~1b/1' THEN 'string' END AS kind,
       CASE pointer WHEN '/k' THEN k WHEN '/a~1b' THEN '[' || user_id || ',"x"]' WHEN '/a~1b/1' THEN '"x"' END AS text FROM e""")
def json_values(spark, root):
    """Values at pointers that are data: a member, a list, one of its elements, and one that is not there."""
    events = table(spark, root, "events").select(
        "event_id", F.replace("props", F.lit("}"), F.concat(F.lit(', "a/b": ['), F.col("user_id").cast("string"), F.lit(', "x"]}'))).alias("text"))
    asked = events.select("event_id", F.explode(F.array(*[F.lit(p) for p in ("/k", "/a~1b", "/a~1b/1", "/a~1b/2")])).alias("pointer"))
    return values_at(events, ["event_id"], "text", asked)


@query("""
SELECT o_orderkey, sha256('{"customer":' || o_custkey || ',"order":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') AS digest,
       'node_' || sha256('["' || o_orderpriority || '","order","' || o_orderkey || '"]') AS node_id FROM orders""")
def canonical_digest(spark, root):
    key = F.col("o_orderkey")
    return table(spark, root, "orders").select(
        "o_orderkey",
        S.canonical_digest({"status": F.col("o_orderstatus"), "order": key, "customer": F.col("o_custkey")}).alias("digest"),
        S.stable_id("node_", F.col("o_orderpriority"), F.lit("order"), key.cast("string")).alias("node_id"))


@query("""
SELECT '{"id":"' || o_orderkey || '","day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","price":"' || CAST(o_totalprice AS DECIMAL(19,4))
       || '","label":"' || o_orderpriority || '","done":' || CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END
       || ',"at":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '","none":null}' AS json FROM orders""")
def to_wire(spark, root):
    return wire(table(spark, root, "orders").select(
        F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(19,4)").alias("price"),
        F.col("o_orderpriority").alias("label"), (F.col("o_orderstatus") == "F").alias("done"), F.col("o_orderdate").alias("at"),
        F.lit(None).cast("int").alias("none")))


@query("""
SELECT 'invalid_amount' AS reason, count(*) AS rows FROM events WHERE event_type = 'error'
UNION ALL SELECT 'invalid_user', count(*) FROM events WHERE user_id % 10 = 0
UNION ALL SELECT 'invalid_kind', count(*) FROM events WHERE event_type = 'view'""")
def coerce_source(spark, root):
    """Event rows read as text, some cells damaged: rows per reason."""
    rows = table(spark, root, "events").select(
        F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")).alias("amount"),
        F.when(F.col("user_id") % 10 == 0, "12x").otherwise(F.col("user_id").cast("string")).alias("user"),
        F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("kind"),
        F.lit(None).cast("string").alias("note"))
    _, bad = quality.coerce_source(rows, {"amount": ("decimal4", False), "user": ("int", False), "kind": ("text", False), "note": ("text", True)})
    return bad.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


# --- secrets, analyzers ----------------------------------------------------------------------------

_WORDS = "(?:password|passwd|pwd|secret|token|api[_-]?key|authorization|cookie)"
_PLACE = r"^(?:Bearer |Basic )?(?:\$\{[A-Z_][A-Z0-9_]*\}|\$\([A-Z_][A-Z0-9_]*\))$"


@query(rf"""
WITH d AS (
  SELECT doc_id, list_concat(
      regexp_extract_all(text, '(?i)["'']?\b{_WORDS}["'']?\s*[:=]\s*"([^\r\n]*?)"', 1),
      regexp_extract_all(text, '(?i)["'']?\b{_WORDS}["'']?\s*[:=]\s*''([^\r\n]*?)''', 1)) AS quoted,
    [trim(x) for x in regexp_extract_all(text, '(?im)^\s*{_WORDS}[ \t]*:[ \t]*([^\r\n#]*)', 1)] AS yaml,
    [trim(x) for x in regexp_extract_all(text, '(?i)[;"'']\s*(?:PWD|PASSWORD)\s*=\s*([^;"''\r\n]+)', 1)] AS odbc, text FROM documents)
SELECT doc_id, 'private_key' AS rule FROM d WHERE regexp_matches(text, '-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----')
UNION ALL SELECT doc_id, 'url_credential' FROM d WHERE regexp_matches(text, '(?i)\b[a-z][a-z0-9+.-]*://[^/\s:@]+:[^/\s@]+@')
UNION ALL SELECT doc_id, 'quoted_secret' FROM d WHERE len([x for x in quoted if x <> '' AND NOT regexp_matches(x, '{_PLACE}')]) > 0
UNION ALL SELECT doc_id, 'yaml_secret' FROM d WHERE len([x for x in yaml if x NOT IN ('', 'null', 'Null', 'NULL', '~')
    AND x[1] NOT IN ('"', '''') AND NOT regexp_matches(x, '{_PLACE}')]) > 0
UNION ALL SELECT doc_id, 'odbc_secret' FROM d WHERE len([x for x in odbc if NOT regexp_matches(x, '{_PLACE}')]) > 0""")
def screen_secrets(spark, root):
    return T.screen_secrets(table(spark, root, "documents").select("doc_id", "text"))


@query("""
SELECT what, CAST(n AS BIGINT) AS rows FROM (
SELECT 'coverage:' || CASE WHEN lang = 'de' THEN 'unsupported' ELSE 'analyzed' END AS what, count(*) AS n FROM documents GROUP BY 1
UNION ALL SELECT 'finding:language', count(*) FROM documents WHERE lang = 'de'
UNION ALL SELECT 'node:asset', count(*) FROM documents WHERE lang <> 'de'
UNION ALL SELECT 'edge:reads', sum(length(text) - length(replace(text, '?', ''))) FROM documents WHERE lang <> 'de'
  HAVING sum(length(text) - length(replace(text, '?', ''))) > 0)""")
def analyze_corpus(spark, root):
    """A user analyzer over whole documents; rows per record and kind."""
    def analyze(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for path, text in zip(frame["path"], frame["text"]):
            if path.startswith("de/"):
                rows.append({"record": "coverage", "path": path, "state": "unsupported", "code": "language"})
                rows.append({"record": "finding", "path": path, "code": "language"})
                continue
            rows.append({"record": "coverage", "path": path, "state": "analyzed", "code": "ok"})
            rows.append({"record": "node", "path": path, "kind": "asset", "local_id": path, "name": path})
            rows.extend({"record": "edge", "path": path, "kind": "reads", "source": path, "target": str(i)}
                        for i in range(text.count("?")))
        return pd.DataFrame(rows)

    docs = table(spark, root, "documents").select(F.concat_ws("/", "lang", "doc_id").alias("path"), "text")
    g = T.analyze_corpus(docs, analyze)
    what = {"coverage": "state", "findings": "code", "nodes": "kind", "edges": "kind"}
    names = {"coverage": "coverage", "findings": "finding", "nodes": "node", "edges": "edge"}
    result = None
    for part, column in what.items():
        n = g[part].groupBy(F.concat(F.lit(names[part] + ":"), column).alias("what")).agg(F.count(F.lit(1)).alias("rows"))
        result = n if result is None else result.unionByName(n)
    return result


@query("""
WITH d AS (SELECT *, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents),
v AS (
  SELECT 'file_covered_twice' AS rule FROM d WHERE source = 'src4'
  UNION ALL SELECT 'unsupported_without_finding' FROM d WHERE lang = 'de' AND source = 'src3'
  UNION ALL SELECT 'dangling_edge' FROM d WHERE lang = 'es'
  UNION ALL SELECT 'evidence_line_out_of_range' FROM d WHERE lang = 'fr'
  UNION ALL SELECT 'missing_evidence' FROM d WHERE lang = 'en' AND source = 'src5'
  UNION ALL SELECT 'duplicate_field' FROM d WHERE lang <> 'de' AND source = 'src6')
SELECT rule, count(*) AS violations, false AS complete FROM v GROUP BY rule""")
def analyze_graph(spark, root):
    """A user analyzer whose graph, coverage and evidence break a rule for some documents; violations per rule."""
    def analyze(path: str, text: str | None):
        lang, source, _ = path.split("/")
        yield {"record": "coverage", "state": "unsupported" if lang == "de" else "analyzed"}
        if source == "src4":
            yield {"record": "coverage", "state": "unsupported" if lang == "de" else "analyzed"}
        if lang == "de":
            if source != "src3":
                yield {"record": "finding", "code": "language_unsupported"}
            return
        asset, port = T.node_ref("corpus", "asset", path), T.node_ref("corpus", "port", path)
        fields = [{"path": "length", "native_type": "int"}] * (2 if source == "src6" else 1)
        yield {"record": "node", "id": asset, "kind": "asset", "local_id": path}
        yield {"record": "node", "id": port, "kind": "port", "local_id": path, "owner": asset, "fields": fields}
        target = port if lang != "es" else "node_missing"
        yield {"record": "edge", "id": path, "kind": "value_dependency", "sources": [{"node": port, "field": "length"}], "target": {"node": target, "field": "length"}}
        lines = (text or "").count("\n") + 1
        for subject in (asset, port, *([path] if (lang, source) != ("en", "src5") else [])):
            yield {"record": "evidence", "id": subject, "start_line": 1, "end_line": lines + (lang == "fr" and subject == path)}

    docs = table(spark, root, "documents").select(F.concat_ws("/", "lang", "source", "doc_id").alias("path"), "text")
    g = T.analyze_graph(docs, "corpus", analyze)
    counted = g["violations"].groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))
    return counted.withColumn("complete", F.lit(g["complete"].first()["complete"]))


# --- sessions -----------------------------------------------------------------------------------------


def conversation_log(spark, root):
    return table(spark, root, "conversations").select(
        F.col("conv_id").alias("session"), F.col("turn").alias("position"), "role", "text", F.col("conv_id").alias("modified"))


_HITS = """
WITH h AS (
  SELECT conv_id AS session, turn AS position, conv_id AS modified, text, strpos(lower(text), 'the') AS pos
  FROM conversations WHERE role IN ('user', 'assistant') AND strpos(lower(text), 'the') > 0),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY session ORDER BY position) = 1),
s AS (
  SELECT session, position, modified,
         CASE WHEN pos - 1 > 80 THEN '...' ELSE '' END
           || ltrim(regexp_replace(substr(text, greatest(pos - 80, 1), pos - greatest(pos - 80, 1)), '\\s+', ' ', 'g')) AS before,
         substr(text, pos, 3) AS match,
         rtrim(regexp_replace(substr(text, pos + 3, 80), '\\s+', ' ', 'g'))
           || CASE WHEN length(text) - (pos + 2) > 80 THEN '...' ELSE '' END AS after
  FROM f)"""


@query(_HITS + " SELECT * FROM s ORDER BY modified DESC LIMIT 30")
def search_conversations(spark, root):
    """Newest 30 sessions with a hit; the limit is the feature."""
    return T.search_conversations(conversation_log(spark, root), "the")[0]


@query(_HITS + " SELECT count(*) > 30 AS truncated FROM s")
def search_conversations_truncated(spark, root):
    return T.search_conversations(conversation_log(spark, root), "the")[1]


@query("""
SELECT doc_id, strpos(lower(text), 'the ') AS position, CASE WHEN strpos(lower(text), 'the ') > 0
  THEN regexp_replace(substr(text, strpos(lower(text), 'the '), 4), '\\s+', ' ', 'g') END AS match FROM documents""")
def snippet(spark, root):
    """Position and text of the first hit in every whole document."""
    return table(spark, root, "documents").select(
        "doc_id", F.locate("the ", F.lower("text")).cast("long").alias("position"), S.snippet(F.col("text"), "THE ")[1].alias("match"))


@query("""
SELECT conv_id AS session, min(turn) AS position, arg_min(length(text), turn) AS size FROM conversations
WHERE role = 'assistant' GROUP BY 1""")
def first_match(spark, root):
    rows = conversation_log(spark, root).filter("role = 'assistant'").withColumn("size", F.length("text").cast("long"))
    return T.first_match(rows, "session", "position", ["size"])


@query("""
SELECT conv_id AS session, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS assistant_messages,
       CAST(coalesce(sum(turn) FILTER (role = 'assistant'), 0) AS BIGINT) AS tool_calls, 0 AS tool_results,
       count(*) FILTER (role <> 'system') AS total_messages,
       CAST(coalesce(sum(length(text)) FILTER (role <> 'user'), 0) AS BIGINT) AS input,
       CAST(coalesce(sum(turn) FILTER (role <> 'user'), 0) AS BIGINT) AS output, CAST(0 AS BIGINT) AS cache_read,
       CAST(0 AS BIGINT) AS cache_write, CAST(count(*) FILTER (role <> 'user') AS DECIMAL(18,2)) AS cost,
       CAST(coalesce(sum(length(text) + turn) FILTER (role <> 'user'), 0) AS BIGINT) AS total_tokens
FROM conversations GROUP BY 1""")
def session_stats(spark, root):
    """System turns stand for compaction entries; text length for input tokens."""
    log = table(spark, root, "conversations")
    entries = log.select(
        F.col("conv_id").alias("session"), F.when(F.col("role") == "system", "compaction").otherwise("message").alias("type"),
        "role", F.col("turn").alias("tool_calls"), F.length("text").cast("long").alias("input"), F.col("turn").alias("output"),
        F.lit(None).cast("long").alias("cache_read"), F.lit(0).cast("long").alias("cache_write"),
        F.lit("1").cast("decimal(8,2)").alias("cost"))
    return T.session_stats(entries).withColumn("cost", F.col("cost").cast("decimal(18,2)"))


@query("""
WITH e AS (SELECT user_id AS session, event_type, epoch_us(ts) // 1000 AS ms,
                  lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
SELECT session, CAST(coalesce(sum(ms - previous) FILTER (event_type NOT IN ('click', 'signup') AND ms > previous), 0) AS BIGINT) AS active_ms
FROM e GROUP BY 1""")
def active_time(spark, root):
    """Users are sessions; a click or signup ends a human pause."""
    kind = F.col("event_type")
    entries = table(spark, root, "events").select(
        F.col("user_id").alias("session"), F.lit("message").alias("type"),
        F.when(kind == "click", "user").when(kind == "signup", "bashExecution").otherwise("assistant").alias("role"),
        "ts", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return T.active_time(entries, ["ts", "event_id"])
