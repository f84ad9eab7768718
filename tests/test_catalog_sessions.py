"""Catalog, governance, screening and session rules on small records."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from martweave.functions import scalars as S
from martweave.operators import catalog as C
from martweave.operators import lineage as L
from martweave.operators import sessions as T
from martweave.sources import declared, readers
from tests.conftest import rows, rules


def test_names_are_normalized_before_comparison(spark):
    terms = spark.createDataFrame(
        [("1", "term", "Ｎｅｔ  Sales", "p"), ("2", "term", "net sales ", "p"), ("3", "term", "NET SALES", "q"), ("4", "tag", "net sales", None)],
        "urn string, kind string, name string, parent string")
    got = rows(C.find_duplicate_terms(terms), "urn", "duplicates", "same_name_other_hierarchy")
    assert got == [("1", 1, 1), ("2", 1, 1), ("3", 0, 2)]


def test_associations_keep_order(spark):
    current = spark.createDataFrame([("a", "tag", v, i) for i, v in enumerate("xyz")], "asset string, kind string, value string, position int")
    schema = "asset string, kind string, operation string, value string, seq long"

    def apply(*changes):
        got = C.apply_associations(current, spark.createDataFrame(changes, schema))
        return [v for _, v in sorted(rows(got, "position", "value"))]

    assert apply(("a", "tag", "add", "b", 0), ("a", "tag", "add", "y", 1), ("a", "tag", "remove", "x", 2)) == ["y", "z", "b"]
    assert apply(("a", "tag", "set", "q", 0), ("a", "tag", "set", "z", 1), ("a", "tag", "set", "x", 2)) == ["x", "z", "q"]


def test_conflicting_candidates(spark):
    df = spark.createDataFrame(
        [("a", "f", "tag", "add", "1"), ("a", "f", "tag", "remove", "2"), ("b", "f", "tag", "add", "1"), ("b", "f", "tag", "remove", "1"),
         ("c", "f", "tag", "set", "1"), ("c", "f", "tag", "add", "2"), ("d", "f", "description", "set", "1"), ("d", "f", "description", "set", "2"),
         ("e", "f", "property", "set", "1"), ("e", "f", "property", "set", "2")],
        "asset string, field string, kind string, operation string, value string")
    assert dict(rows(C.candidate_conflicts(df), "asset", "reason")) == {
        "b": "repeated_member", "c": "competing_set", "d": "two_values_for_scalar"}


def test_domains_manual_first(spark):
    df = spark.createDataFrame([("a", "d1", 0, True), ("a", "d2", 1, None), ("a", "d3", 2, True), ("a", "d4", 3, False)],
                               "asset string, domain string, position int, propagated boolean")
    assert [d for _, d in sorted(rows(C.order_domains(df), "position", "domain"))] == ["d2", "d4", "d1", "d3"]


def test_scope_rules_and_fingerprint(spark):
    members = spark.createDataFrame([("a",), ("b",), ("c",)], "urn string")
    datasets = spark.createDataFrame([("a", False, "r", "1"), ("b", True, "old", "1")], "urn string, removed boolean, run_id string, schema_version string")
    fields = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "")], "urn string, path string")
    assert rules(C.scope_violations(members, datasets, fields, "r")) == {
        "member_missing", "member_removed", "not_latest_run", "duplicate_field", "empty_field_path"}
    one = C.scope_fingerprint(members, datasets, fields).first()
    assert one == C.scope_fingerprint(members, datasets.orderBy(F.desc("urn")), fields.repartition(3)).first()
    other = C.scope_fingerprint(members, datasets.withColumn("schema_version", F.lit("2")), fields).first()
    assert one["fingerprint"] != other["fingerprint"]


def test_accounting_of_a_complete_scope(spark):
    fields = spark.createDataFrame([("a", "x")], "asset string, field string")
    done = spark.createDataFrame([("a", "x"), ("a", None)], "asset string, field string")
    assert rows(C.scope_accounting(fields, done, spark.range(0))) == [(2, 2, 0, 0, "SCOPE_ACCOUNTED_WITH_ITEM_RECEIPTS")]
    assert rows(C.missing_targets(fields, done.filter("field IS NOT NULL"))) == [("a", None)]


def test_descriptions_with_two_statements(spark):
    key = "asset string, field string"
    targets = spark.createDataFrame([("a", "1", None), ("a", "2", "m"), ("a", "3", None), ("a", "4", "h")], f"{key}, before string")
    said = spark.createDataFrame([("a", "1", "m"), ("a", "1", "n"), ("a", "2", " m "), ("a", "3", "m"), ("a", "3", "m "), ("a", "4", "m")], f"{key}, text string")
    prior = spark.createDataFrame([("a", "4", "VERIFIED_AGENT_BASELINE", True)], f"{key}, status string, schema_unchanged boolean")
    allowed = targets.select("asset", "field")
    got = rows(C.plan_descriptions(targets, said, prior, allowed, agent_updates=True), "field", "disposition", "routing")
    assert got == [("1", "AMBIGUOUS_MEANING", "NEEDS_EVIDENCE"), ("2", "KEEP", "NO_WRITE"), ("3", "ADD", "OPERATOR_POLICY"),
                   ("4", "UPDATE_AGENT", "OPERATOR_POLICY")]


def test_metric_lines(spark):
    text = "- `Net = sum(x)` more\r\n- `Other = 12`\n- `net = ab`\n x - `Net = sum(x)`"
    docs = spark.createDataFrame([("d", "p", text), ("other", "p", text)], "dataset string, path string, text string")
    fields = spark.createDataFrame([("d", "NET")], "dataset string, field string")
    assert rows(C.extract_metric_statements(docs, fields), "field", "line_number", "statement") == [("NET", 1, "Net = sum(x)")]


def test_secrets(spark):
    positive = [
        'password = "hunter2"', '{"token": "abc"}', "password: hunter2", "Driver=x;PWD=hunter2;", "https://user:pw@host/x",
        "-----BEGIN RSA PRIVATE KEY-----"]
    negative = ['password = ""', 'token: "${TOKEN}"', "password: ${DB_PASSWORD}\t", "secret: null", ";PWD=${PW};", "https://host/x", "api_key:"]
    docs = spark.createDataFrame(list(enumerate(positive + negative)), "doc_id int, text string")
    hits = {r[0] for r in rows(T.screen_secrets(docs), "doc_id")}
    assert hits == set(range(len(positive)))


def test_active_time(spark):
    log = [("message", 1000, "user"), ("message", 4000, "assistant"), ("message", 7000, "toolResult"), ("message", 9000, "assistant")]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(log)] + [(2, 0, "message", 5, "user"), (2, 1, "label", 9, None)],
                               "session int, position int, type string, at_ms long, role string")
    assert rows(T.active_time(df, ["position"])) == [(1, 8000), (2, 0)]


def test_session_stats_count_compaction_usage(spark):
    df = spark.createDataFrame(
        [("s", "message", "user", None, 5, 5), ("s", "message", "assistant", 2, 10, 3), ("s", "compaction", None, None, 7, 1),
         ("s", "message", "toolResult", None, 1, 1), ("s", "label", None, None, 100, 100)],
        "session string, type string, role string, tool_calls int, input int, output int").withColumns(
        {"cache_read": F.lit(0), "cache_write": F.lit(None).cast("int"), "cost": F.lit(1)})
    got = T.session_stats(df).first().asDict()
    assert (got["user_messages"], got["assistant_messages"], got["tool_calls"], got["tool_results"], got["total_messages"]) == (1, 1, 2, 1, 3)
    assert (got["input"], got["output"], got["total_tokens"], got["cost"]) == (18, 5, 23, 3)


def test_snippet_edges(spark):
    text = "x" * 100 + " Needle\n " + "y" * 100
    df = spark.createDataFrame([(text,), ("needle",), ("none",)], "t string")
    got = [tuple(r) for r in df.select(*S.snippet(F.col("t"), "needle")).collect()]
    assert got[0] == ("..." + "x" * 79 + " ", "Needle", " " + "y" * 78 + "...")
    assert got[1] == ("", "needle", "") and got[2] == (None, None, None)


def test_search_limits_and_literal_match(spark):
    log = spark.createDataFrame([(i, 0, "user", "a.b (x)", i) for i in range(35)] + [(99, 0, "system", "a.b", 99), (98, 0, "user", "aXb", 98)],
                                "session int, position int, role string, text string, modified int")
    hits, flag = T.search_conversations(log, " A.B ")
    assert [r["session"] for r in hits.collect()] == list(range(34, 4, -1)) and flag.first()["truncated"]
    with pytest.raises(ValueError):
        T.search_conversations(log, " ")


def test_json_pointer(spark):
    df = spark.createDataFrame([('{"a/b": {"~": [1, null]}}',)], "t string")
    at = lambda p: df.select(S.json_at(F.col("t"), p)).first()[0]
    assert (at("/a~1b/~0/0"), at("/a~1b/~0/1"), at("/a~1b/~0/2"), at("/zz")) == ("1", "null", None, None)


def test_urn_needs_exactly_three_parts(spark):
    df = spark.createDataFrame([("urn:li:dataset:(urn:li:dataPlatform:mssql,db.s.T,PROD)",), ("urn:li:dataset:(urn:li:dataPlatform:mssql,a,b,PROD)",), ("x",)], "u string")
    got = [tuple(r) for r in df.select(*S.parse_urn(F.col("u"))).collect()]
    assert got == [("mssql", "db.s.T", "PROD"), (None, None, None), (None, None, None)]


def test_api_document(spark):
    doc = ('{"openapi":"3.0.3","paths":{"/orders/{id}":{"get":{"responses":{"200":{"content":{"application/json":{"schema":{"type":"object"}}}}}},'
           '"post":{"requestBody":{"content":{"application/json":{"schema":{}}}},"responses":{"204":{}}}}}}')
    docs = spark.createDataFrame([("d", doc), ("bad", "{}"), ("broken", "{")], "path string, text string")
    assert rows(declared.explode_api_specs(docs), "doc", "method", "role", "media", "reason") == [
        ("bad", None, None, None, "document_unsupported"), ("broken", None, None, None, "document_unsupported"),
        ("d", "get", "response:200", "application/json", None), ("d", "post", "request", "application/json", None),
        ("d", "post", "response:204", None, None)]


def test_manifest_digest_is_order_free(spark):
    docs = spark.createDataFrame([(str(i), "t" * i) for i in range(20)], "p string, t string")
    digest = lambda d: readers.manifest_digest(readers.corpus_manifest(d, F.col("p"), F.col("t"))).first()
    assert digest(docs) == digest(docs.repartition(5).orderBy(F.desc("p")))
    assert digest(docs) != digest(docs.filter("p <> '3'"))


def test_analyzer_records(spark):
    def analyze(frame):
        return pd.DataFrame([{"record": "node", "path": p, "kind": "asset", "local_id": p, "name": t} for p, t in zip(frame.path, frame.text)])

    g = T.analyze_corpus(spark.createDataFrame([("a", "x"), ("b", "y")], "path string, text string"), analyze)
    assert rows(g["nodes"], "local_id", "name") == [("a", "x"), ("b", "y")] and g["edges"].count() == 0


def test_batches_are_bounded_by_bytes():
    import pyarrow as pa

    texts = ["a" * 10, "b" * 25, None, "c" * 5, "d" * 100, "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["path", "text"])
    parts = [p.column(0).to_pylist() for p in T.byte_slices(batch, 1, 40)]
    assert parts == [[0, 1, 2, 3], [4], [5]]
    assert list(T.byte_slices(batch.slice(0, 0), 1, 40)) == []


def test_an_analyzer_is_checked(spark):
    docs = spark.createDataFrame([("a", "one\ntwo"), ("b", '{"x": 1}')], "path string, text string")

    def sound(path, text):
        node = T.node_ref("s", "asset", path)
        yield {"record": "coverage", "state": "analyzed"}
        yield {"record": "node", "id": node, "kind": "asset", "local_id": path}
        yield {"record": "evidence", "id": node, "start_line": 1, "end_line": text.count("\n") + 1, "pointer": "/x" if path == "b" else None}

    g = T.analyze_graph(docs, "s", sound, batch_bytes=1)
    assert g["violations"].collect() == [] and g["complete"].first()["complete"] and g["nodes"].count() == 2

    def faulty(path, text):
        for r in sound(path, text):
            if r["record"] == "evidence":
                r["pointer"] = "/none"
            if r["record"] != "coverage" or path == "a":
                yield {**r, "id": "x" + r["id"]} if r["record"] == "node" else r

    got = T.analyze_graph(docs, "s", faulty)
    assert rules(got["violations"]) == {"identity_mismatch", "file_not_covered", "evidence_pointer_invalid", "missing_evidence"}
    assert not got["complete"].first()["complete"]


def test_one_answer_for_a_whole_set(spark):
    rows_ = spark.createDataFrame([("BOUND_SELECTED_WRITE",), ("UNRESOLVED_SELECTED_SOURCE",)], "disposition string")
    assert {r.complete for r in L.source_coverage_counts(rows_).collect()} == {False}
    sound, open_ = rows_.limit(0).unionByName(rows_.filter("disposition = 'BOUND_SELECTED_WRITE'")), spark.createDataFrame([("CATALOG_BOUND",), (None,)], "status string")
    assert [r.complete for r in L.source_coverage_counts(sound).collect()] == [True]
    assert [r.complete for r in L.source_coverage_counts(sound, open_).collect()] == [False]
    assert [r.complete for r in L.source_coverage_counts(sound, open_.filter("status IS NOT NULL"), rows_).collect()] == [False]
    kinds = spark.createDataFrame([("CONSTANT",)], "classification string")
    assert L.classification_counts(kinds).first()["complete"] and not L.classification_counts(kinds, rows_).first()["complete"]


def test_allowlist_patterns_must_be_anchored(spark):
    df = spark.createDataFrame([("a.b",), ("xa.b",)], "name string")
    assert rows(readers.allowlist_tables(df, "name", [r"^a\.b$"])) == [("a.b",)]
    with pytest.raises(ValueError):
        readers.allowlist_tables(df, "name", ["a"])


def test_names_with_blanks_of_all_kinds(spark):
    df = spark.createDataFrame([("\u2028Net \u1680\u00a0 Sales\ufeff",), ("\ufb01\u3000X",), (None,), ("",)], "n string")
    assert [r[0] for r in df.select(S.normalize_name(F.col("n"))).collect()] == ["net sales", "fi x", None, ""]
