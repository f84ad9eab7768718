"""JSON documents as rows, preserved values, and evidence that names them."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from martweave.functions import documents as D
from martweave.operators import catalog as C
from martweave.operators import lineage as L
from tests.conftest import rows


def frame(spark, data):
    return spark.createDataFrame(data, "id int, text string")


def test_flatten_opens_every_level(spark):
    text = '{"a": {"b/c": [1, 2.0, {"x": null}], "~t": "é"}, "n": true, "e": [], "o": {}}'
    got = {r.pointer: (r.kind, r.text) for r in D.flatten(frame(spark, [(1, text), (2, "[1"), (3, None), (4, '{"a": 1, "a": 2}')]), ["id"], "text").collect()}
    assert got == {
        "": ("object", '{"a":{"b/c":[1,2,{"x":null}],"~t":"é"},"e":[],"n":true,"o":{}}'), "/a": ("object", '{"b/c":[1,2,{"x":null}],"~t":"é"}'),
        "/a/b~1c": ("array", '[1,2,{"x":null}]'), "/a/b~1c/0": ("number", "1"), "/a/b~1c/1": ("number", "2"), "/a/b~1c/2": ("object", '{"x":null}'),
        "/a/b~1c/2/x": ("null", "null"), "/a/~0t": ("string", '"é"'), "/n": ("boolean", "true"), "/e": ("array", "[]"), "/o": ("object", "{}")}
    assert D.flatten(frame(spark, []), ["id"], "text").collect() == []


def test_a_wide_and_a_deep_document(spark):
    wide = json.dumps({f"k{i}": i for i in range(20_000)})
    deep = "[" * 40 + "7" + "]" * 40
    got = D.flatten(frame(spark, [(1, wide), (2, deep)]), ["id"], "text").groupBy("id").count()
    assert rows(got) == [(1, 20_001), (2, 41)]


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-3, 3) | st.sampled_from(["", "x", "/", "~"]),
                      lambda v: st.lists(v, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "a/b", "~", "0"]), v, max_size=3), max_leaves=8)


def keeps(old, new):
    if isinstance(old, list):
        return isinstance(new, list) and len(new) >= len(old) and all(map(keeps, old, new))
    if isinstance(old, dict):
        return isinstance(new, dict) and all(k in new and keeps(v, new[k]) for k, v in old.items())
    return type(old) is type(new) and old == new


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(VALUES, VALUES), min_size=60, max_size=60))
def test_preserved_is_what_a_recursive_comparison_says(spark, pairs):
    cases = [*pairs, *[(v, [v]) for v, _ in pairs[:10]], *[([v], [v, w]) for v, w in pairs[:10]], *[({"a": v}, {"a": v, "b": w}) for v, w in pairs[:10]]]
    old = frame(spark, [(i, json.dumps(a)) for i, (a, _) in enumerate(cases)])
    new = frame(spark, [(i, json.dumps(b)) for i, (_, b) in enumerate(cases)])
    got = {r.id: r.preserved for r in C.preserves_existing(old, new, ["id"]).collect()}
    assert got == {i: keeps(a, b) for i, (a, b) in enumerate(cases)}


def test_lost_values_say_where_and_how(spark):
    old = frame(spark, [(1, '{"a": [1, {"b": 2}], "c": {"d": "x"}}'), (2, "{}"), (3, "no json"), (4, "null"), (5, '{"a": 1}')])
    new = frame(spark, [(1, '{"a": [1, {"b": 3, "n": 1}, 9], "c": [1]}'), (2, '{"x": 1}'), (3, "{}"), (4, "{}"), (5, "broken")])
    assert rows(D.lost_values(old, new, ["id"]), "id", "pointer", "finding") == sorted([
        (1, "/a/1/b", "value_changed"), (1, "/c", "kind_changed"), (1, "/c/d", "value_missing"), (3, "", "old_unreadable"), (4, "", "kind_changed"),
        (5, "", "value_missing"), (5, "/a", "value_missing")], key=repr)


STAMPED = [
    ("ownership", {"lastModified": {"t": 1}, "o": 1}, {"lastModified": {"t": 9, "by": "me"}, "o": 1}, []),
    ("ownership", {"lastModified": {"t": 1}}, {"lastModified": {"t": 8, "by": "me"}}, ["/lastModified/t"]),
    ("ownership", {"lastModified": {"t": 1}}, {"lastModified": {"t": 9, "by": "me", "more": 1}}, ["/lastModified/t"]),
    ("ownership", {"lastModified": {"t": 1}}, {"lastModified": {"t": 9}}, ["/lastModified/t"]),
    ("ownership", {"x": {"lastModified": 1}}, {"x": {"lastModified": {"t": 9, "by": "me"}}}, ["/x/lastModified"]),
    ("glossaryTerms", {"auditStamp": 1}, {"auditStamp": {"t": 9, "by": "me"}}, []),
    ("domains", {"auditStamp": 1}, {"auditStamp": {"t": 9, "by": "me"}}, ["/auditStamp"]),
    ("editableSchemaMetadata", {"editableSchemaFieldInfo": [{"glossaryTerms": {"auditStamp": {"t": 1}}}]},
     {"editableSchemaFieldInfo": [{"glossaryTerms": {"auditStamp": {"by": "me", "t": 9}}}, {}]}, []),
]


def test_only_audit_stamps_advance(spark):
    schema = "id int, text string, aspect string, stamp string"
    before = spark.createDataFrame([(i, json.dumps(old), aspect, '{"t": 9, "by": "me"}') for i, (aspect, old, _, _) in enumerate(STAMPED)], schema)
    after = frame(spark, [(i, json.dumps(new)) for i, (_, _, new, _) in enumerate(STAMPED)])
    got = rows(D.lost_values(before, after, ["id"], C.STAMPS), "id", "pointer")
    assert got == sorted((i, p) for i, (_, _, _, lost) in enumerate(STAMPED) for p in lost)


def test_values_at_pointers_that_are_data(spark):
    docs = frame(spark, [(1, '{"a": [10, {"": 1}], "b~c/d": 2}'), (2, "x")])
    asked = spark.createDataFrame([(1, p) for p in ("", "/a/0", "/a/00", "/a/1/", "/a/2", "/b~0c~1d", "/b~2", "a")] + [(2, ""), (3, "/a")], "id int, pointer string")
    got = {(r.id, r.pointer): r.text for r in D.values_at(docs, ["id"], "text", asked).collect()}
    assert got == {(1, ""): '{"a":[10,{"":1}],"b~c/d":2}', (1, "/a/0"): "10", (1, "/a/00"): None, (1, "/a/1/"): "1", (1, "/a/2"): None,
                   (1, "/b~0c~1d"): "2", (1, "/b~2"): None, (1, "a"): None, (2, ""): None, (3, "/a"): None}


def test_evidence_rules(spark):
    corpus = spark.createDataFrame([("a.json", '{"x": [1]}'), ("b.txt", "one\ntwo")], "path string, text string")
    sha = dict(corpus.select("path", F.sha2("text", 256)).collect())
    schema = "source_id int, candidate_id string, path string, file_sha256 string, start_line int, end_line int, scope_id string, pointer string"
    evidence = spark.createDataFrame([
        (1, "ok", "a.json", sha["a.json"], 1, 1, "s", "/x/0"), (1, "whole", "a.json", sha["a.json"], 1, 1, "s", ""), (1, "none", "b.txt", sha["b.txt"], 2, 2, "s", None),
        (1, "scope", "b.txt", sha["b.txt"], 1, 2, "other", None), (1, "scope", "b.txt", sha["b.txt"], 1, 2, None, None),
        (1, "escape", "a.json", sha["a.json"], 1, 1, "s", "/x~"), (1, "index", "a.json", sha["a.json"], 1, 1, "s", "/x/-"),
        (1, "plain", "b.txt", sha["b.txt"], 1, 1, "s", "/x"), (1, "lost", "c", "z", 5, 1, "other", "/x")], schema)
    subjects = spark.createDataFrame([(1, "ok"), (1, "bare"), (2, "ok"), (2, "ok")], "source_id int, candidate_id string")
    found = L.evidence_findings(evidence, corpus, ["source_id", "candidate_id"], "s", subjects)
    assert rows(found, "source_id", "candidate_id", "rule") == sorted([
        (1, "scope", "evidence_scope_mismatch"), (1, "scope", "evidence_scope_mismatch"), (1, "escape", "evidence_pointer_invalid"),
        (1, "index", "evidence_pointer_invalid"), (1, "plain", "evidence_pointer_invalid"), (1, "lost", "evidence_path_unknown"),
        (1, "bare", "missing_evidence"), (2, "ok", "missing_evidence")], key=repr)
