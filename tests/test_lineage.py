"""Graph rules and traversals against brute force on small random graphs."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from martweave.operators import lineage as L
from tests.conftest import rows, rules

NODE = "id string, kind string, local_id string, owner string, fields array<struct<path:string,native_type:string>>"
EDGE = "edge_id string, kind string, sources array<struct<node:string,field:string>>, target struct<node:string,field:string>"


def node(spark, kind, local):
    return spark.range(1).select(L.node_id("s", F.lit(kind), F.lit(local))).first()[0]


@pytest.fixture(scope="module")
def graph(spark):
    a, o = node(spark, "asset", "t"), node(spark, "operation", "f")
    p, q = node(spark, "port", "t:out"), node(spark, "port", "f:in")
    nodes = [(a, "asset", "t", None, None), (o, "operation", "f", None, None), (p, "port", "t:out", a, [("x", "int")]),
             (q, "port", "f:in", o, [("y", "int")])]
    edges = [("1", "reads", [(a, None)], (o, None)), ("2", "value_dependency", [(p, "x")], (q, "y"))]
    return nodes, edges, (a, o, p, q)


def check(spark, nodes, edges):
    return rules(L.validate_graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), "s"))


def test_valid_graph(spark, graph):
    assert check(spark, *graph[:2]) == set()


@pytest.mark.parametrize("fault, rule", [
    (lambda n, e, i: (n + n[:1], e), "duplicate_node"),
    (lambda n, e, i: ([("node_x", "asset", "z", None, None)] + n, e), "identity_mismatch"),
    (lambda n, e, i: (n[:2] + [n[2][:3] + (i[3], n[2][4]), n[3]], e), "port_owner_invalid"),
    (lambda n, e, i: (n[:2] + [n[2][:4] + ([("x", "int"), ("x", "int")],), n[3]], e), "duplicate_field"),
    (lambda n, e, i: (n, [("1", "reads", [("gone", None)], (i[1], None))]), "dangling_edge"),
    (lambda n, e, i: (n, [("2", "value_dependency", [(i[2], "zz")], (i[3], "y"))]), "unknown_field"),
    (lambda n, e, i: (n, [("2", "condition_dependency", [(i[0], None)], (i[3], "y"))]), "value_edge_requires_ports"),
    (lambda n, e, i: (n, [("1", "reads", [(i[0], None), (i[1], None)], (i[1], None))]), "structural_edge_invalid"),
    (lambda n, e, i: (n, [("1", "writes", [(i[2], "x")], (i[1], None))]), "structural_edge_invalid"),
])
def test_each_graph_fault(spark, graph, fault, rule):
    assert check(spark, *fault(*graph)) == {rule}


def random_edges(seed, nodes=30, edges=45):
    rnd = random.Random(seed)
    return sorted({(f"n{rnd.randrange(nodes)}", f"n{rnd.randrange(nodes)}") for _ in range(edges)})


def reach(edges, start):
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    seen, todo = set(), deque(out[start])
    while todo:
        n = todo.popleft()
        if n not in seen:
            seen.add(n)
            todo.extend(out[n])
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_against_brute_force(spark, seed):
    edges = random_edges(seed)
    got = rows(L.edges_on_cycles(spark.createDataFrame(edges, "src string, dst string")))
    assert got == sorted((a, b, a == b or a in reach(edges, b)) for a, b in edges)


def test_no_cycles(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c")]
    assert not any(r[2] for r in rows(L.edges_on_cycles(spark.createDataFrame(edges, "src string, dst string"))))


@pytest.mark.parametrize("direction", ["DOWNSTREAM", "UPSTREAM"])
def test_walk_against_brute_force(spark, direction):
    edges = random_edges(3)
    turned = edges if direction == "DOWNSTREAM" else [(b, a) for a, b in edges]
    df = spark.createDataFrame(edges, "src string, dst string").withColumn("relationship", F.lit("r"))
    start = edges[0][0 if direction == "DOWNSTREAM" else 1]
    distance, todo = {start: 0}, deque([start])
    while todo:
        n = todo.popleft()
        for a, b in turned:
            if a == n and b not in distance:
                distance[b] = distance[n] + 1
                todo.append(b)
    walk = L.lineage_walk(df, start, direction)
    assert {n: d for n, d in rows(walk, "node", "distance")} == distance
    far = max(distance, key=distance.get)
    path = L.walk_path(walk, far)
    assert path[0] == start and path[-1] == far and len(path) == distance[far] + 1
    assert all((a, b) in set(turned) for a, b in zip(path, path[1:]))
    assert L.walk_path(walk, "missing") == []


def test_walk_goes_on_to_the_end(spark):
    edges = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(30)], "src string, dst string")
    assert L.lineage_walk(edges, "c0", "DOWNSTREAM").count() == 31


def test_long_ring_and_long_chain(spark):
    ring = [(f"r{i:04}", f"r{(i + 1) % 1000:04}") for i in range(1000)]
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(500)] + [("c500", "r0000"), ("x", "x")]
    got = rows(L.edges_on_cycles(spark.createDataFrame(ring + chain, "src string, dst string")))
    assert {r[:2] for r in got if r[2]} == {*ring, ("x", "x")} and len(got) == 1502


@pytest.mark.parametrize("shared", [False, True])
def test_cycle_rounds_work_on_numbers_unless_nodes_share_them(spark, monkeypatch, shared):
    if shared:
        monkeypatch.setattr(L, "_number", lambda node: F.length(node).cast("long"))
    kinds = []
    real = L._strong_parts
    monkeypatch.setattr(L, "_strong_parts", lambda edges: kinds.append(edges.schema["src"].dataType.typeName()) or real(edges))
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("dd", "d"), ("d", "e"), ("e", "d"), ("f", "f")]
    got = rows(L.edges_on_cycles(spark.createDataFrame(edges, "src string, dst string")))
    assert got == sorted((a, b, (a, b) not in [("c", "d"), ("dd", "d")]) for a, b in edges)
    assert kinds == ["struct" if shared else "long"]


def test_nearest_parent_with_cycle_and_long_chain(spark):
    chain = [(i, i - 1 if i else None, i % 10 == 0) for i in range(100)]
    ring = [(200, 201, True), (201, 200, True), (202, 201, True)]
    outside = [(300, 999, True)]
    df = spark.createDataFrame(chain + ring + outside, "node long, parent long, listed boolean")
    got = dict(rows(L.nearest_parent(df)))
    assert got[0] is None and got[10] == 0 and got[11] == 10 and got[99] == 90
    assert got[200] is None and got[202] is None and got[300] is None


def test_hidden_member_removes_the_whole_group(spark):
    members = spark.createDataFrame(
        [(1, "upstream", "d", "a"), (1, "upstream", "d", "hidden"), (1, "downstream", "t", "z"),
         (2, "upstream", "d", "a"), (2, "downstream", "t", "z"), (3, "upstream", "d", "a")],
        "group_id int, side string, dataset string, field string")
    visible = spark.createDataFrame([("d", "a"), ("t", "z")], "dataset string, field string")
    assert {r[0] for r in rows(L.complete_groups(members, visible), "group_id")} == {2}
    assert L.column_lineage(members, visible, "t", "z", "UPSTREAM").count() == 2
    assert L.column_lineage(members, visible, "t", "z", "DOWNSTREAM").count() == 0


def test_candidate_statuses(spark):
    data = [("s1", "c1", "asset", "resolved", "x"), ("s2", "c1", "asset", "inferred", "x"), ("s3", "c1", "relationship", "resolved", None),
            ("s4", "c1", "unresolved", "unresolved", "x"), ("s5", "c1", "asset", "resolved", "x"), ("s5", "c1", "asset", "resolved", "x")]
    df = spark.createDataFrame(data, "source_id string, candidate_id string, kind string, status string, object string").withColumn(
        "attributes", F.create_map(F.lit("relation_type"), F.lit("reads")))
    none = spark.createDataFrame([], "source_id string, candidate_id string, reason string")
    status = dict(rows(L.validate_candidates(df, none)[1], "source_id", "status"))
    assert status == {"s1": "PASS", "s2": "INCONCLUSIVE", "s3": "FAIL", "s4": "INCONCLUSIVE", "s5": "FAIL"}


def test_candidates_meet_findings_without_join_or_sort(spark):
    data = [("s1", "c1", "asset", "resolved", "x"), ("s1", "c2", "process", "inferred", "x"), ("s2", "c1", "asset", "resolved", "x"), ("s3", "c1", None, "unresolved", "x")]
    df = spark.createDataFrame(data, "source_id string, candidate_id string, kind string, status string, object string").withColumn(
        "attributes", F.create_map(F.lit("relation_type"), F.lit("reads")))
    found = spark.createDataFrame([("s2", "c1", "r"), ("s2", "c1", "r2"), ("s9", "c9", "r")], "source_id string, candidate_id string, reason string")
    single, report = L.validate_candidates(df, found)
    assert rows(single) == [("s1", "c1", "publishable"), ("s1", "c2", "held"), ("s2", "c1", "rejected"), ("s3", "c1", "held")]
    assert rows(report) == [("s1", "INCONCLUSIVE", 2, 1, 0), ("s2", "FAIL", 0, 0, 0), ("s3", "PASS", 1, 0, 0)]
    plan = single._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "SortAggregate" not in plan


def test_evidence_meets_files_and_pointers_in_one_join(spark):
    corpus = spark.createDataFrame([("a", '{"x":1}'), ("b", "no json"), (None, "{}")], "path string, text string")
    asked = [(1, "a", "/x"), (2, "a", "/y"), (3, "a", "~"), (4, "a", None), (5, "b", "/x"), (6, "z", "/x"), (7, "a", ""), (8, None, "/x"), (9, None, None)]
    evidence = spark.createDataFrame(asked, "subject int, path string, pointer string").join(
        corpus.select("path", F.sha2("text", 256).alias("file_sha256")), "path", "left").withColumns({"start_line": F.lit(1), "end_line": F.lit(1)})
    found = L.evidence_findings(evidence, corpus, subjects=spark.createDataFrame([(1,), (10,)], "subject int"))
    assert rows(found, "subject", "rule") == [
        (10, "missing_evidence"), (2, "evidence_pointer_invalid"), (3, "evidence_pointer_invalid"), (5, "evidence_pointer_invalid"),
        (6, "evidence_path_unknown"), (8, "evidence_path_unknown"), (9, "evidence_path_unknown")]
    plan = L.evidence_findings(evidence, corpus)._jdf.queryExecution().optimizedPlan().toString()
    assert "<=> _pointer" in plan


def test_dependencies_count_only_earlier_writes_of_others(spark):
    steps = spark.createDataFrame(
        [("a", 1, "writes", "d"), ("b", 2, "reads", "d"), ("b", 3, "writes", "d"), ("a", 4, "reads", "d"), ("c", 1, "reads", "d")],
        "job string, step int, relation string, dataset string")
    got = rows(L.job_dependencies(steps), "job", "step", "writes_before", "depends_on_writes")
    assert got == [("a", 1, None, None), ("a", 4, 2, 1), ("b", 2, 1, 1), ("b", 3, None, None), ("c", 1, 0, 0)]
    # The pairs can be rebuilt from the output.
    out = L.job_dependencies(steps).collect()
    writes = {r.write_number: r.job for r in out if r.relation == "writes"}
    pairs = {(writes[n], r.job) for r in out if r.relation == "reads" for n in range(1, r.writes_before + 1) if writes[n] != r.job}
    assert pairs == {("a", "b"), ("b", "a")}


def test_null_parts_of_a_group_key_differ(spark):
    data = [("c1", None, "x", "p", 1, 2), ("c2", "x", None, "p", 3, 4)]
    df = spark.createDataFrame(data, "candidate_id string, method string, attributes string, path string, line int, end_line int")
    groups, _, members = L.finding_groups(df)
    assert groups.select("group_id").distinct().count() == 2 and members.select("group_id").distinct().count() == 2


def test_a_port_listed_twice_has_no_duplicate_fields(spark):
    data = [("i", "port", "l", "o", [("a", "int"), ("b", "int")])] * 2 + [("j", "port", "l", "o", [("a", "int"), ("a", "int")])]
    nodes = spark.createDataFrame(data, "id string, kind string, local_id string, owner string, fields array<struct<path:string,native_type:string>>")
    edges = spark.createDataFrame([], "edge_id string, kind string, sources array<struct<node:string,field:string>>, target struct<node:string,field:string>")
    found = rows(L.validate_graph(nodes, edges, "s").filter("rule = 'duplicate_field'"), "key")
    assert len(found) == 1 and "j" in found[0][0]


def test_a_source_without_candidates_is_inconclusive(spark):
    df = spark.createDataFrame([], "source_id string, candidate_id string, kind string, status string, object string").withColumn(
        "attributes", F.create_map(F.lit("relation_type"), F.lit("reads")))
    none = spark.createDataFrame([], "source_id string, candidate_id string, reason string")
    report = L.validate_candidates(df, none, spark.createDataFrame([("s",)], "source_id string"))[1]
    assert rows(report) == [("s", "INCONCLUSIVE", 0, 0, 0)]


def test_coverage_and_evidence(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    coverage = spark.createDataFrame([("a", "analyzed"), ("a", "analyzed"), ("b", "unsupported"), ("x", "analyzed")], "path string, state string")
    none = spark.createDataFrame([], "path string, code string")
    assert rules(L.validate_coverage(files, coverage, none)) == {
        "file_not_covered", "file_covered_twice", "covered_file_unknown", "unsupported_without_finding"}
    corpus = spark.createDataFrame([("a", "1\n2\n3")], "path string, text string")
    sha = corpus.select(F.sha2("text", 256)).first()[0]
    evidence = spark.createDataFrame(
        [(1, "a", sha, 1, 3), (2, "a", sha, 0, 1), (3, "a", sha, 2, 4), (4, "a", "bad", 1, 1), (5, "zz", sha, 1, 1)],
        "subject int, path string, file_sha256 string, start_line int, end_line int")
    got = rows(L.validate_evidence(evidence, corpus), "rule", "key")
    assert got == [("evidence_digest_mismatch", "4/a"), ("evidence_line_out_of_range", "2/a"),
                   ("evidence_line_out_of_range", "3/a"), ("evidence_path_unknown", "5/zz")]


def test_merge_ignores_upstream_order(spark):
    schema = "upstream_type string, downstream_type string, upstreams array<string>, downstreams array<string>"
    current = spark.createDataFrame([("FIELD_SET", "FIELD", ["a", "b"], ["z"])], schema)
    desired = spark.createDataFrame([("FIELD_SET", "FIELD", ["b", "a"], ["z"]), ("FIELD_SET", "FIELD", ["a"], ["z"])], schema)
    assert rows(L.merge_lineage(current, desired), "upstreams", "origin") == [(["a", "b"], "current"), (["a"], "added")]


@pytest.mark.parametrize("identifier, status", [
    ("T", "CATALOG_BOUND"), ("DM.T", "CATALOG_BOUND"), ("[dm].[T]", "CATALOG_BOUND"), ('Mart."dm".T', "CATALOG_BOUND"),
    ("Other.dm.T", "database_outside_host_scope"), ("[T", "unsupported_sql_identifier"), ("#T", "unsupported_sql_identifier"),
    ("a.b.c.d", "unsupported_sql_identifier"), ("dm.U", "dataset_outside_host_allowlist"), ("dm.gone", "catalog_status_missing_or_removed"),
    ("dm.nokey", "catalog_key_missing"), ("dm.empty", "catalog_schema_missing_or_empty")])
def test_binding_of_identifiers(spark, identifier, status):
    urn = "urn:li:dataset:(urn:li:dataPlatform:mssql,mart.dm.{},PROD)".format
    refs = spark.createDataFrame([(1, "p", identifier)], "ref_id int, process string, identifier string")
    scopes = spark.createDataFrame([("p", "s", "Mart", "dm", "PROD", True)],
                                   "process string, scope_id string, database string, default_schema string, env string, lowercase boolean")
    allowed = spark.createDataFrame([("s", urn(n)) for n in ("t", "gone", "nokey", "empty")], "scope_id string, urn string")
    catalog = spark.createDataFrame([(urn("t"), False, 2), (urn("gone"), True, 2), (urn("empty"), False, 0), (urn("u"), False, 2)],
                                    "urn string, removed boolean, field_count int")
    row = L.bind_tables(refs, scopes, allowed, catalog).first()
    assert (row["reason"] or row["status"]) == status


def test_wide_edges_keep_their_evidence(spark):
    wide = [f"f{i}" for i in range(40)]
    edges = spark.createDataFrame(
        [(1, "FIELD_SET", "FIELD", wide, ["d"], 1.0, "T"), (2, "FIELD_SET", "FIELD", [], ["d"], 1.0, "T"), (3, "FIELD_SET", "FIELD", ["f1", "f1"], ["d"], 1.0, "T")],
        "edge_id long, upstream_type string, downstream_type string, upstreams array<string>, downstreams array<string>, confidence double, transform string")
    approved = spark.createDataFrame([(f,) for f in [*wide, "d"]], "field string")
    got = {r.edge_id: r.omitted for r in L.lineage_evidence(edges, approved).collect()}
    assert got[1] is None and got[2] == got[3] == "shape_unsupported"


def test_graph_nodes_are_not_broadcast_by_the_size_they_come_from(spark):
    # Few rows become many nodes with long identities: what the planner guesses is far too small.
    many = spark.range(20).select(F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("i"), "id").select(
        F.concat_ws("-", "id", "i").alias("local_id"), F.lit("port").alias("kind"))
    nodes = many.select(L.node_id("s", F.col("kind"), F.col("local_id")).alias("id"), "kind", "local_id", F.concat(F.lit("gone"), "local_id").alias("owner"),
                        F.expr("array(named_struct('path', 'f1', 'native_type', 'int'))").alias("fields"))
    end = lambda field: F.struct(F.col("id").alias("node"), F.lit(field).alias("field"))
    edges = nodes.select(F.col("local_id").alias("edge_id"), F.lit("value_dependency").alias("kind"), F.array(end("f1")).alias("sources"), end("f2").alias("target"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
    try:
        found = L.validate_graph(nodes, edges, "s")
        assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert {(r["rule"], r["count"]) for r in found.groupBy("rule").count().collect()} == {("port_owner_invalid", 20000), ("unknown_field", 20000)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_job_steps_are_spread_before_they_are_counted(spark):
    steps = spark.createDataFrame([("j", "reads", "d", 1), ("j", "reads", "d", 1), ("j", "reads", "d", 3)], "job string, relation string, dataset string, step int")
    io = L.job_io(steps)
    assert rows(io) == [("j", "reads", "d", 2, 1, 3)]
    plan = io._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan[plan.rindex("Exchange hashpartitioning"):]


def test_jobs_name_all_their_steps(spark):
    data = [("j", "reads", "d", s) for s in (10, 3, 1, 3, None)] + [("j", "writes", "d", 3), ("k", "reads", "d", 7), ("k", "reads", "e", None)] + [
        ("hot", "writes", "d", s % 5000) for s in range(20000)]
    io = L.job_io(spark.createDataFrame(data, "job string, relation string, dataset string, step int"), ids=True)
    assert io._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert rows(io) == sorted([("j", "reads", "d", 3, 1, 10, [1, 3, 10]), ("j", "writes", "d", 1, 3, 3, [3]), ("k", "reads", "d", 1, 7, 7, [7]),
                               ("k", "reads", "e", 0, None, None, []), ("hot", "writes", "d", 5000, 0, 4999, list(range(5000)))], key=repr)
