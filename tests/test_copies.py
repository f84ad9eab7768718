"""Copies of tables, sets of upstreams, file lists and paths of walks."""

import random

import pytest
from pyspark.sql import functions as F

from martweave.functions.scalars import finish_digest, set_digest
from martweave.operators import copies
from martweave.operators import lineage as L
from tests.conftest import rows

SCHEMA = "k long, `a.b` string, c double, d array<int>"


def test_copies_differ_where_rows_do(spark):
    data = [(i, f"v{i % 7}", i / 3, [i, None]) for i in range(500)] + [(None, "n", None, None), (7, "twice", 1.0, []), (7, "twice", 1.0, [])]
    left = spark.createDataFrame(data, SCHEMA)
    assert copies.compare_copies(left, left.repartition(7).orderBy(F.desc("k")), ["k"]).collect() == []
    other = [r for r in data if r[0] != 3] + [(900, "new", 0.0, []), (7, "twice", 1.0, [])]
    other = [(k, None if k == 11 else b, c, [1] if k == 12 else d) for k, b, c, d in other]
    got = copies.compare_copies(left, spark.createDataFrame(other, SCHEMA).select("d", "k", "`a.b`", "c"), ["k"], levels=2)
    assert rows(got) == sorted([(3, 1, 0, "missing"), (900, 0, 1, "extra"), (7, 3, 4, "changed"), (11, 1, 1, "changed"), (12, 1, 1, "changed")], key=repr)
    nulls = spark.createDataFrame([(None, "m", None, None)], SCHEMA)
    assert rows(copies.compare_copies(nulls, nulls.limit(0), ["k"])) == [(None, 1, 0, "missing")]
    with pytest.raises(ValueError):
        copies.compare_copies(left, left.drop("c"), ["k"])


def test_only_differing_leaves_are_opened(spark):
    left = spark.range(3000).withColumn("v", F.lit(1))
    right = left.withColumn("v", F.when(F.col("id") == 42, 2).otherwise(1))
    trees = [copies.digest_tree(df, ["id"]) for df in (left, right)]
    assert trees[0].filter("level = 0").first()["rows"] == 3000
    leaf = left.filter("id = 42").select(copies.leaf_of(["id"])).first()[0]
    assert [r["node"] for r in copies.differing_leaves(*trees).collect()] == [leaf]
    assert copies.differing_leaves(trees[0], trees[0]).collect() == []


def test_cells_cannot_be_taken_for_separators(spark):
    pairs = [[("a", "␟b")], [("a␟", "b")], [("a", None)], [("a", "␀")], [("a", "null")], [('a","b', None)], [("a", "")]]
    digests = [spark.createDataFrame(p, "x string, y string").agg(*set_digest([F.col("x"), F.col("y")])).select(finish_digest()).first()[0] for p in pairs]
    assert len(set(digests)) == len(pairs)


def test_totals_name_the_column(spark):
    left = spark.createDataFrame([(1, "ab", True), (2, None, False)], "n int, t string, b boolean")
    right = spark.createDataFrame([(1, "ab", True), (3, "", None)], "n int, t string, b boolean")
    assert rows(copies.column_totals(left)) == [(0, "n", "int", 2, 0, "3"), (1, "t", "string", 2, 1, "2"), (2, "b", "boolean", 2, 0, "1")]
    assert rows(copies.compare_totals(left, right), "column", "left_nulls", "right_nulls", "left_total", "right_total") == [
        ("b", 0, 1, "1", "1"), ("n", 0, 0, "3", "4"), ("t", 1, 0, "2", "2")]
    assert copies.compare_totals(left, left).collect() == []


def test_one_dataset_in_all_data_sources(spark):
    r = random.Random(4)
    sets = [sorted({0, *r.sample(range(1, 9), r.randrange(0, 4))}) for _ in range(12)]
    scopes = {f"s{i}": sorted({0, *r.sample(range(1, 9), 5)}) for i in range(6)} | {"none": [99]}
    up = [(i, u) for i in range(300) for u in sets[i % 12]] + [(500, 77)]
    got = L.resolve_scope(spark.createDataFrame(up, "datasource int, urn int"), spark.createDataFrame([(s, u) for s, us in scopes.items() for u in us], "scope_id string, urn int"))
    expected = []
    for d in sorted({d for d, _ in up}):
        own = {u for x, u in up if x == d}
        full = [s for s, us in scopes.items() if own <= set(us)]
        expected.append((d, full[0], None) if len(full) == 1 else (d, None, "scope_ambiguous_or_unapproved"))
    assert rows(got) == sorted(expected, key=repr)


def test_datasets_of_the_same_scopes_are_tested_together(spark, monkeypatch):
    written, real = {}, L.scale.stage

    def stage(df, label):
        out = real(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(L.scale, "stage", stage)
    # Every data source reads datasets of its own, so no two have equal upstreams; 900 datasets are in one scope, 10 in two, 10 in none.
    allowed = [("a", u) for u in range(450)] + [("b", u) for u in range(440, 900)]
    up = [(d, u) for d in range(300) for u in (d, d + 300, d + 600)] * 2 + [(500, u) for u in range(445)] + [(501, 905), (502, 440), (503, None), (503, 1), (None, 1)]
    got = L.resolve_scope(spark.createDataFrame(up, "datasource int, urn int"), spark.createDataFrame(allowed, "scope_id string, urn int"))
    no = "scope_ambiguous_or_unapproved"
    assert rows(got) == sorted([(d, None, no) for d in range(300)] + [(500, "a", None), (501, None, no), (502, None, no), (503, None, no), (None, None, no)], key=repr)
    # Four classes of datasets ({a}, {b}, both, none) make at most 15 sets, however many data sources and datasets there are.
    assert max(n for label, n in written.items() if label in ("scope-sets", "scope-heads", "scope-found")) <= 32


def test_findings_group_by_their_ordered_files(spark):
    data = [("c1", "m", None, 0, "x", 1, 1), ("c1", "m", None, 1, "y", 2, 2), ("c2", "m", None, 1, "y", 5, 9), ("c2", "m", None, 0, "x", 4, 4),
            ("c3", "m", None, 0, "y", 1, 1), ("c3", "m", None, 1, "x", 1, 1), ("c4", "m", "a", 0, "x", 1, 1), ("c4", "m", "a", 1, "y", 1, 1)]
    groups, files, members = L.finding_groups(spark.createDataFrame(data, "candidate_id string, method string, attributes string, position int, path string, line int, end_line int"))
    assert rows(groups, "attributes", "files", "candidates", "first_line", "last_line") == sorted([(None, 2, 2, 1, 9), (None, 2, 1, 1, 1), ("a", 2, 1, 1, 1)], key=repr)
    ids = {r.candidate_id: r.group_id for r in members.collect()}
    assert ids["c1"] == ids["c2"] and len(set(ids.values())) == 3 and members.count() == 8
    assert rows(files.filter(F.col("group_id") == ids["c3"]), "position", "path") == [(0, "y"), (1, "x")]


def test_paths_of_many_targets(spark):
    r = random.Random(5)
    parent = {0: None} | {i: i - 1 if i < 40 else r.randrange(i) for i in range(1, 160)}
    edges = spark.createDataFrame([(f"n{p}", f"n{i}", "x") for i, p in parent.items() if p is not None], "src string, dst string, relationship string")
    walk = L.lineage_walk(edges, "n0", "DOWNSTREAM")
    wanted = [f"n{i}" for i in range(0, 160, 3)] + ["lost"]
    got = {}
    for row in L.walk_paths(walk, spark.createDataFrame([(n,) for n in wanted * 2], "node string")).collect():
        got.setdefault(row.target, {})[row.position] = row.step
    expected = {}
    for n in wanted[:-1]:
        path, i = [], int(n[1:])
        while i is not None:
            path.insert(0, f"n{i}")
            i = parent[i]
        expected[n] = dict(enumerate(path))
    assert got == expected


def test_evidence_of_findings_is_moved_once(spark, monkeypatch):
    written, real = [], L.scale.stage
    monkeypatch.setattr(L.scale, "stage", lambda df, label: written.append(label) or real(df, label))
    data = [(str(i), "m", None, p, f"f{p}", 1, 2) for i in range(3) for p in range(2)]
    members = L.finding_groups(spark.createDataFrame(data, "candidate_id string, method string, attributes string, position int, path string, line int, end_line int"))[2]
    assert members._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and written == []
    assert members.select("group_id").distinct().count() == 1 and members.count() == 6


def test_null_members_are_equal(spark):
    one = spark.createDataFrame([(1, None), (1, 2), (2, None)], "job int, dataset int")
    got = L.extend_only(one, spark.createDataFrame([(1, None), (1, 3)], "job int, dataset int"), ["job"], "dataset")
    assert rows(got) == sorted([(1, 2, "conflict"), (2, None, "conflict"), (1, 3, "added")], key=repr)
