"""Lineage as tables: graph checks, traversal, column groups, binding and job dependencies."""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martweave.functions import documents, scale
from martweave.functions.scalars import digest_sums, finish_digest, parse_urn, row_text, set_digest, stable_id
from martweave.operators.quality import all_violations, rule_rows, violation

# Edge kinds between ports, the relations and kinds a candidate may have.
FIELD_EDGES = ("value_dependency", "condition_dependency")
STRUCTURAL_EDGES = ("reads", "writes", "calls", "contains", "depends_on")
RELATIONS = ("reads", "writes", "calls", "contains", "consumes", "uses_datasource", "depends_on")
PUBLISHABLE = ("asset", "process", "type", "relationship", "field_mapping")


# --- graph contract --------------------------------------------------------------------


def node_id(scope: str, kind: Column, local_id: Column) -> Column:
    return stable_id("node_", F.lit(scope), kind, local_id)


def endpoints(edges: DataFrame) -> DataFrame:
    """(edge_id, kind, role, node, field) for every source and target."""
    sources = edges.select("edge_id", "kind", F.lit("source").alias("role"), F.inline("sources"))
    targets = edges.select("edge_id", "kind", F.lit("target").alias("role"), "target.node", "target.field")
    return sources.unionByName(targets)


def validate_graph(nodes: DataFrame, edges: DataFrame, scope: str) -> DataFrame:
    """Violations of the graph contract.

    nodes(id, kind, local_id, owner, fields: array<struct<path, native_type>>),
    edges(edge_id, kind, sources: array<struct<node, field>>, target: struct<node, field>).
    """
    expected = node_id(scope, F.col("kind"), F.col("local_id"))
    identity = nodes.filter(~F.col("id").eqNullSafe(expected))
    ports = nodes.filter("kind = 'port'")
    # Written first, so that its true size decides how it is joined: identities are derived and far longer than what they come from.
    paths = F.array_distinct(F.flatten(F.collect_set(F.when(F.col("kind") == "port", F.col("fields.path")))))
    known = scale.stage(nodes.groupBy(F.col("id").alias("node")).agg(
        F.count(F.lit(1)).alias("n"), F.max("kind").alias("node_kind"), paths.alias("paths")), "graph-nodes")
    repeated = known.filter("n > 1").withColumnRenamed("node", "id")
    owners = known.filter("node_kind IN ('asset', 'operation')").select(F.col("node").alias("owner"))
    homeless = ports.join(owners, "owner", "left_anti")
    # Fields count within one record of a port: a port that is listed twice is a fault of its own.
    inside = ports.select("id", F.explode(F.array_distinct("fields.path")).alias("field"), F.col("fields.path").alias("all"))
    twice = inside.withColumn("n", F.size(F.filter("all", lambda p: p.eqNullSafe(F.col("field"))))).filter("n > 1").groupBy("id", "field").agg(
        F.max("n").cast("long").alias("n"))

    # All endpoint rules in one pass and one join: the endpoints are by far the largest table here.
    ends = endpoints(edges).join(known.select("node", "node_kind", "paths"), "node", "left")
    there = F.col("node_kind").isNotNull()
    end_rules = rule_rows(ends, ["edge_id", "role"], {
        "dangling_edge": (there, F.col("node")),
        "unknown_field": (~there | F.col("field").isNull() | F.array_contains("paths", F.col("field")), F.col("field")),
        "value_edge_requires_ports": (
            ~there | ~F.col("kind").isin(*FIELD_EDGES) | (F.col("node_kind") == "port"), F.col("node_kind")),
    })
    shape = edges.filter(
        F.col("kind").isin(*STRUCTURAL_EDGES)
        & ((F.size("sources") != 1) | F.exists("sources", lambda s: s["field"].isNotNull())
           | F.col("target.field").isNotNull())
    )
    return all_violations(
        violation(repeated, "duplicate_node", ["id"], F.col("n")),
        violation(identity, "identity_mismatch", ["id"], F.col("local_id")),
        violation(homeless, "port_owner_invalid", ["id"], F.col("owner")),
        violation(twice, "duplicate_field", ["id", "field"], F.col("n")),
        end_rules,
        violation(shape, "structural_edge_invalid", ["edge_id"], F.col("kind")),
    )


def validate_coverage(files: DataFrame, coverage: DataFrame, findings: DataFrame) -> DataFrame:
    """files(path), coverage(path, state), findings(path, code): every file covered once, gaps explained."""
    counted = coverage.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("state").alias("state"),
                                           F.max("state").alias("last_state"))
    known = files.select("path").distinct()
    explained = findings.select("path").distinct()
    unsupported = counted.filter("last_state = 'unsupported'").join(explained, "path", "left_anti")
    return all_violations(
        violation(known.join(counted, "path", "left_anti"), "file_not_covered", ["path"], "0"),
        violation(counted.filter("n > 1"), "file_covered_twice", ["path"], F.col("n")),
        violation(counted.join(known, "path", "left_anti"), "covered_file_unknown", ["path"], F.col("n")),
        violation(unsupported, "unsupported_without_finding", ["path"], "unsupported"),
    )


def coverage_complete(coverage: DataFrame, findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: analyzed and unsupported files, findings, and whether the analysis is complete."""
    parts = coverage.agg(
        F.count_if(F.col("state") == "analyzed").alias("analyzed"),
        F.count_if(F.col("state") != "analyzed").alias("unsupported"),
    ).unionByName(findings.agg(F.count(F.lit(1)).alias("findings")), allowMissingColumns=True).unionByName(
        nodes.agg(F.count(F.lit(1)).alias("nodes")), allowMissingColumns=True)
    row = parts.agg(*[F.max(c).alias(c) for c in ("analyzed", "unsupported", "findings", "nodes")])
    done = (F.col("nodes") > 0) & (F.col("findings") == 0) & (F.col("unsupported") == 0)
    return row.withColumn("complete", done)


def evidence_findings(evidence: DataFrame, corpus: DataFrame, keys: Sequence[str] = ("subject",), scope: str | None = None,
                      subjects: DataFrame | None = None) -> DataFrame:
    """(keys…, path, rule, detail) for every rule that a piece of evidence breaks.

    evidence(keys…, path, file_sha256, start_line, end_line, and where they are to be checked
    pointer and scope_id) against corpus(path, text). A pointer must be well formed and lead to a
    value of the file, which must be JSON; ``scope`` is the scope all evidence must name;
    ``subjects(keys…)`` lists those that need evidence. Evidence of an unknown path breaks no
    other rule. Texts are reduced to digest and line count before the join; files that a pointer
    names are opened to rows and pointers, which are data, meet them by equality.
    """
    keys = list(keys)
    files = corpus.select(
        "path",
        F.sha2("text", 256).alias("sha256"),
        (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).alias("line_count"),
    )
    if "pointer" in evidence.columns:
        # A fact per file, and per file and pointer that is asked for, so that evidence meets files and pointers in one join.
        valid = F.when(documents.valid_pointer(F.col("pointer")), F.col("pointer"))
        asked = evidence.select("path", valid.alias("pointer")).filter("path IS NOT NULL AND pointer IS NOT NULL")
        found = documents.values_at(corpus.select("path", "text"), ["path"], "text", asked).select("path", "pointer", F.col("kind").isNotNull().alias("_found"))
        facts = files.select("*", F.lit(None).cast("string").alias("pointer"), F.lit(False).alias("_found")).unionByName(files.join(found, "path"))
        facts = facts.withColumnsRenamed({"path": "_path", "pointer": "_pointer"})
        joined = evidence.withColumn("_valid", valid).join(facts, (F.col("path") == F.col("_path")) & F.col("_valid").eqNullSafe(F.col("_pointer")), "left")
    else:
        joined = evidence.join(files, "path", "left")
    there = F.col("sha256").isNotNull()
    lines = (F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line")) & (F.col("end_line") <= F.col("line_count"))
    rules = {
        "evidence_path_unknown": (there, F.lit("path")),
        "evidence_digest_mismatch": (~there | (F.col("sha256") == F.col("file_sha256")), F.lit("sha256")),
        "evidence_line_out_of_range": (~there | lines, F.concat_ws("-", F.col("start_line"), F.col("end_line"))),
    }
    if scope is not None:
        rules["evidence_scope_mismatch"] = (~there | (F.col("scope_id") == scope), F.col("scope_id"))
    if "pointer" in evidence.columns:
        rules["evidence_pointer_invalid"] = (~there | F.col("pointer").isNull() | F.col("_found"), F.col("pointer"))
    # Only evidence that breaks a rule is opened.
    faulty = reduce(operator.or_, [~F.coalesce(holds, F.lit(False)) for holds, _ in rules.values()])
    broken = F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.struct(F.lit(r).alias("rule"), detail.cast("string").alias("detail")))
                       for r, (holds, detail) in rules.items()])
    rows = joined.filter(faulty).select(*keys, "path", F.inline(F.filter(broken, lambda b: b.isNotNull())))
    if subjects is None:
        return rows
    # One aggregation over both sides instead of a distinct and an anti join.
    sides = subjects.select(*keys, F.lit(0).alias("_has")).unionByName(evidence.select(*keys, F.lit(1).alias("_has")))
    listed = sides.groupBy(*keys).agg(F.max("_has").alias("_has"))
    bare = listed.filter("_has = 0")
    return rows.unionByName(bare.select(*keys, F.lit(None).cast("string").alias("path"), F.lit("missing_evidence").alias("rule"), F.lit(None).cast("string").alias("detail")))


def validate_evidence(evidence: DataFrame, corpus: DataFrame, keys: Sequence[str] = ("subject",), scope: str | None = None,
                      subjects: DataFrame | None = None) -> DataFrame:
    """Violations of ``evidence_findings``, keyed by subject and path."""
    found = evidence_findings(evidence, corpus, keys, scope, subjects)
    spot = F.concat_ws("/", *[F.col(k).cast("string") for k in (*keys, "path")])
    return found.select("rule", spot.alias("key"), "detail")


def candidate_reasons(candidates: DataFrame, evidence_findings: DataFrame) -> DataFrame:
    """Shape and evidence findings per candidate as (source_id, candidate_id, reason).

    candidates(source_id, candidate_id, kind, status, object, attributes: map).
    """
    found = F.array(*[F.when(rule, F.lit(name)) for name, rule in _shape_rules().items()])
    shape = candidates.filter(_misshapen()).select("source_id", "candidate_id", F.explode(F.filter(found, lambda r: r.isNotNull())).alias("reason"))
    repeated = candidates.groupBy("source_id", "candidate_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "source_id", "candidate_id", F.lit("duplicate_candidate_id").alias("reason"))
    return shape.unionByName(repeated).unionByName(evidence_findings.select("source_id", "candidate_id", "reason")).distinct()


def _shape_rules() -> dict[str, Column]:
    """Reasons that a candidate gives by itself."""
    a = F.col("attributes")

    def blank(name: str) -> Column:
        return F.coalesce(F.try_element_at(a, F.lit(name)), F.lit("")) == ""

    relation = F.coalesce(F.try_element_at(a, F.lit("relation_type")), F.lit(""))
    kind, target = F.col("kind"), F.col("object")
    return {
        "invalid_relation_type": (kind == "relationship") & ~relation.isin(*RELATIONS),
        "relationship_missing_object": (kind == "relationship") & (F.coalesce(target, F.lit("")) == ""),
        "field_mapping_missing_fields": (kind == "field_mapping") & (blank("source_field") | blank("target_field")),
        "resolved_mapping_without_source": (kind == "field_mapping") & target.isNull() & (F.col("status") == "resolved"),
        "unresolved_kind_status_mismatch": (kind == "unresolved") & (F.col("status") != "unresolved"),
    }


def _misshapen() -> Column:
    return reduce(operator.or_, [F.coalesce(rule, F.lit(False)) for rule in _shape_rules().values()])


# What becomes of a candidate that is not rejected.
_DISPOSITIONS = ("unresolved", "publishable", "held")


def validate_candidates(candidates: DataFrame, evidence_findings: DataFrame,
                        sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(disposition per candidate, report per source).

    ``sources(source_id)`` adds sources that have no candidates; they are inconclusive.

    Dispositions: rejected, unresolved, publishable, held. A source fails with any
    finding, is inconclusive with any unresolved or inferred candidate, else passes;
    in a failed source nothing is valid or publishable.
    """
    # Candidates and findings meet in one aggregation of numbers. A candidate that is listed twice is rejected, so no record has to be chosen.
    kind, status = F.col("kind"), F.col("status")
    place = F.when(kind.isNull(), 3).when((kind == "unresolved") | (status == "unresolved"), 1).when(
        kind.isin(*PUBLISHABLE) & (status == "resolved"), 2).otherwise(3)
    inferred = kind.isNotNull() & F.coalesce(status == "inferred", F.lit(False))
    own = candidates.select("source_id", "candidate_id", F.lit(1).alias("n"), _misshapen().cast("int").alias("bad"),
                            place.alias("place"), inferred.cast("int").alias("inferred"))
    other = evidence_findings.select("source_id", "candidate_id", F.lit(0).alias("n"), F.lit(1).alias("bad"), F.lit(0).alias("place"), F.lit(0).alias("inferred"))
    one = own.unionByName(other).groupBy("source_id", "candidate_id").agg(
        F.sum("n").alias("n"), F.max("bad").alias("bad"), F.max("place").alias("place"), F.max("inferred").alias("inferred")).filter("n > 0")
    rows = one.select(
        "source_id", "candidate_id", F.when(F.col("inferred") == 1, "inferred").alias("status"),
        F.when((F.col("bad") == 1) | (F.col("n") > 1), "rejected").otherwise(
            F.get(F.array(*[F.lit(d) for d in _DISPOSITIONS]), F.col("place") - 1)).alias("disposition"))
    none = F.lit(None).cast("string")
    listed = rows if sources is None else rows.unionByName(sources.select(
        "source_id", none.alias("candidate_id"), none.alias("status"), F.lit("none").alias("disposition")).distinct())
    report = listed.groupBy("source_id").agg(
        F.bool_or(F.col("disposition") == "rejected").alias("failed"),
        (F.bool_or((F.col("disposition") == "unresolved") | (F.coalesce("status", F.lit("")) == "inferred"))
         | F.bool_and(F.col("disposition") == "none")).alias("open"),
        F.count_if(~F.col("disposition").isin("rejected", "none")).alias("valid"),
        F.count_if(F.col("disposition") == "publishable").alias("publishable"),
        F.count_if(F.col("disposition") == "unresolved").alias("unresolved"),
    )
    report = report.select(
        "source_id",
        F.when(F.col("failed"), "FAIL").when(F.col("open"), "INCONCLUSIVE").otherwise("PASS").alias("status"),
        F.when(F.col("failed"), 0).otherwise(F.col("valid")).alias("valid_candidates"),
        F.when(F.col("failed"), 0).otherwise(F.col("publishable")).alias("publishable_candidates"),
        F.col("unresolved").alias("unresolved_candidates"),
    )
    return rows.select("source_id", "candidate_id", "disposition"), report


# --- visibility and traversal -----------------------------------------------------------


def visible_only(df: DataFrame, grants: DataFrame, actor: str, entity: str, parent: str | None = None) -> DataFrame:
    """Rows whose entity, and parent dataset for fields, is granted to ``actor``: grants(actor, urn)."""
    granted = grants.filter(F.col("actor") == actor).select(F.col("urn").alias("_g")).distinct()
    seen = df.join(granted, F.col(entity) == F.col("_g"), "left_semi")
    return seen if parent is None else seen.join(granted, F.col(parent) == F.col("_g"), "left_semi")


def lineage_hop(edges: DataFrame, urn: str, direction: str, grants: DataFrame, actor: str) -> DataFrame:
    """Direct neighbours of one entity as (src, dst, relationship), keeping the edge's own direction."""
    here, there = ("dst", "src") if direction == "UPSTREAM" else ("src", "dst")
    return visible_only(edges.filter(F.col(here) == urn), grants, actor, there)


MERGE_ROUNDS = 8


def lineage_walk(edges: DataFrame, start: str, direction: str) -> DataFrame:
    """Breadth-first (node, distance, parent) of all nodes that ``start`` reaches; the smallest parent wins among equals.

    Each hop is one join of the frontier with the edges, written out before the next, until
    a hop finds nothing new; only that reaches the driver. What has been seen is written
    together every few hops, so a long walk does not read one table per hop.
    """
    near, far = ("dst", "src") if direction == "UPSTREAM" else ("src", "dst")
    steps = scale.stage(edges.select(F.col(near).alias("node"), F.col(far).alias("next")).distinct(), "walk-edges")
    seen = edges.sparkSession.sql("SELECT :start AS node, 0 AS distance, CAST(NULL AS STRING) AS parent", {"start": start})
    frontier, hop = seen, 0
    while True:
        hop += 1
        reached = frontier.select("node").join(steps, "node").groupBy(F.col("next").alias("node")).agg(F.min("node").alias("parent"))
        fresh = reached.join(seen.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("distance"), "parent")
        frontier = scale.stage(fresh, "walk")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if hop % MERGE_ROUNDS == 0:
            seen = scale.stage(seen, "walk-seen")


def walk_paths(walk: DataFrame, nodes: DataFrame) -> DataFrame:
    """(target, position, step): the nodes from the start (position 0) to every target that the walk reached.

    walk(node, distance, parent) as ``lineage_walk`` returns it, nodes(node). Ancestors at
    distance 2^k are looked up for all targets at once, and paths double in every round, so
    there are as many rounds as the logarithm of the longest path, whatever the number of targets.
    """
    far = scale.stage(walk.select("node", "distance", F.col("parent").alias("above")), "walk-jumps")
    paths = scale.stage(nodes.select(F.col("node").alias("target")).distinct().join(
        far.select(F.col("node").alias("target"), "distance"), "target").select("target", F.col("distance").alias("position"), F.col("target").alias("step")), "walk-paths")
    longest = paths.agg(F.max("position")).first()[0] or 0
    jump = 1
    while jump <= longest:
        # A step at this distance or more has an ancestor that far above it, and none of them is in a path yet.
        above = paths.filter(F.col("position") >= jump).join(far.select(F.col("node").alias("step"), "above"), "step").select(
            "target", (F.col("position") - jump).alias("position"), F.col("above").alias("step"))
        paths = scale.stage(paths.unionByName(above), "walk-paths")
        jump *= 2
        if jump <= longest:
            beyond = far.select(F.col("node").alias("above"), F.col("above").alias("_next"))
            far = scale.stage(far.filter(F.col("distance") >= jump).join(beyond, "above").select("node", "distance", F.col("_next").alias("above")), "walk-jumps")
    return paths


def walk_path(walk: DataFrame, node: str) -> list[str]:
    """Nodes from the start to ``node``; empty if the walk did not reach it."""
    one = walk.select("node").filter(F.col("node") == node)
    return [r["step"] for r in walk_paths(walk, one).orderBy("position").select("step").collect()]


PLAIN_ROUNDS = 4


def _greatest_source(edges: DataFrame, label: str) -> DataFrame:
    """(node, colour): the greatest node that reaches it, itself included, in the order of the nodes.

    A round takes the greatest colour of the nodes before; only nodes that have a new one hand it on.
    After ``PLAIN_ROUNDS`` it also takes the colour of the colour: what reaches the node that
    reaches me reaches me. So rounds grow with the logarithm of the depth.
    """
    # The first round needs no join: every node hands on itself.
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("src").alias("colour")), F.struct(F.col("dst").alias("node"), F.greatest("src", "dst").alias("colour")))
    step = scale.stage(edges.select(F.inline(ends)).groupBy("node").agg(F.max("colour").alias("colour")).withColumn("old", F.col("node")), label)
    rounds = 1
    while True:
        colour, fresh = step.select("node", "colour"), step.filter("colour <> old").select("node", "colour")
        if fresh.isEmpty():
            return colour
        pushed = edges.join(fresh, edges.src == fresh.node).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("pushed"))
        step = scale.stage(colour.join(pushed, "node", "left").select(
            "node", F.greatest("colour", F.coalesce("pushed", "colour")).alias("colour"), F.col("colour").alias("old")), label)
        if rounds >= PLAIN_ROUNDS:
            beyond = step.select(F.col("node").alias("_n"), F.col("colour").alias("_beyond"))
            step = scale.stage(step.join(beyond, F.col("colour") == F.col("_n"), "left").select(
                "node", F.greatest("colour", F.coalesce("_beyond", "colour")).alias("colour"), "old"), label)
        rounds += 1


def _strong_parts(edges: DataFrame) -> DataFrame | None:
    """(node, part) for nodes that share a cycle, by colouring.

    Nodes must be numbered without regard to the edges, as hashes do. Every node takes the
    greatest node that reaches it as its colour. Along the edges inside a
    colour, the nodes that also reach that greatest node form one part with it. Parts and edges
    between colours are dropped and the rest is coloured again; random colours cut it into
    pieces, so a few turns are enough for chains of any length.
    """
    rest, parts = edges, None
    while True:
        has_out, has_in = rest.select(F.col("src").alias("n")).distinct(), rest.select(F.col("dst").alias("n")).distinct()
        # Nodes without an edge in or out are on no cycle.
        rest = scale.stage(rest.join(has_in, rest.src == has_in.n, "left_semi").join(has_out, rest.dst == has_out.n, "left_semi"), "trim")
        if rest.isEmpty():
            return parts
        colour = _greatest_source(rest, "colour")
        inner = scale.stage(
            rest.join(colour.withColumnsRenamed({"node": "src", "colour": "cs"}), "src").join(
                colour.withColumnsRenamed({"node": "dst", "colour": "cd"}), "dst").filter("cs = cd").select("src", "dst"), "inner")
        back = _greatest_source(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "back")
        found = scale.stage(colour.join(back.withColumnRenamed("colour", "_back"), "node").filter("colour = _back").select(
            "node", F.col("colour").alias("part")), "parts")
        parts = found if parts is None else parts.unionByName(found)
        gone = found.select("node")
        rest = inner.join(gone, inner.src == gone.node, "left_anti").join(gone, inner.dst == gone.node, "left_anti")


def _number(node: Column) -> Column:
    return F.xxhash64(node)


def _share_numbers(edges: DataFrame) -> bool:
    """Whether two nodes have one number; a second hash tells them apart."""
    ends = F.array(*[F.struct(F.col(n).alias("n"), F.xxhash64(F.lit("node"), v).alias("h")) for n, v in (("s", "src"), ("d", "dst"))])
    hashes = edges.select(F.inline(ends)).groupBy("n").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    return not hashes.filter("low <> high").isEmpty()


def edges_on_cycles(edges: DataFrame) -> DataFrame:
    """(src, dst, on_cycle): an edge is on a cycle when both ends share a strongly connected part.

    Rounds work on 64-bit hashes of the nodes. Should two nodes share one, rounds carry the nodes as well.
    """
    pairs = edges.select("src", "dst").distinct()
    distinct = scale.stage(pairs.withColumns({"s": _number(F.col("src")), "d": _number(F.col("dst"))}), "cycle-edges")
    if _share_numbers(distinct):
        distinct = distinct.withColumns({n: F.struct(F.col(n).alias("h"), F.col(v).alias("n")) for n, v in (("s", "src"), ("d", "dst"))})
    parts = _strong_parts(distinct.filter("src <> dst").select(F.col("s").alias("src"), F.col("d").alias("dst")))
    if parts is None:
        return distinct.select("src", "dst", (F.col("src") == F.col("dst")).alias("on_cycle"))
    left = parts.withColumnsRenamed({"node": "s", "part": "ps"})
    right = parts.withColumnsRenamed({"node": "d", "part": "pd"})
    return distinct.join(left, "s", "left").join(right, "d", "left").select(
        "src", "dst", (F.coalesce(F.col("ps") == F.col("pd"), F.lit(False)) | (F.col("src") == F.col("dst"))).alias("on_cycle"))


def nearest_parent(nodes: DataFrame) -> DataFrame:
    """nodes(node, parent, listed) -> (node, nearest): nearest listed ancestor, NULL at a root or cycle.

    Pointer doubling: after k rounds every row knows its first 2^k ancestors, so
    chains of any length end in log2 rounds and what is left is on a cycle.
    """
    known = nodes.select(F.col("node").alias("_n"), F.col("listed").alias("_listed"))
    state = nodes.join(known, F.col("parent") == F.col("_n"), "left").select(
        "node", F.col("_n").alias("jump"), F.when(F.col("_listed"), F.col("_n")).alias("nearest"))
    state = scale.stage(state, "parents")
    rounds = math.ceil(math.log2(max(state.count(), 2))) + 1
    for _ in range(rounds):
        if state.filter("jump IS NOT NULL").isEmpty():
            break
        other = state.select(F.col("node").alias("_n"), F.col("jump").alias("_jump"), F.col("nearest").alias("_near"))
        active = state.filter("jump IS NOT NULL").join(other, F.col("jump") == F.col("_n")).select(
            "node", F.col("_jump").alias("jump"), F.coalesce("nearest", "_near").alias("nearest"))
        state = scale.stage(state.filter("jump IS NULL").unionByName(active), "parents")
    return state.select("node", F.when(F.col("jump").isNull(), F.col("nearest")).alias("nearest"))


# --- column lineage -----------------------------------------------------------------------


def complete_groups(members: DataFrame, visible: DataFrame) -> DataFrame:
    """Members of groups that have both sides and no hidden or unresolved member.

    members(group_id, side, dataset, field), visible(dataset, field). One hidden member
    removes the whole group.
    """
    known = visible.select("dataset", "field").distinct().withColumn("_seen", F.lit(True))
    whole = members.join(known, ["dataset", "field"], "left").groupBy("group_id").agg(
        F.bool_or(F.col("side") == "upstream").alias("u"), F.bool_or(F.col("side") == "downstream").alias("d"),
        F.bool_and(F.coalesce("_seen", F.lit(False))).alias("all_seen"))
    return members.join(whole.filter("u AND d AND all_seen").select("group_id"), "group_id", "left_semi")


def column_lineage(members: DataFrame, visible: DataFrame, dataset: str, field: str, direction: str) -> DataFrame:
    """Complete groups that have (dataset, field) on the asked side; UPSTREAM looks at downstream members."""
    side = "downstream" if direction == "UPSTREAM" else "upstream"
    hit = members.filter(
        (F.col("side") == side) & (F.col("dataset") == dataset) & (F.col("field") == field)
    ).select("group_id").distinct()
    return complete_groups(members.join(hit, "group_id", "left_semi"), visible)


def lineage_evidence(edges: DataFrame, approved: DataFrame) -> DataFrame:
    """Usable reported field edges, and a row with reason for every omitted one.

    edges(edge_id, upstream_type, downstream_type, upstreams, downstreams, confidence,
    transform), approved(field). One or more distinct upstreams, exactly one downstream.
    """
    ups, downs = F.col("upstreams"), F.col("downstreams")
    well_formed = (
        (F.col("upstream_type") == "FIELD_SET") & (F.col("downstream_type") == "FIELD")
        & (F.size(ups) >= 1) & (F.size(downs) == 1) & (F.size(F.array_distinct(ups)) == F.size(ups))
    )
    shaped = edges.withColumn("ok", F.coalesce(well_formed, F.lit(False)))
    # Only well-formed edges are opened.
    ends = shaped.filter("ok").select("edge_id", F.explode(F.concat(ups, downs)).alias("field"))
    hidden = ends.join(approved.select("field").distinct(), "field", "left_anti").select("edge_id").distinct().withColumn(
        "hidden", F.lit(True))
    confidence = F.col("confidence")
    return shaped.join(hidden, "edge_id", "left").select(
        "edge_id",
        F.when(~F.col("ok"), "shape_unsupported").when(F.col("hidden"), "hidden_or_unresolved").alias("omitted"),
        F.when(F.startswith("transform", F.lit("COPY:")), "COPY").otherwise("DERIVED_OR_UNSPECIFIED").alias("transform"),
        F.when((confidence >= 0) & (confidence <= 1), confidence).alias("confidence"),
        F.size(ups).alias("upstream_count"),
    )


def classify_fields(schema: DataFrame, declarations: DataFrame, omissions: DataFrame, generations: DataFrame) -> DataFrame:
    """One row per target field with its classification.

    schema(dataset, field), declarations(dataset, field, resolved, has_origin,
    has_generated, has_constant), omissions(dataset, field), generations(dataset, field).
    """
    key = ["dataset", "field"]
    declared = declarations.groupBy(*key).agg(
        F.bool_and("resolved").alias("resolved"), F.bool_or("has_origin").alias("has_origin"),
        F.bool_or("has_generated").alias("has_generated"), F.bool_or("has_constant").alias("has_constant"),
        F.count(F.lit(1)).alias("declarations"))
    omitted = omissions.select(*key).distinct().withColumn("omitted", F.lit(True))
    generated = generations.select(*key).distinct().withColumn("generated", F.lit(True))
    no = F.lit(False)
    joined = schema.select(*key).distinct().join(declared, key, "left").join(omitted, key, "left").join(
        generated, key, "left")
    omit, gen = F.coalesce("omitted", no), F.coalesce("generated", no)
    unresolved = (omit & ~gen) | ~F.coalesce("resolved", F.lit(True))
    kind = (
        F.when(unresolved, "UNRESOLVED")
        .when(F.coalesce("has_origin", no), "SOURCE_FIELDS")
        .when(F.coalesce("has_generated", no) | (omit & gen), "DECLARED_GENERATED")
        .when(F.coalesce("has_constant", no), "CONSTANT")
        .when(F.col("declarations").isNull() & ~omit, "PRESERVED_EXISTING_VALUE")
        .otherwise("UNRESOLVED")
    )
    rows = joined.select(*key, kind.alias("classification"), F.col("declarations"))
    reason = F.when(F.col("declarations").isNull(), "omitted_field_generation_unproven").otherwise(
        "value_origin_unresolved")
    return rows.select(*key, "classification", F.when(F.col("classification") == "UNRESOLVED", reason).alias("reason"))


def classification_counts(classified: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """One row of counts; complete only with fields, none of them unresolved, and no row in ``gaps``."""
    open_ = F.col("classification") == "UNRESOLVED"
    whole = F.lit(gaps is None or gaps.isEmpty())
    return classified.agg(
        F.count(F.lit(1)).alias("expected_fields"),
        F.count_if(~open_).alias("classified_fields"),
        F.count_if(open_).alias("unresolved_fields"),
    ).withColumn("complete", (F.col("expected_fields") > 0) & whole & (F.col("unresolved_fields") == 0))


# --- step graph and binding ------------------------------------------------------------------


def dataflow_graph(bindings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, gaps) from bindings(context, dataset, relation, status, reason)."""
    bound = bindings.filter("status = 'CATALOG_BOUND'")
    usable = bound.filter(F.col("relation").isin("reads", "writes"))
    nodes = bindings.select(F.col("context").alias("node"), F.lit("step").alias("kind")).unionByName(
        bound.select(F.col("dataset").alias("node"), F.lit("dataset").alias("kind"))).distinct()
    reads = F.col("relation") == "reads"
    edges = usable.select(
        F.when(reads, F.col("dataset")).otherwise(F.col("context")).alias("src"),
        F.when(reads, F.col("context")).otherwise(F.col("dataset")).alias("dst"),
        F.col("relation").alias("kind"),
    ).distinct()
    gaps = bindings.select(
        F.when(F.col("status") != "CATALOG_BOUND", F.coalesce("reason", F.lit("dataset_binding_incomplete")))
        .when(~F.col("relation").isin("reads", "writes"), "unsupported_relation_kind").alias("reason")
    ).filter(F.col("reason").isNotNull())
    return nodes, edges, gaps


def blocker_counts(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("reason").agg(F.count(F.lit(1)).alias("count")).orderBy("reason")


def finding_groups(findings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Group findings by method, attributes and the ordered list of files that their evidence names.

    findings(candidate_id, method, attributes, path, line, end_line) has a row per piece of
    evidence; ``position`` (0 where the column is missing) is its place in the finding. The list is
    compared by a digest in which every file counts with its place, so no list is gathered.
    Returns (groups, files, members): files(group_id, position, path) states the list once, and every candidate and
    location stays its own row keyed by the group.
    """
    placed = findings if "position" in findings.columns else findings.withColumn("position", F.lit(0))
    finding = ["candidate_id", "method", "attributes"]
    # Evidence is moved, not partial digests: those are far wider, and a finding has few pieces of it.
    dealt = placed.repartition(*finding)
    lists = dealt.groupBy(*finding).agg(
        *set_digest([F.col("position"), F.col("path")]), F.min("line").alias("first_line"), F.max("end_line").alias("last_line"))
    key = F.sha2(row_text([F.col("method"), F.col("attributes"), finish_digest()]), 256)
    groups = lists.select(key.alias("group_id"), "method", "attributes", F.col("_rows").alias("files"), "first_line", "last_line").groupBy(
        "group_id", "method", "attributes", "files").agg(
        F.count(F.lit(1)).alias("candidates"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"))
    whole = Window.partitionBy(*finding)
    members = dealt.withColumns({name: total.over(whole) for name, total in digest_sums([F.col("position"), F.col("path")]).items()}).select(
        key.alias("group_id"), "candidate_id", "position", "path", "line", "end_line")
    return groups, members.select("group_id", "position", "path").distinct(), members.drop("path")


def source_coverage(items: DataFrame, statements: DataFrame) -> DataFrame:
    """items(candidate_id, process, method, selected) against statements(process, described) -> disposition."""
    known = statements.groupBy("process").agg(F.bool_and("described").alias("all_described"))
    joined = items.join(known, "process", "left")
    bound = (F.col("method") == "sql_mapping_scan") & F.coalesce("all_described", F.lit(False))
    return joined.select(
        "candidate_id",
        F.when(bound, "BOUND_SELECTED_WRITE").when(~F.col("selected"), "OUTSIDE_SELECTED_PYTHON_ENTRYPOINT")
        .otherwise("UNRESOLVED_SELECTED_SOURCE").alias("disposition"),
    )


def source_coverage_counts(dispositions: DataFrame, contexts: DataFrame | None = None, trace_findings: DataFrame | None = None) -> DataFrame:
    """(disposition, count, complete); ``complete`` is one answer for the whole set and the same in every row.

    It needs that nothing selected is unresolved, that all contexts(status) are bound or have no
    dataset to bind, and that the trace has no findings.
    """
    whole = trace_findings is None or trace_findings.isEmpty()
    if contexts is not None:
        whole = whole and contexts.filter(~F.coalesce(F.col("status").isin("CATALOG_BOUND", "NO_DATASET_DEPENDENCIES"), F.lit(False))).isEmpty()
    counts = dispositions.groupBy("disposition").agg(F.count(F.lit(1)).alias("count"))
    every = Window.partitionBy(F.lit(0))  # as many rows as there are dispositions, three at most
    return counts.withColumn("complete", F.lit(whole) & ~F.bool_or(F.col("disposition") == "UNRESOLVED_SELECTED_SOURCE").over(every))


def bind_tables(references: DataFrame, scopes: DataFrame, allowed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Resolve table references to catalog datasets, or give the reason.

    references(ref_id, process, identifier), scopes(process, scope_id, database,
    default_schema, env, lowercase), allowed(scope_id, urn), catalog(urn, removed,
    field_count, and where they are to be checked key_platform, key_name and key_origin,
    schema_platform, and fields, a list of paths). An identifier has one to three dot-separated parts, each bare or
    in brackets or double quotes.
    """
    part = r"(?:[^.\[\]\"`#\s]+|\[[^.\[\]]+\]|\"[^.\"]+\")"
    fold = lambda c: F.when(F.col("lowercase"), F.lower(c)).otherwise(c)
    # Names are taken apart before the join, once per reference.
    split = references.select(
        "ref_id", "process",
        F.split(F.translate("identifier", '[]"', ""), r"\.").alias("parts"),
        F.col("identifier").rlike(rf"^{part}(?:\.{part}){{0,2}}$").alias("plain"),
    )
    r = split.join(scopes, "process", "left")
    parts, n = F.col("parts"), F.size("parts")
    r = r.withColumns({
        "_database": F.when(n == 3, parts[0]).otherwise(F.col("database")),
        "_schema": F.when(n == 1, F.col("default_schema")).when(n == 2, parts[0]).otherwise(F.get(parts, F.lit(1))),
    })
    name = F.concat_ws(".", "_database", "_schema", F.element_at(parts, -1))
    urn = F.concat(F.lit("urn:li:dataset:(urn:li:dataPlatform:mssql,"), fold(name), F.lit(","), F.col("env"), F.lit(")"))
    early = (
        F.when(F.col("scope_id").isNull(), "connection_scope_unresolved")
        .when(~F.col("plain"), "unsupported_sql_identifier")
        .when((n == 1) & F.col("default_schema").isNull(), "default_schema_unresolved")
        .when(fold(F.col("_database")) != fold(F.col("database")), "database_outside_host_scope")
    )
    named = r.withColumn("early", early).select(
        "ref_id", "process", "scope_id", "early", F.when(F.col("early").isNull(), urn).alias("urn"))
    permitted = allowed.select("scope_id", "urn").distinct().withColumn("permitted", F.lit(True))
    # What the catalog says of itself must agree with the name it is found under.
    platform, parsed, origin = parse_urn(F.col("urn"))
    agrees = {"key": F.lit(True), "platform": F.lit(True), "fields": F.lit(True)}
    if "key_name" in catalog.columns:
        agrees["key"] = (F.col("key_platform") == platform) & (F.col("key_name") == parsed) & (F.col("key_origin") == origin)
    if "schema_platform" in catalog.columns:
        agrees["platform"] = F.col("schema_platform") == platform
    if "fields" in catalog.columns:
        named_all = F.forall("fields", lambda f: F.coalesce(f != "", F.lit(False)))
        agrees["fields"] = F.col("fields").isNotNull() & named_all & (F.size(F.array_distinct("fields")) == F.size("fields"))
    observed = catalog.groupBy("urn").agg(
        F.bool_or("removed").alias("removed"), F.max("field_count").alias("_fields"), F.lit(True).alias("known"),
        *[F.bool_and(F.coalesce(ok, F.lit(False))).alias(f"_{n}_agrees") for n, ok in agrees.items()])
    # What is permitted meets the catalog first, so the references, by far the most rows, are moved once.
    described = permitted.join(observed, "urn", "left")
    joined = named.join(described, ["scope_id", "urn"], "left")
    reason = F.coalesce(
        "early",
        F.when(F.col("permitted").isNull(), "dataset_outside_host_allowlist")
        .when(F.col("known").isNull(), "catalog_key_missing")
        .when(~F.col("_key_agrees"), "catalog_key_mismatch")
        .when(F.coalesce("removed", F.lit(True)), "catalog_status_missing_or_removed")
        .when(F.coalesce("_fields", F.lit(0)) == 0, "catalog_schema_missing_or_empty")
        .when(~F.col("_platform_agrees"), "catalog_schema_platform_mismatch")
        .when(~F.col("_fields_agrees"), "catalog_schema_fields_invalid"),
    )
    return joined.select(
        "ref_id", "process", F.when(reason.isNull(), "CATALOG_BOUND").otherwise("UNRESOLVED").alias("status"),
        F.when(reason.isNull(), F.col("urn")).alias("dataset"), reason.alias("reason"))


def resolve_field(columns: DataFrame, fields: DataFrame, folding: DataFrame | None = None) -> DataFrame:
    """columns(ref_id, dataset, column) to catalog fields(dataset, path); exactly one match.

    ``folding`` lists the datasets whose catalog ignores case (all when it is not given);
    elsewhere names match as they are written.
    """
    if folding is None:
        wanted, named = columns.withColumn("_k", F.lower("column")), fields.withColumn("_k", F.lower("path"))
    else:
        low = folding.select("dataset").distinct().withColumn("_low", F.lit(True))
        wanted = columns.join(low, "dataset", "left").withColumn("_k", F.when(F.col("_low"), F.lower("column")).otherwise(F.col("column")))
        named = fields.join(low, "dataset", "left").withColumn("_k", F.when(F.col("_low"), F.lower("path")).otherwise(F.col("path")))
    counted = named.groupBy("dataset", "_k").agg(F.count(F.lit(1)).alias("matches"), F.min("path").alias("path"))
    one = F.col("matches") == 1
    return wanted.join(counted, ["dataset", "_k"], "left").select(
        "ref_id", F.when(one, F.col("path")).alias("field"),
        F.when(~F.coalesce(one, F.lit(False)), "catalog_column_missing_or_ambiguous").alias("reason"))


def same_set(left: DataFrame, right: DataFrame, key: Sequence[str], members: Sequence[str]) -> DataFrame:
    """Per ``key``: members only on the left, only on the right, and whether the sets are equal."""
    tagged = left.select(*key, *members).withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0)).unionByName(
        right.select(*key, *members).withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1)))
    rows = tagged.groupBy(*key, *members).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return rows.groupBy(*key).agg(
        F.count_if(F.col("_r") == 0).alias("only_left"), F.count_if(F.col("_l") == 0).alias("only_right"),
    ).withColumn("same", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def bind_panels(
    declared: DataFrame, observed: DataFrame,
    declared_fields: DataFrame, observed_fields: DataFrame,
    declared_lineage: DataFrame, observed_lineage: DataFrame,
) -> DataFrame:
    """Declared dashboard queries to observed catalog datasets: (panel, urn, reason).

    declared(panel, query_sha256), observed(panel, urn, query_sha256), *_fields(panel,
    position, field), *_lineage(panel, field, origin). Order of fields is compared
    position by position, lineage as sets; nothing is gathered per panel.
    """
    hits = observed.groupBy("panel").agg(
        F.count(F.lit(1)).alias("matches"), F.min("urn").alias("urn"), F.min("query_sha256").alias("observed_sha256"))
    fields = same_set(declared_fields, observed_fields, ["panel"], ["position", "field"]).select(
        "panel", F.col("same").alias("same_fields"))
    lineage = same_set(declared_lineage, observed_lineage, ["panel"], ["field", "origin"]).select(
        "panel", F.col("same").alias("same_lineage"))
    yes = F.lit(True)
    reason = (
        F.when(F.coalesce("matches", F.lit(0)) != 1, "query_identity_unresolved")
        .when(F.col("query_sha256") != F.col("observed_sha256"), "query_changed")
        .when(~F.coalesce("same_fields", yes), "projection_changed")
        .when(~F.coalesce("same_lineage", yes), "lineage_changed")
    )
    joined = declared.join(hits, "panel", "left").join(fields, "panel", "left").join(lineage, "panel", "left")
    return joined.select("panel", F.when(reason.isNull(), F.col("urn")).alias("urn"), reason.alias("reason"))


def resolve_scope(upstreams: DataFrame, allowed: DataFrame) -> DataFrame:
    """upstreams(datasource, urn), allowed(scope_id, urn): the one scope that contains all upstreams.

    Datasets that the same scopes allow are one class, known by its smallest dataset. Data sources with equal sets of
    classes share one set, told apart by an order-free digest as the classes are, and a set is tested once: against the
    scopes that hold its rarest class, class by class. A dataset that all data sources read makes no row per data source and scope.
    """
    tasks = int(upstreams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    granted = scale.stage(allowed.select("scope_id", "urn").distinct(), "scope-granted")
    alike = scale.stage(granted.groupBy("urn").agg(*set_digest([F.col("scope_id")])).select("urn", F.unhex(finish_digest()).alias("alike")), "scope-alike")
    firsts = scale.stage(alike.groupBy("alike").agg(F.min("urn").alias("class")), "scope-firsts")
    classes = scale.stage(alike.join(firsts, "alike").select("urn", "class"), "scope-classes")
    rights = scale.stage(granted.withColumnRenamed("urn", "class").join(firsts, "class", "left_semi"), "scope-rights")
    # A dataset that no scope holds has the class NULL, and so have all of a NULL data source: no scope contains those.
    named = upstreams.select("datasource", "urn").join(classes, "urn", "left").select(
        "datasource", F.when(F.col("datasource").isNotNull(), F.col("class")).alias("class"))
    # Pairs are moved once, not partial digests: those are far wider and hardly fewer.
    pairs = named.repartition(tasks, "datasource").distinct()
    whole = Window.partitionBy("datasource")
    sums = {name: total.over(whole) for name, total in digest_sums([F.col("class")]).items()}
    # One row of each data source carries the digest.
    first = F.when(F.col("class").eqNullSafe(F.col("_first")), F.unhex(finish_digest()))
    wanted = scale.stage(pairs.withColumns(sums | {"_first": F.min("class").over(whole)}).select("datasource", "class", first.alias("set_id")), "scope-wanted")
    owners = wanted.filter(F.col("set_id").isNotNull()).select("datasource", "set_id")
    heads = scale.stage(owners.groupBy("set_id").agg(F.min("datasource").alias("datasource")), "scope-heads")
    members = scale.stage(wanted.select("datasource", "class").join(heads, "datasource", "left_semi"), "scope-sets")
    often = rights.groupBy("class").agg(F.count(F.lit(1)).alias("_n"))
    counted = members.join(often, "class", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rarest = counted.groupBy("datasource").agg(F.min_by("class", F.struct("_n", "class")).alias("class"), F.count(F.lit(1)).alias("total"))
    likely = rarest.join(rights, "class").select("datasource", "scope_id", "total")
    covered = likely.join(members, "datasource").join(rights, ["scope_id", "class"], "left_semi").groupBy("datasource", "scope_id", "total").agg(
        F.count(F.lit(1)).alias("covered"))
    full = covered.filter("covered = total").groupBy("datasource").agg(F.count(F.lit(1)).alias("scopes"), F.min("scope_id").alias("scope_id"))
    found = scale.stage(full.filter("scopes = 1").join(heads, "datasource").select("set_id", "scope_id"), "scope-found")
    return owners.join(found, "set_id", "left").select(
        "datasource", "scope_id", F.when(F.col("scope_id").isNull(), "scope_ambiguous_or_unapproved").alias("reason"))


# --- tables and jobs ---------------------------------------------------------------------------


def table_lineage(origins: DataFrame) -> DataFrame:
    """origins(dataset, field, origin_dataset, role) -> distinct dataset edges without self-edges."""
    return origins.filter(F.col("origin_dataset") != F.col("dataset")).select(
        F.col("origin_dataset").alias("src"), F.col("dataset").alias("dst")).distinct()


def job_touches(steps: DataFrame) -> DataFrame:
    """Distinct (job, relation, dataset, step): which steps of a job read or write a dataset."""
    return steps.select("job", "relation", "dataset", "step").distinct()


def job_io(steps: DataFrame, ids: bool = False) -> DataFrame:
    """One row per job, relation and dataset with its number of steps, the first and the last of them; with ``ids`` also all of them in order.

    ``step_ids`` is as long as one job has different steps over one dataset; nothing is cut.
    """
    tasks = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["job", "relation", "dataset"]
    touched = steps.select(*keys, "step")
    if ids:
        lists = touched.repartition(tasks, *keys).groupBy(*keys).agg(F.sort_array(F.collect_set("step")).alias("step_ids"))
        return lists.select(*keys, F.size("step_ids").cast("long").alias("steps"), F.array_min("step_ids").alias("first_step"),
                            F.array_max("step_ids").alias("last_step"), "step_ids")
    # Steps hardly repeat, so a table of them per file split would only fill memory: they are spread before they are made distinct.
    return touched.repartition(tasks, *keys, "step").groupBy(*keys).agg(
        F.count_distinct("step").alias("steps"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


def job_dependencies(steps: DataFrame) -> DataFrame:
    """Which earlier writes by other jobs a read depends on, without listing every pair.

    steps(job, step, relation, dataset), ``step`` being the order over all jobs. A dataset's
    writes are numbered in step order (``write_number``). A read depends on those numbered 1 to
    ``writes_before``, except its own job's; ``depends_on_writes`` of them are left. Writes and
    reads together state the whole relation in one row per step, however many jobs share a dataset.
    """
    touch = steps.select("job", "step", "relation", "dataset").distinct()
    is_write = F.when(F.col("relation") == "writes", 1).otherwise(0)
    # At one step a read comes before a write, so only strictly earlier writes count.
    counted = scale.grouped_running_sum(touch, ["dataset"], ["step", "relation", "job"], is_write, "_all")
    own = scale.grouped_running_sum(counted, ["dataset", "job"], ["step", "relation"], is_write, "_own")
    read = F.col("relation") == "reads"
    return own.select("dataset", "job", "relation", "step", F.when(~read, F.col("_all")).alias("write_number"),
                      F.when(read, F.col("_all")).alias("writes_before"),
                      F.when(read, F.col("_all") - F.col("_own")).alias("depends_on_writes"))


def merge_lineage(current: DataFrame, desired: DataFrame) -> DataFrame:
    """Current edges plus desired ones not already present; upstream order is no identity.

    Both have (upstream_type, downstream_type, upstreams, downstreams).
    """
    key = {
        "_t": F.to_json(F.array("upstream_type", "downstream_type")),
        "_u": F.array_sort("upstreams"),
        "_d": F.array_sort("downstreams"),
    }
    have = current.select(*[c.alias(n) for n, c in key.items()]).distinct()
    identified = desired.withColumns(key).dropDuplicates(list(key))
    new = identified.join(have, list(key), "left_anti").drop(*key)
    return current.withColumn("origin", F.lit("current")).unionByName(new.withColumn("origin", F.lit("added")))


def extend_only(current: DataFrame, desired: DataFrame, key: Sequence[str], member: str) -> DataFrame:
    """Per row: 'added' for desired members not there yet, 'conflict' for current ones not desired.

    One aggregation over both sides; NULLs are equal, as they are for EXCEPT.
    """
    both = current.select(*key, member, F.lit(1).alias("_side")).unionByName(desired.select(*key, member, F.lit(2).alias("_side")))
    sides = both.groupBy(*key, member).agg(F.bit_or("_side").alias("_sides")).filter("_sides < 3")
    return sides.select(*key, member, F.when(F.col("_sides") == 2, "added").otherwise("conflict").alias("change"))


def latest_observation(pages: DataFrame, key: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """Newest row per key; max_by combines map-side, so a hot key is not sorted in one task."""
    rest = [c for c in pages.columns if c not in key]
    newest_row = F.max_by(F.struct(*rest), F.struct(*newest)).alias("_row")
    return pages.groupBy(*key).agg(newest_row).select(*key, "_row.*")
