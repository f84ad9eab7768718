"""Document screening, user-supplied analyzers, conversation and session logs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martweave.functions import scale
from martweave.functions.scalars import snippet
from martweave.operators import lineage

# What counts as a secret, and what a placeholder looks like.
PRIVATE_KEY = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"
URL_CREDENTIAL = r"(?i)\b[a-z][a-z0-9+.-]*://[^/\s:@]+:[^/\s@]+@"
SECRET_WORDS = r"password|passwd|pwd|secret|token|api[_-]?key|authorization|cookie"
QUOTED_SECRET = rf"(?i)[\"']?\b(?:{SECRET_WORDS})[\"']?\s*[:=]\s*([\"'])([^\r\n]*?)\1"
YAML_SECRET = rf"(?im)^\s*(?:{SECRET_WORDS})[ \t]*:[ \t]*([^\r\n#]*)"
ODBC_SECRET = r"(?i)[;\"']\s*(?:PWD|PASSWORD)\s*=\s*([^;\"'\r\n]+)"
PLACEHOLDER = r"^(?:Bearer |Basic )?(?:\$\{[A-Z_][A-Z0-9_]*\}|\$\([A-Z_][A-Z0-9_]*\))$"
YAML_NULLS = ("", "null", "Null", "NULL", "~")


def screen_secrets(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, rule) for secret-looking content; values are never returned."""
    text = F.col("text")

    def values(pattern: str, group: int):
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def real(v):
        return ~v.rlike(PLACEHOLDER)

    def strip(v):
        return F.regexp_replace(v, r"^\s+|\s+$", "")

    def yaml_value(v):
        t = strip(v)
        quoted = F.startswith(t, F.lit("'")) | F.startswith(t, F.lit('"'))
        return ~quoted & ~t.isin(*YAML_NULLS) & real(t)

    rules = {
        "private_key": text.rlike(PRIVATE_KEY),
        "url_credential": text.rlike(URL_CREDENTIAL),
        "quoted_secret": F.exists(values(QUOTED_SECRET, 2), lambda v: (v != "") & real(v)),
        "yaml_secret": F.exists(values(YAML_SECRET, 1), yaml_value),
        "odbc_secret": F.exists(values(ODBC_SECRET, 1), lambda v: real(strip(v))),
    }
    hits = F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])
    return docs.select("doc_id", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("rule"))


# --- user-supplied analyzers -----------------------------------------------------------

ANALYSIS = (
    "record string, path string, kind string, local_id string, name string,"
    " source string, target string, state string, code string"
)
_COLUMNS = [part.split()[0] for part in ANALYSIS.split(",")]


BATCH_BYTES = 1 << 22


def byte_slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch whose texts hold at most ``limit`` bytes together; a longer one is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


def analyze_corpus(docs: DataFrame, analyze: Callable[[pd.DataFrame], pd.DataFrame], batch_bytes: int = BATCH_BYTES) -> dict[str, DataFrame]:
    """Run ``analyze`` over batches of docs(path, text); returns nodes, edges, coverage and findings.

    The function gets a pandas frame of whole documents, at most ``batch_bytes`` of text or one
    document, and returns records whose ``record`` is node, edge, coverage or finding; other
    columns may be missing.
    """
    def batches(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            for part in byte_slices(batch, 1, batch_bytes):
                records = analyze(part.to_pandas()).reindex(columns=_COLUMNS).astype(object)
                rows = records.where(records.notna(), None)
                yield pa.RecordBatch.from_arrays([pa.array(rows[c].tolist(), pa.string()) for c in _COLUMNS], names=_COLUMNS)

    records = scale.stage(docs.select("path", "text").mapInArrow(batches, ANALYSIS), "analysis")
    columns = {
        "node": ["path", "kind", "local_id", "name"],
        "edge": ["path", "kind", "source", "target"],
        "coverage": ["path", "state", "code"],
        "finding": ["path", "code"],
    }
    names = {"node": "nodes", "edge": "edges", "coverage": "coverage", "finding": "findings"}
    return {names[r]: records.filter(F.col("record") == r).select(*c) for r, c in columns.items()}


_GRAPH = pa.schema([
    ("record", pa.string()), ("path", pa.string()), ("id", pa.string()), ("kind", pa.string()), ("local_id", pa.string()), ("owner", pa.string()),
    ("fields", pa.list_(pa.struct([("path", pa.string()), ("native_type", pa.string())]))),
    ("sources", pa.list_(pa.struct([("node", pa.string()), ("field", pa.string())]))), ("target", pa.struct([("node", pa.string()), ("field", pa.string())])),
    ("state", pa.string()), ("code", pa.string()), ("start_line", pa.int64()), ("end_line", pa.int64()), ("pointer", pa.string())])
GRAPH = ("record string, path string, id string, kind string, local_id string, owner string, fields array<struct<path:string,native_type:string>>,"
         " sources array<struct<node:string,field:string>>, target struct<node:string,field:string>, state string, code string,"
         " start_line bigint, end_line bigint, pointer string")


def analyze_graph(docs: DataFrame, scope: str, analyze: Callable[[str, str | None], Iterable[dict]], batch_bytes: int = BATCH_BYTES) -> dict[str, DataFrame]:
    """Run ``analyze(path, text)`` over all documents and check what it returns.

    Records are dictionaries with ``record`` node (id, kind, local_id, owner, fields), edge (id, kind, sources,
    target), evidence (id of its node or edge, start_line, end_line, pointer), coverage (state) or finding (code);
    ``node_ref`` makes the ids. Returns nodes, edges, evidence, coverage, findings and ``violations``: those of
    the graph contract, of coverage, and of evidence, whose digest is that of the document the
    record came from. ``complete`` is one row that says whether the analysis is complete, which a violation rules out.
    """
    def batches(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            for part in byte_slices(batch, 1, batch_bytes):
                rows = [{"path": path, **record} for path, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for record in analyze(path, text)]
                yield pa.RecordBatch.from_pylist(rows, schema=_GRAPH)

    files = docs.select("path", "text")
    found = scale.stage(files.mapInArrow(batches, GRAPH), "graph-records")
    of = lambda record, *columns: found.filter(F.col("record") == record).select(*columns)
    nodes = of("node", "id", "kind", "local_id", "owner", "fields")
    edges = of("edge", F.col("id").alias("edge_id"), "kind", "sources", "target")
    coverage, findings = of("coverage", "path", "state"), of("finding", "path", "code")
    digests = files.select("path", F.sha2("text", 256).alias("file_sha256"))
    evidence = of("evidence", F.col("id").alias("subject"), "path", "start_line", "end_line", "pointer").join(digests, "path")
    subjects = nodes.select(F.col("id").alias("subject")).unionByName(edges.select(F.col("edge_id").alias("subject")))
    violations = scale.stage(lineage.validate_graph(nodes, edges, scope).unionByName(lineage.validate_coverage(files, coverage, findings)).unionByName(
        lineage.validate_evidence(evidence, files, subjects=subjects)), "graph-violations")
    valid = violations.isEmpty()
    done = lineage.coverage_complete(coverage, findings, nodes).withColumn("complete", F.col("complete") & F.lit(valid))
    return {"nodes": nodes, "edges": edges, "evidence": evidence, "coverage": coverage, "findings": findings, "violations": violations, "complete": done}


def node_ref(scope: str, kind: str, local_id: str) -> str:
    """The id that ``lineage.node_id`` gives a node, for use inside an analyzer."""
    text = json.dumps([scope, kind, local_id], ensure_ascii=False, separators=(",", ":"))
    return "node_" + hashlib.sha256(text.encode()).hexdigest()


# --- sessions -------------------------------------------------------------------------------


def first_match(rows: DataFrame, session: str, position: str, keep: Sequence[str]) -> DataFrame:
    """First row of each session by position; combines map-side."""
    return rows.groupBy(session).agg(
        F.min_by(F.struct(position, *keep), F.col(position)).alias("_r")).select(session, "_r.*")


def search_conversations(log: DataFrame, needle: str, most: int = 30) -> tuple[DataFrame, DataFrame]:
    """log(session, position, role, text, modified): first hit per session, newest sessions first.

    Returns (at most ``most`` hits, one row saying whether there were more).
    """
    word = needle.strip()
    if not word or len(word) > 200:
        raise ValueError("search_needle_invalid")
    hits = log.filter(F.col("role").isin("user", "assistant")).filter(
        F.locate(word.lower(), F.lower("text")) > 0)
    before, match, after = snippet(F.col("text"), word)
    cut = hits.select("session", "position", "modified", before.alias("before"), match.alias("match"), after.alias("after"))
    first = first_match(cut, "session", "position", ["modified", "before", "match", "after"])
    ordered = first.orderBy(F.desc("modified"), "session")
    flag = first.limit(most + 1).agg((F.count(F.lit(1)) > most).alias("truncated"))
    return ordered.limit(most), flag


def session_stats(entries: DataFrame) -> DataFrame:
    """entries(session, type, role, tool_calls, input, output, cache_read, cache_write, cost) per session.

    Usage counts for assistant and tool messages and for compaction or branch
    summaries, so totals grow for the whole life of a session.
    """
    message, role = F.col("type") == "message", F.col("role")
    summary = F.col("type").isin("compaction", "branch_summary")
    uses = summary | (message & role.isin("assistant", "toolResult"))

    def total(name: str):
        return F.coalesce(F.sum(F.when(uses, F.coalesce(F.col(name), F.lit(0)))), F.lit(0)).alias(name)

    counts = entries.groupBy("session").agg(
        F.count_if(message & (role == "user")).alias("user_messages"),
        F.count_if(message & (role == "assistant")).alias("assistant_messages"),
        F.coalesce(F.sum(F.when(message & (role == "assistant"), F.coalesce("tool_calls", F.lit(0)))), F.lit(0))
        .alias("tool_calls"),
        F.count_if(message & (role == "toolResult")).alias("tool_results"),
        F.count_if(message).alias("total_messages"),
        *[total(n) for n in ("input", "output", "cache_read", "cache_write", "cost")],
    )
    return counts.withColumn(
        "total_tokens", F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write"))


# Entry types that carry time, and roles that end a human pause.
TIMED = ("message", "compaction", "branch_summary", "custom_message")
PAUSES = ("user", "bashExecution")


def active_time(entries: DataFrame, order: Sequence[str]) -> DataFrame:
    """entries(session, type, role, at_ms, …) -> (session, active_ms).

    Positive gaps between entries in log order, except gaps that end at a user
    or shell entry. A long session is split over tasks (see ``grouped_lag``).
    """
    timed = entries.filter(F.col("type").isin(*TIMED) & F.col("at_ms").isNotNull())
    role = F.when(F.col("type") == "message", F.col("role"))
    slim = timed.select("session", *order, "at_ms", F.coalesce(role.isin(*PAUSES), F.lit(False)).alias("_pause"))
    lagged = scale.grouped_lag(slim, ["session"], order, "at_ms", "_previous")
    gap = F.col("at_ms") - F.col("_previous")
    return lagged.groupBy("session").agg(
        F.coalesce(F.sum(F.when(~F.col("_pause") & (gap > 0), gap)), F.lit(0)).alias("active_ms"))
