"""Dashboards and API documents as rows: one pass over the JSON, with a reason for every shape that is not described.

A document is parsed once to a VARIANT. Members become arrays of items, each either a
finished row or something still to be opened, and every level is one ``explode`` in the same
stage; nothing is joined with itself. Only rows of panels inside rows take rounds; references
between parts of an API document are followed inside it, in a second pass over documents that need it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martweave.functions.documents import valid_pointer
from martweave.functions.scale import stage


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _text_at(v: Column, path: str) -> Column:
    """A member that is a JSON string; NULL for anything else."""
    found = _at(v, path)
    return F.when(F.schema_of_variant(found) == "STRING", _at(v, path, "string"))


def _list_at(v: Column, path: str) -> Column:
    return _at(v, path, "array<variant>")


def _members(v: Column) -> Column:
    """Members of a JSON object as a map; NULL for anything else."""
    return _at(v, "$", "map<string,variant>")


def _some(*items: Column) -> Column:
    """Those of the items that are not NULL."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


# --- dashboards ---------------------------------------------------------------------------

_ITEM = "array<struct<kind:string,place:array<int>,body:variant,reason:string>>"


def explode_dashboards(docs: DataFrame, datasources: Sequence[str] | None = None) -> DataFrame:
    """(path, text) dashboards -> (path, dashboard_uid, kind, id, ref_id, datasource_uid, sql, reason).

    One row per panel and per query variable; row panels are opened, rows in rows too. What is
    not described keeps a row with a reason: a dashboard without a uid or with a variable that has
    no name of its own (then nothing of it is opened), a panel that is no object, has no whole
    number or an earlier panel's number as its id, not exactly one target, transformations or a library
    panel, a variable that is no query, and a query whose data source is not of the supported type, has
    no uid, is not among ``datasources`` (if given), or has no text. Earlier means in the order
    of the dashboard, all panels of a row after all others of the row's level.
    """
    v = F.try_parse_json("text")
    parsed = docs.select("path", F.coalesce(_at(v, "$.dashboard"), v).alias("d")).filter(_list_at(F.col("d"), "$.panels").isNotNull())
    d = F.col("d")
    held = parsed.select("path", _text_at(d, "$.uid").alias("uid"), _list_at(d, "$.panels").alias("panels"),
                         F.coalesce(_list_at(d, "$.templating.list"), F.array().cast("array<variant>")).alias("variables"))
    names = F.filter(F.transform("variables", lambda x: _text_at(x, "$.name")), lambda n: n.isNotNull())
    blocked = (F.when(F.coalesce("uid", F.lit("")) == "", "dashboard_identity_missing")
               .when(F.size(F.array_distinct(names)) != F.size("variables"), "variable_identity_invalid"))

    def items(kind: str, bodies: str) -> Column:
        return F.transform(bodies, lambda b, i: F.struct(
            F.lit(kind).alias("kind"), F.array(i).alias("place"), b.alias("body"), F.lit(None).cast("string").alias("reason"))).cast(_ITEM)

    nothing = F.array(F.struct(F.lit("dashboard").alias("kind"), F.array().cast("array<int>").alias("place"), F.lit(None).cast("variant").alias("body"), blocked.alias("reason")))
    opened = F.when(blocked.isNotNull(), nothing.cast(_ITEM)).otherwise(F.concat(items("panel", "panels"), items("variable", "variables")))

    def shaped(df: DataFrame) -> DataFrame:
        # Members go on as text, so no row carries the names of its whole dashboard.
        is_row = (F.col("kind") == "panel") & F.coalesce(_text_at(F.col("body"), "$.type") == "row", F.lit(False))
        return stage(df.select("path", "uid", "kind", "place", is_row.alias("is_row"), F.to_json("body").alias("text"), "reason"), "dashboard-items")

    level = shaped(held.select("path", "uid", F.inline(opened)))
    levels = [level]
    while True:
        rows = level.filter("is_row")
        if rows.isEmpty():
            break
        inner = rows.select("path", "uid", "kind", F.col("place").alias("_above"), F.posexplode(_list_at(F.parse_json("text"), "$.panels")).alias("_i", "body"))
        level = shaped(inner.withColumns({"place": F.concat("_above", F.array("_i")), "reason": F.lit(None).cast("string")}))
        levels.append(level)
    return _requests(reduce(DataFrame.unionByName, levels).filter("NOT is_row"), datasources)


def _requests(items: DataFrame, datasources: Sequence[str] | None) -> DataFrame:
    v = F.col("v")
    panel = F.col("kind") == "panel"
    read = items.withColumn("v", F.try_parse_json("text"))
    targets = _list_at(v, "$.targets")
    own_id = F.schema_of_variant(_at(v, "$.id")).rlike(r"^(?:BIGINT|DECIMAL\([0-9]+,0\))$")
    one = F.coalesce(F.size(targets), F.lit(0)) == 1
    extra = [F.coalesce(~F.to_json(_at(v, f"$.{m}")).isin("null", "[]", "{}", "false", '""', "0"), F.lit(False)) for m in ("transformations", "libraryPanel")]
    sound = panel & F.coalesce(own_id, F.lit(False)) & one & ~extra[0] & ~extra[1]
    # Of sound panels with one id the first has it: by depth, then by place.
    order = F.struct(F.size("place"), F.col("place"))
    numbered = read.withColumns({"_id": _at(v, "$.id", "string"), "_sound": sound}).withColumn(
        "_first", F.min(F.when(F.col("_sound"), order)).over(Window.partitionBy("path", "kind", "_id")))
    target = F.get(targets, 0)
    in_target = F.coalesce(F.map_contains_key(_members(target), F.lit("datasource")), F.lit(False))
    ds = F.when(panel & in_target, _at(target, "$.datasource")).otherwise(_at(v, "$.datasource"))
    query = F.when(panel, _text_at(target, "$.rawSql")).otherwise(F.coalesce(_text_at(v, "$.query.rawSql"), _text_at(v, "$.query")))
    uid = _text_at(ds, "$.uid")
    bound = (_text_at(ds, "$.type") == "mssql") & uid.isNotNull() & query.isNotNull()
    if datasources is not None:
        bound = bound & uid.isin(list(datasources))
    reason = F.coalesce(
        F.col("reason"),
        F.when(panel & _members(v).isNull(), "panel_invalid"),
        F.when(panel & ~(F.col("_sound") & (order == F.col("_first"))), "panel_structure_unsupported"),
        F.when((F.col("kind") == "variable") & ~F.coalesce(_text_at(v, "$.type") == "query", F.lit(False)), "variable_type_unsupported"),
        F.when(~F.coalesce(bound, F.lit(False)), "datasource_binding_required"))
    return numbered.select(
        "path", F.col("uid").alias("dashboard_uid"), "kind", F.when(panel, F.col("_id")).otherwise(_text_at(v, "$.name")).alias("id"),
        F.when(panel, _text_at(target, "$.refId")).alias("ref_id"), uid.alias("datasource_uid"), query.alias("sql"), reason.alias("reason"))


# --- API documents ------------------------------------------------------------------------

# HTTP methods an API document may declare under a path, and its other members.
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
OTHER_MEMBERS = ("summary", "description", "parameters", "servers")
MAX_REFERENCES = 24
_OPEN = "array<struct<open:string,route:string,method:string,role:string,media:string,reason:string,body:variant>>"
_PLACE = ["route", "method", "role", "media"]


def _row(open_: str | None = None, reason: Column | str | None = None, body: Column | None = None, **at: Column) -> Column:
    """A finished row (``open_`` is None) or a part of the document to be opened."""
    text = lambda c: F.lit(c).cast("string") if c is None or isinstance(c, str) else c
    fields = [text(open_).alias("open"), *[at.get(n, F.lit(None).cast("string")).alias(n) for n in _PLACE], text(reason).alias("reason"),
              (F.lit(None).cast("variant") if body is None else body).alias("body")]
    return F.struct(*fields)


def _rows(*parts: Column) -> Column:
    return F.concat(*[p.cast(_OPEN) for p in parts])


def _has(members: Column, name: str) -> Column:
    return F.coalesce(F.map_contains_key(members, F.lit(name)), F.lit(False))


def _not_projected(members: Column, names: Sequence[str], lead: str = "", **at: Column) -> Column:
    return _some(*[F.when(_has(members, n), _row(reason=f"{lead}{n}_not_projected", **at)) for n in names])


def _each(members: Column, row) -> Column:
    return F.transform(F.map_entries(members), lambda e: row(e["key"], e["value"]))


def _open_document(v: Column, members: Column, paths: Column) -> Column:
    supported = F.coalesce(_text_at(v, "$.openapi").rlike(r"^3\.0\.[0-9]+$"), F.lit(False))
    routes = _each(paths, lambda route, item: _row("route", route=route, body=item))
    none = F.coalesce(F.size(paths), F.lit(0)) == 0
    inside = F.when(none, F.array(_row(reason="paths_missing")).cast(_OPEN)).otherwise(routes.cast(_OPEN))
    return F.when(~supported, F.array(_row(reason="document_unsupported")).cast(_OPEN)).otherwise(
        _rows(_not_projected(members, ("servers", "security"), "global_"), inside))


def _open_route(c: Column, members: Column, _: Column) -> Column:
    route = c["route"]
    good = F.startswith(route, F.lit("/")) & members.isNotNull() & ~_has(members, "$ref")

    def member(name: Column, value: Column) -> Column:
        known = name.isin(*OTHER_MEMBERS) | F.startswith(name, F.lit("x-"))
        return F.when(name.isin(*METHODS), _row("operation", route=route, method=name, body=value)).when(
            ~known, _row(reason="path_member_unsupported", route=route, method=name))

    inside = F.filter(_each(members, member), lambda x: x.isNotNull())
    return F.when(good, _rows(_not_projected(members, ("parameters", "servers"), "path_", route=route), inside)).otherwise(
        F.array(_row(reason="path_unsupported", route=route)).cast(_OPEN))


def _open_operation(c: Column, members: Column, responses: Column) -> Column:
    at = {"route": c["route"], "method": c["method"]}
    request = _some(F.when(_has(members, "requestBody"), _row("container", role=F.lit("request"), body=F.try_element_at(members, F.lit("requestBody")), **at)))

    def answer(status: Column, body: Column) -> Column:
        role = F.concat(F.lit("response:"), status)
        good = (status == "default") | status.rlike("^[1-5](?:[0-9]{2}|XX)$")
        return F.when(good, _row("container", role=role, body=body, **at)).otherwise(_row(reason="response_status_unsupported", role=role, **at))

    none = F.coalesce(F.size(responses), F.lit(0)) == 0
    answers = F.when(none, F.array(_row(reason="responses_missing", **at)).cast(_OPEN)).otherwise(_each(responses, answer).cast(_OPEN))
    return F.when(members.isNull(), F.array(_row(reason="operation_invalid", **at)).cast(_OPEN)).otherwise(
        _rows(_not_projected(members, ("callbacks", "parameters", "security", "servers"), **at), request, answers))


def _open_container(c: Column, members: Column, content: Column) -> Column:
    at = {n: c[n] for n in ("route", "method", "role")}

    def media(name: Column, body: Column) -> Column:
        good = (name == "application/json") & _has(_members(body), "schema")
        return _row(media=name, reason=F.when(~good, "media_schema_unsupported"), **at)

    extra = _some(F.when(_has(members, "headers") | _has(members, "links"), _row(reason="response_metadata_not_projected", **at)))
    empty = F.array(_row(**at)).cast(_OPEN)
    invalid = F.array(_row(reason="content_invalid", **at)).cast(_OPEN)
    inside = (F.when(~_has(members, "content") | (F.size(content) == 0), empty).when(content.isNull(), invalid)
              .otherwise(_each(content, media).cast(_OPEN)))
    referred = F.array(_row("reference", body=c["body"], **at)).cast(_OPEN)
    return F.when(members.isNull(), invalid).when(_has(members, "$ref"), referred).otherwise(_rows(extra, inside))


# How a part is opened, and the member that is opened with it.
_OPENERS = {"route": (_open_route, None), "operation": (_open_operation, "responses"), "container": (_open_container, "content")}


def _opened(rows: DataFrame, kind: str) -> DataFrame:
    """Rows with their parts of one kind opened. Members are columns, so that a body becomes a map once and not in every rule."""
    opener, inner = _OPENERS[kind]
    wide = rows.select("doc", F.struct("open", *_PLACE, "reason", "body").alias("c"), _members(F.col("body")).alias("members"))
    held = F.lit(None).cast("map<string,variant>") if inner is None else _members(F.try_element_at("members", F.lit(inner)))
    return wide.withColumn("held", held).select("doc", F.inline(
        F.when(F.col("c.open") == kind, opener(F.col("c"), F.col("members"), F.col("held"))).otherwise(F.array("c").cast(_OPEN))))


def _reference(body: Column, members: Column) -> Column:
    """What a body refers to; NULL when it is no text or not the body's only member."""
    return F.when(F.size(members) == 1, _text_at(body, "$['$ref']"))


def explode_api_specs(docs: DataFrame) -> DataFrame:
    """(path, text) API documents -> one row per path, method, role and media type.

    Columns: doc, route, method, role ('request' or 'response:<status>'), media, reason. A shape
    that is not described, or is left out of the description, has a row with a reason and NULL
    below it. Bodies and responses given by reference are looked up in their document, through
    further references up to ``MAX_REFERENCES``.
    """
    read = docs.select(F.col("path").alias("doc"), F.try_parse_json("text").alias("v"))
    read = read.withColumn("members", _members(F.col("v"))).withColumn("paths", _members(F.try_element_at("members", F.lit("paths"))))
    rows = read.select("doc", F.inline(_open_document(F.col("v"), F.col("members"), F.col("paths"))))
    for kind in _OPENERS:
        rows = _opened(rows, kind)
    ref = F.when(F.col("open") == "reference", _reference(F.col("body"), _members(F.col("body"))))
    found = stage(rows.select("doc", "open", *_PLACE, "reason", ref.alias("ref")), "api-rows")
    done = found.filter("open IS NULL").select("doc", *_PLACE, "reason")
    pending = found.filter("open = 'reference'")
    if pending.isEmpty():
        return done
    local = F.coalesce(F.startswith("ref", F.lit("#/")), F.lit(False))
    foreign = pending.filter(~local).select("doc", *_PLACE, _both(F.lit("reference_unsupported")))
    asked = pending.filter(local).select("doc", "ref", "route", "method", "role")
    ends = _references(docs, asked)
    behind = asked.join(ends, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("ref") == F.col("_ref")))
    return done.unionByName(foreign).unionByName(behind.select("doc", *_PLACE, "reason"))


def _both(reason: Column) -> Column:
    """A reference that leads nowhere leaves its reason and an invalid content."""
    return F.explode(F.array(reason, F.lit("content_invalid"))).alias("reason")


def _lookup(v: Column, ref: Column) -> Column:
    """(found, value) at a local reference; NULL is a value, and a value of SQL NULL may be found."""
    text = F.substring(ref, F.lit(3), F.length(ref))
    # Names that need no escape and cannot be places of an array are found by one path, without opening what lies on the way.
    path = F.concat(F.lit("$['"), F.replace(text, F.lit("/"), F.lit("']['")), F.lit("']"))
    quick = F.when(ref.rlike("^#(?:/[A-Za-z_][A-Za-z0-9_.-]*)+$"), F.try_variant_get(v, path, "variant"))

    def step(at: Column, token: Column) -> Column:
        name = F.replace(F.replace(token, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
        members, elements = _members(at["value"]), _list_at(at["value"], "$")
        place = F.when(token.rlike("^(?:0|[1-9][0-9]{0,8})$"), token.cast("int"))
        there = F.coalesce(F.map_contains_key(members, name), place < F.size(elements), F.lit(False))
        return F.struct((at["found"] & there).alias("found"), F.coalesce(F.try_element_at(members, name), F.get(elements, place)).alias("value"))

    start = F.struct(valid_pointer(F.substring(ref, F.lit(2), F.length(ref))).alias("found"), v.alias("value"))
    kind = "struct<found:boolean,value:variant>"
    whole = F.transform(F.array(quick), lambda q: F.when(q.isNotNull(), F.struct(F.lit(True).alias("found"), q.alias("value"))).cast(kind))[0]
    return F.coalesce(whole, F.aggregate(F.split(text, "/"), start.cast(kind), lambda at, t: step(at, t).cast(kind)))


def _followed(v: Column, ref: Column) -> Column:
    """Where a local reference ends: (ref, reason, body), through further references."""
    kind = "struct<open:boolean,next:string,seen:array<string>,reason:string,body:variant>"
    text, none = F.lit(None).cast("string"), F.lit(None).cast("variant")

    def state(open_: Column, next_: Column, seen: Column, reason: Column, body: Column) -> Column:
        return F.struct(open_.alias("open"), next_.alias("next"), seen.alias("seen"), reason.alias("reason"), body.alias("body")).cast(kind)

    def met(s: Column, members: Column, target: Column) -> Column:
        seen = F.concat(s["seen"], F.array(s["next"]))
        return F.when(~target["found"], state(F.lit(False), s["next"], seen, F.lit("reference_missing"), none)).when(
            _has(members, "$ref"), state(F.lit(True), _reference(target["value"], members), seen, text, none)).otherwise(
            state(F.lit(False), s["next"], seen, text, target["value"]))

    def step(s: Column, _: Column) -> Column:
        failed = F.when(~F.coalesce(F.startswith(s["next"], F.lit("#/")), F.lit(False)), "reference_unsupported").when(
            F.array_contains(s["seen"], s["next"]) | (F.size(s["seen"]) >= MAX_REFERENCES), "reference_cycle")
        target = F.transform(F.array(_lookup(v, s["next"])), lambda t: met(s, _members(t["value"]), t))[0]
        return F.when(~s["open"], s).when(failed.isNotNull(), state(F.lit(False), s["next"], s["seen"], failed, none)).otherwise(target)

    first = state(F.lit(True), ref, F.array().cast("array<string>"), text, none)
    end = F.aggregate(F.sequence(F.lit(0), F.lit(MAX_REFERENCES)), first, step, lambda s: F.struct(s["reason"].alias("reason"), s["body"].alias("body")))
    return F.struct(ref.alias("ref"), end["reason"].alias("reason"), end["body"].alias("body"))


def _references(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(_doc, _ref, media, reason): the rows behind every reference of asked(doc, ref).

    A document meets the distinct references that it is asked for once, and each is followed to
    its end there, so chains take no rounds. There are fewer of them than the document has text.
    """
    refs = asked.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("ref").alias("refs"))
    read = docs.join(refs, F.col("path").eqNullSafe(F.col("_doc"))).select("_doc", "refs", F.try_parse_json("text").alias("v"))
    ends = read.select("_doc", F.inline(F.transform("refs", lambda r: _followed(F.col("v"), r))))
    nowhere = F.col("reason").isNotNull()
    nothing = [F.lit(None).cast("string").alias(n) for n in _PLACE]
    failed = F.transform(F.array("reason", F.lit("content_invalid")), lambda r: _row(reason=r)).cast(_OPEN)
    wide = ends.select("_doc", "ref", "reason", F.when(~nowhere, _members(F.col("body"))).alias("members"),
                       F.struct(*nothing, F.lit(None).cast("variant").alias("body")).alias("c"))
    wide = wide.withColumn("held", _members(F.try_element_at("members", F.lit("content"))))
    opened = _open_container(F.col("c"), F.col("members"), F.col("held"))
    return wide.select("_doc", F.col("ref").alias("_ref"), F.inline(F.when(nowhere, failed).otherwise(opened))).select("_doc", "_ref", "media", "reason")
