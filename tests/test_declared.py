"""Dashboards and API documents: every shape has its row or its reason, in one scan."""

import json

import pytest
from pyspark.sql import functions as F

from martweave.sources import declared
from tests.conftest import rows

DS = {"type": "mssql", "uid": "u"}


def panel(number, **more):
    return {"id": number, "type": "stat", "targets": [{"refId": "A", "rawSql": f"SELECT {number}"}], "datasource": DS, **more}


def boards(spark, *docs):
    return spark.createDataFrame([(f"p{i}", d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "path string, text string")


def found(spark, *docs, **how):
    return rows(declared.explode_dashboards(boards(spark, *docs), **how), "path", "kind", "id", "reason")


def test_rows_in_rows_are_opened(spark):
    deep = panel(9)
    for _ in range(6):
        deep = {"type": "row", "id": 1, "panels": [deep]}
    assert found(spark, {"dashboard": {"uid": "d", "panels": [panel(1), deep, {"type": "row"}]}}) == [("p0", "panel", "1", None), ("p0", "panel", "9", None)]


def test_the_first_sound_panel_has_the_number(spark):
    # Panels inside rows come after all others of the row's level; a panel that is refused does not take its number.
    doc = {"uid": "d", "panels": [{"type": "row", "panels": [panel(1, title="late")]}, panel(1, targets=[]), panel(1), panel(2), panel(2)]}
    refused = "panel_structure_unsupported"
    assert found(spark, doc) == [*[("p0", "panel", "1", refused)] * 2, ("p0", "panel", "1", None), ("p0", "panel", "2", refused), ("p0", "panel", "2", None)]


PANELS = [
    (7, "panel_invalid"), (panel("1"), "panel_structure_unsupported"), (panel(True), "panel_structure_unsupported"), (panel(1.5), "panel_structure_unsupported"),
    (panel(None), "panel_structure_unsupported"), (panel(1, targets=[{}, {}]), "panel_structure_unsupported"), (panel(1, transformations=[1]), "panel_structure_unsupported"),
    (panel(1, transformations=[], libraryPanel=None), None), (panel(1, libraryPanel={"uid": "x"}), "panel_structure_unsupported"),
    (panel(1, datasource={"type": "mssql"}), "datasource_binding_required"), (panel(1, datasource="name"), "datasource_binding_required"),
    (panel(1, datasource={"type": "mssql", "uid": "other"}), "datasource_binding_required"),
    (panel(1, targets=[{"rawSql": "S", "datasource": None}]), "datasource_binding_required"), (panel(1, targets=[{"rawSql": 5}]), "datasource_binding_required"),
    (panel(1, datasource=None, targets=[{"rawSql": "S", "datasource": DS}]), None),
]


def test_panels_with_reasons(spark):
    got = {r[0]: r[3] for r in found(spark, *[{"uid": "d", "panels": [item]} for item, _ in PANELS], datasources=["u"])}
    assert got == {f"p{i}": reason for i, (_, reason) in enumerate(PANELS)}


def test_variables_and_identity(spark):
    query = {"name": "a", "type": "query", "query": {"rawSql": "S"}, "datasource": DS}
    sound = {"uid": "d", "panels": [], "templating": {"list": [query, {"name": "b", "type": "custom"}, {"name": "c", "type": "query", "query": 1, "datasource": DS}]}}
    twice = {"uid": "d", "panels": [panel(1)], "templating": {"list": [query, query]}}
    unnamed = {"uid": "d", "panels": [panel(1)], "templating": {"list": [query, {"type": "query"}]}}
    assert found(spark, sound, twice, unnamed, {"panels": [panel(1)]}, {"uid": "", "panels": []}, {"uid": "d"}, "[]", "{") == sorted([
        ("p0", "variable", "a", None), ("p0", "variable", "b", "variable_type_unsupported"), ("p0", "variable", "c", "datasource_binding_required"),
        ("p1", "dashboard", None, "variable_identity_invalid"), ("p2", "dashboard", None, "variable_identity_invalid"),
        ("p3", "dashboard", None, "dashboard_identity_missing"), ("p4", "dashboard", None, "dashboard_identity_missing")], key=repr)


def api(paths, **more):
    return {"openapi": "3.0.2", "paths": paths, **more}


def specs(spark, *docs):
    return rows(declared.explode_api_specs(boards(spark, *docs)), "doc", "route", "method", "role", "media", "reason")


def test_api_shapes_have_reasons(spark):
    get = {"get": {"responses": {"200": {}}}}
    got = specs(
        spark, api({"/a": {"get": 1, "put": {"responses": []}}}, servers=[], security=[]), api({"a": get, "/b": [], "/c": {"$ref": "#/x"}}), api({}), api([]),
        api({"/d": {"post": {"servers": [], "security": [], "responses": {"default": 5, "2X": {}, "2XX": {"content": {"application/json": 7, "text/x": {"schema": {}}}, "links": {}}}}}}),
        {"openapi": "3.1.0", "paths": {"/x": get}})
    assert got == sorted([
        ("p0", None, None, None, None, "global_servers_not_projected"), ("p0", None, None, None, None, "global_security_not_projected"),
        ("p0", "/a", "get", None, None, "operation_invalid"), ("p0", "/a", "put", None, None, "responses_missing"),
        ("p1", "a", None, None, None, "path_unsupported"), ("p1", "/b", None, None, None, "path_unsupported"), ("p1", "/c", None, None, None, "path_unsupported"),
        ("p2", None, None, None, None, "paths_missing"), ("p3", None, None, None, None, "paths_missing"),
        ("p4", "/d", "post", None, None, "servers_not_projected"), ("p4", "/d", "post", None, None, "security_not_projected"),
        ("p4", "/d", "post", "response:default", None, "content_invalid"), ("p4", "/d", "post", "response:2X", None, "response_status_unsupported"),
        ("p4", "/d", "post", "response:2XX", None, "response_metadata_not_projected"),
        ("p4", "/d", "post", "response:2XX", "application/json", "media_schema_unsupported"), ("p4", "/d", "post", "response:2XX", "text/x", "media_schema_unsupported"),
        ("p5", None, None, None, None, "document_unsupported")], key=repr)


def test_references_are_followed(spark):
    body = {"content": {"application/json": {"schema": {}}}}
    chain = {f"r{i}": {"$ref": f"#/c/r{i + 1}"} for i in range(30)} | {"r30": body, "a/b": body}
    paths = {"/x": {"get": {"requestBody": {"$ref": "#/c/a~1b"}, "responses": {"200": {"$ref": "#/c/r25"}, "201": {"$ref": "#/c/r0"}, "202": {"$ref": "other#/c"}, "203": {"$ref": "#/c/zz"}}}}}
    got = [r[3:] for r in specs(spark, api(paths, c=chain))]
    assert sorted(got, key=repr) == sorted([
        ("request", "application/json", None), ("response:200", "application/json", None), ("response:201", None, "reference_cycle"), ("response:201", None, "content_invalid"),
        ("response:202", None, "reference_unsupported"), ("response:202", None, "content_invalid"), ("response:203", None, "reference_missing"),
        ("response:203", None, "content_invalid")], key=repr)


def test_references_to_odd_places_take_no_rounds(spark, monkeypatch):
    body = {"content": {"application/json": {"schema": {}}}}
    odd = {"a b": body, "it's?": body, "0": body, "": body, "x~1y/z": body, "list": [5, body], "null": None, "far": {"$ref": "#/c/list/1"}, "two": {"$ref": "#/c/far", "x": 1}}
    refs = ["a b", "it's?", "0", "", "x~01y~1z", "list/1", "list/01", "list/2", "null", "far", "two", "far~2", "null/x", "list"]
    responses = {str(200 + i): {"$ref": "#/c/" + r} for i, r in enumerate(refs)}
    staged = []
    real = declared.stage
    monkeypatch.setattr(declared, "stage", lambda df, label: staged.append(label) or real(df, label))
    documents = boards(spark, api({"/x": {"get": {"responses": responses}}}, c=odd)).unionByName(
        boards(spark, api({"/x": {"get": {"responses": {"200": {"$ref": "#/c"}}}}}, c=body)).withColumn("path", F.lit(None).cast("string")))
    got = rows(declared.explode_api_specs(documents), "doc", "role", "media", "reason")
    good = {"a b", "it's?", "0", "", "x~01y~1z", "list/1", "far"}
    first = {"list/01": "reference_missing", "list/2": "reference_missing", "far~2": "reference_missing", "null/x": "reference_missing", "two": "reference_unsupported"}
    want = [("p0", f"response:{200 + i}", "application/json", None) for i, r in enumerate(refs) if r in good]
    want += [("p0", f"response:{200 + i}", None, "content_invalid") for i, r in enumerate(refs) if r not in good]
    want += [("p0", f"response:{200 + i}", None, first[r]) for i, r in enumerate(refs) if r in first]
    assert got == sorted([*want, (None, "response:200", "application/json", None)], key=repr)
    assert staged == ["api-rows"]


@pytest.mark.parametrize("explode, doc", [
    (declared.explode_dashboards, {"uid": "d", "panels": [panel(1), {"type": "row", "panels": [panel(2)]}], "templating": {"list": []}}),
    (declared.explode_api_specs, api({"/x": {"get": {"responses": {"200": {}}}}}))])
def test_documents_are_scanned_once(spark, tmp_path, monkeypatch, explode, doc):
    path = str(tmp_path / "docs")
    boards(spark, doc).write.parquet(path)
    plans = []
    real = declared.stage

    def stage(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label)

    monkeypatch.setattr(declared, "stage", stage)
    result = explode(spark.read.parquet(path))
    plans.append(result._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count(f"{path}]") for p in plans) == 1 and "Exchange" not in plans[0] and "ArrowEval" not in "".join(plans)
