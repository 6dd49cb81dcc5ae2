"""Documents reach Python in small batches and are taken apart once."""

import json

from pactlake.plans import contract_diff
from pactlake.sources import documents
from pactlake.work import BATCH


def _specs(spark, n):
    def text(i, kind):
        schema = {"type": "object", "properties": {"a": {"type": kind}}}
        return json.dumps({"openapi": "3.0.0", "servers": [{"url": "https://x.test"}], "paths": {"/x": {"get": {"responses": {"200": {"description": "x", "content": {"application/json": {"schema": schema}}}}}}}})

    rows = [(str(i), s, s, text(i, k)) for i in range(n) for s, k in (("old", "string"), ("new", "integer"))]
    return spark.createDataFrame(rows, "pair_id string, side string, source string, content string").coalesce(1)


def test_a_worker_holds_few_documents(spark, monkeypatch):
    before, seen, write = spark.conf.get(BATCH), [], contract_diff.written

    def watched(df, tag, **k):
        seen.append(k.get("batch"))
        return write(df, tag, **k)

    monkeypatch.setattr(contract_diff, "written", watched)
    d = contract_diff.DocumentDiff(_specs(spark, 150))
    assert seen[0] == contract_diff.BATCH_DOCUMENTS <= 64 and spark.conf.get(BATCH) == before
    assert {r["kind"] for r in d.changes().collect()} == {"response.field.type.changed"} and d.changes().count() == 150
    d.close()


def test_operations_and_heads_are_read_without_whole_documents(spark):
    d = contract_diff.DocumentDiff(_specs(spark, 2))
    reads = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert all("doc#" not in reads(df) for df in (d.model.operations(), d.model.fields(), d.model.params(), d.model.servers(), d.model.security(), d.model.schemes()))
    assert d.model.servers().count() == 4 and json.loads(d.loaded.first()["head"])["openapi"] == "3.0.0"
    d.close()


def test_a_head_is_the_document_without_its_paths(spark):
    r = documents.load(_specs(spark, 1)).first()
    doc = json.loads(r["doc"])
    doc.pop("paths")
    assert json.loads(r["head"]) == doc


def test_operations_leave_python_as_columns(spark):
    d = contract_diff.DocumentDiff(_specs(spark, 2))
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert all("from_json" not in plan(df) and "get_json_object" not in plan(df) for df in (d.model.operations(), d.model.fields(), d.model.params()))
    assert d.loaded.count() == 4 and d.loaded.filter("head IS NULL").count() == 0
    d.close()


def test_odd_values_of_operations_are_read_as_text(spark):
    op = {"operationId": 5, "deprecated": "true", "security": [{"b": [], "a": []}, {"a": []}], "responses": {"default": {}, "204": {}}}
    op["parameters"] = [{"name": "x", "in": "query", "schema": {"type": "string"}}, {"name": 7, "in": "header"}, {"in": "query"}, {"name": "c", "in": "cookie"}]
    item = {"parameters": [{"name": "y", "in": "query"}, {"name": "x", "in": "query", "required": True, "schema": {"type": "array"}}], "get": op, "put": {"security": "a"}}
    texts = [json.dumps({"openapi": "3.0.0", "security": [{"k": []}], "paths": {"/x": item, "/y": {"get": {}}}}), '{"openapi": "3.0.0", "paths": {"/\\ud800": {"get": {"responses": {}}}}}', '{"swagger": "2.0", "paths": {"/x": {"get": {}}}}', "[]"]
    m = documents.Model(documents.load(spark.createDataFrame([(str(i), "old", "s", t) for i, t in enumerate(texts)], "pair_id string, side string, source string, content string")))
    ops = {r.op_key: r for r in m.operations().collect()}
    assert set(ops) == {"GET /x", "PUT /x", "GET /y"} and [ops[k].ord for k in ("GET /x", "PUT /x", "GET /y")] == [0, 1, 8]
    assert (ops["GET /x"].operation_id, ops["GET /x"].deprecated, ops["GET /x"].security, ops["GET /x"].statuses) == ("5", True, ["a", "b"], ["204", "default"])
    assert (ops["PUT /x"].security, ops["PUT /x"].own_security, ops["GET /y"].security, ops["GET /y"].own_security) == ([], True, ["k"], False)
    params = {(r.op_key, r.location, r.name): (r.required, r.ord, r.type) for r in m.params().collect()}
    assert params["GET /x", "query", "x"] == (False, 1, "string") and params["PUT /x", "query", "x"] == (True, 1, "array<unknown>")
    assert params["GET /x", "header", "7"] == (False, 100001, "unknown") and len(params) == 5
