"""The normalised model of documents with merged, united, cyclic and shared schemas, against rows worked out by hand."""

import json
import random
import time

import pytest

from pactlake.plans import contract_diff
from pactlake.sources import documents

DOC = {
    "openapi": "3.1.0",
    "info": {"title": "Orchard", "version": "5"},
    "security": [{"token": []}],
    "components": {
        "securitySchemes": {
            "token": {"type": "http", "scheme": "bearer"}, "key": {"type": "apiKey", "in": "header", "name": "X-Key"},
            "flow": {"type": "oauth2", "flows": {"implicit": {}, "clientCredentials": {}}}, "oidc": {"type": "openIdConnect", "openIdConnectUrl": "https://id.test"}, "odd": {"type": "mutualTLS"},
        },
        "parameters": {"Row": {"name": "row", "in": "query", "required": True, "schema": {"type": "integer", "format": "int32"}}},
        "schemas": {
            "Plant": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "planted": {"type": "string", "format": "date"}}},
            "Tree": {"allOf": [{"$ref": "#/components/schemas/Plant"}, {"type": "object", "required": ["height"], "properties": {"height": {"type": "number"}, "name": {"type": "integer"}}}], "properties": {"grafts": {"type": "array", "items": {"$ref": "#/components/schemas/Tree"}}}},
            "Fruit": {"oneOf": [{"type": "string"}, {"type": "integer"}]},
            "Size": {"enum": [1, 2.5, "big", True]},
        },
    },
    "paths": {
        "/trees": {
            "parameters": [{"$ref": "#/components/parameters/Row"}, {"name": "trace", "in": "header", "schema": {"type": "string"}}, {"name": "c", "in": "cookie", "schema": {"type": "string"}}],
            "post": {
                "operationId": "plant", "security": [{"key": [], "flow": ["w"]}, {"token": []}],
                "parameters": [{"name": "trace", "in": "header", "required": True, "schema": {"type": "boolean"}}],
                "requestBody": {"content": {"text/plain": {"schema": {"type": "string"}}, "application/vnd.x+json": {"schema": {"$ref": "#/components/schemas/Tree"}}}},
                "responses": {"default": {"description": "x"}, "204": {"description": "x"}, "201": {"description": "x", "content": {"application/json": {"schema": {"type": "array", "items": {"type": "object", "properties": {"fruit": {"$ref": "#/components/schemas/Fruit"}, "size": {"$ref": "#/components/schemas/Size"}, "far": {"$ref": "other.json#/x"}, "many": {"type": ["string", "null"]}}}}}}}},
            },
            "get": {"deprecated": True, "responses": {"500": {"description": "x"}}},
        }
    },
}


def as_yaml(x, pad=0):
    """Block YAML of plain values; strings in JSON quotes, which YAML reads."""
    if isinstance(x, dict) and x:
        return "".join("\n" + " " * pad + json.dumps(str(k)) + ": " + as_yaml(v, pad + 2) for k, v in x.items())
    if isinstance(x, list) and x:
        return "".join("\n" + " " * pad + "- " + as_yaml(v, pad + 2).lstrip("\n ") for v in x)
    return json.dumps(x)


TEXTS = {"json": json.dumps(DOC)}
try:
    import yaml

    TEXTS["yaml"] = as_yaml(DOC).lstrip()
    assert yaml.safe_load(TEXTS["yaml"]) == DOC
except ModuleNotFoundError:  # YAML documents are problem rows where its reader is not installed
    pass


@pytest.fixture(scope="module", params=list(TEXTS))
def model(spark, request):
    specs = spark.createDataFrame([("p", "old", "x", TEXTS[request.param])], "pair_id string, side string, source string, content string")
    return documents.Model(documents.load(specs))


def test_operations(model):
    got = {r["method"]: r.asDict() for r in model.operations().collect()}
    post, get = got["post"], got["get"]
    assert (post["operation_id"], post["deprecated"], post["own_security"], post["security"]) == ("plant", False, True, ["flow", "key", "token"])
    assert (get["operation_id"], get["deprecated"], get["own_security"], get["security"]) == (None, True, False, ["token"])
    assert post["request_types"] == ["application/vnd.x+json", "text/plain"] and post["response_types"] == ["application/json"]
    assert post["statuses"] == ["201", "204", "default"] and get["statuses"] == ["500"] and get["response_types"] == []
    assert got.keys() == {"post", "get"} and get["ord"] < post["ord"]


def test_security_schemes(model):
    assert {(r["name"], r["description"]) for r in model.schemes().collect()} == {("token", "http bearer"), ("key", "apiKey in header named X-Key"), ("flow", "oauth2 flows clientCredentials, implicit"), ("oidc", "openIdConnect https://id.test"), ("odd", "unknown scheme")}
    assert [r["name"] for r in model.security().collect()] == ["token"]


def test_parameters(model):
    got = {(r["op_key"].split(" ")[0], r["location"], r["name"]): (r["required"], r["type"]) for r in model.params().collect()}
    assert got == {("GET", "query", "row"): (True, "integer:int32"), ("POST", "query", "row"): (True, "integer:int32"), ("GET", "header", "trace"): (False, "string"), ("POST", "header", "trace"): (True, "boolean")}


def test_fields(model):
    got = {(r["direction"], r["pointer"]): (r["parent"], r["required"], r["type"], r["enum_values"]) for r in model.fields().collect()}
    sub = lambda p: {k[1]: v for k, v in got.items() if k[0] == p}
    response = sub("response")
    assert response["[].fruit"] == ("[]", False, "oneOf<2: integer|string>", None)
    assert response["[].size"][2:] == ("unknown", ["1", "2.5", "big", "true"])
    assert response["[].far"][2] == "unknown" and response["[].many"][2] == "null|string"
    request = sub("request")
    assert request["name"] == ("", True, "string", None)  # the earlier member's property wins
    assert request["height"][:3] == ("", True, "number") and request["planted"][2] == "string:date"
    assert request["grafts"][2].startswith("array<") and request.keys() == {"name", "planted", "height", "grafts"}  # the cycle ends there


def _posting(schemas, schema):
    post = {"requestBody": {"content": {"application/json": {"schema": schema}}}, "responses": {}}
    return json.dumps({"openapi": "3.0.0", "info": {}, "paths": {"/x": {"post": post}}, "components": {"schemas": schemas}})


def _ref(name):
    return {"$ref": f"#/components/schemas/{name}"}


def _payload(text):
    return json.loads(documents.contract_of(text))["paths"]["/x"]["post"]["requestBody"]["payload"]


def test_shared_and_circular_references_cost_what_they_say():
    levels = {f"S{i}": {"type": "object", "properties": {"a": _ref(f"S{i + 1}"), "b": _ref(f"S{i + 1}")}} for i in range(30)} | {"S30": {"type": "string"}}
    begun = time.process_time()
    assert len(_payload(_posting(levels, _ref("S0")))) == sum(2**n for n in range(1, 8))
    assert time.process_time() - begun < 1
    round_ = {f"S{i}": {"type": "object", "properties": {f"p{j}": _ref(f"S{j}") for j in range(8)}} for i in range(8)}
    begun = time.process_time()
    assert len(_payload(_posting(round_, _ref("S0")))) == 69280
    assert time.process_time() - begun < 2
    chain = {f"S{i}": _ref(f"S{i + 1}") for i in range(400)} | {"S400": {"type": "object", "properties": {"x": {"type": "string"}}}, "L": _ref("M"), "M": _ref("L")}
    assert [f["pointer"] for f in _payload(_posting(chain, _ref("S0")))] == ["x"] and _payload(_posting(chain, _ref("L"))) == []


def test_a_document_that_would_explode_is_a_problem_row(spark):
    many = {f"S{i}": {"type": "object", "properties": {f"p{j}": _ref(f"S{j}") for j in range(14)}} for i in range(14)}
    rows = [("big", _posting(many, _ref("S0"))), ("number", '{"openapi": 3.0, "info": {}, "paths": {}}'), ("list", "[1]"), ("marked", "\ufeff" + _posting({}, {"type": "object"}))]
    loaded = documents.load(spark.createDataFrame([(n, "old", "x", t) for n, t in rows], "pair_id string, side string, source string, content string"))
    got = {r["pair_id"]: r["problem"] for r in loaded.collect()}
    assert "fields" in got["big"] and "openapi" in got["number"] and got["list"] and got["marked"] is None


def _written_out(doc, node, trail=()):
    """A schema as a tree, references and allOf written out."""
    if isinstance(node, list):
        return [_written_out(doc, x, trail) for x in node]
    if not isinstance(node, dict):
        return node
    if "$ref" in node:
        found = doc["components"]["schemas"].get(node["$ref"].rsplit("/", 1)[1]) if node["$ref"].startswith("#/") else None
        if found is None:
            return node
        if node["$ref"] in trail:
            return {k: v for k, v in found.items() if k in ("type", "format", "enum")} | ({"properties": {}} if "properties" in found else {})
        return _written_out(doc, found, (*trail, node["$ref"]))
    out = {k: _written_out(doc, v, trail) for k, v in node.items()}
    for m in out.pop("allOf", []):
        if "$ref" in m:
            continue
        if "type" in m:
            out.setdefault("type", m["type"])
        props = {**(m.get("properties") or {}), **(out.get("properties") or {})}
        if props:
            out["properties"] = props
        else:
            out.pop("properties", None)
        out["required"] = [*(m.get("required") or []), *(out.get("required") or [])]
    return out


def _tree_fields(node, parent="", depth=0):
    if "$ref" in node or depth > 6:
        return []
    if "oneOf" not in node and "anyOf" not in node and node.get("type") == "array":
        return _tree_fields(node.get("items") or {}, parent + "[]", depth + 1)
    out = []
    for k, v in (node.get("properties") or {}).items():
        p = f"{parent}.{k}" if parent else k
        out += [(p, k in (node.get("required") or []), v.get("format") if "$ref" not in v else None), *_tree_fields(v, p, depth + 1)]
    return out


def test_graphs_have_the_fields_of_trees():
    rng = random.Random(5)

    def schema(n, depth=0):
        x = rng.random()
        if x < 0.3:
            return _ref(f"S{rng.randrange(n + 1)}") if rng.random() < 0.95 else {"$ref": "other.json#/x"}
        if x < 0.5 or depth > 3:
            return rng.choice([{"type": "string"}, {"type": "string", "format": "date"}, {"type": "integer", "enum": [1, 2]}, {"enum": ["a", 1.5]}, {}, {"type": ["string", "null"]}])
        if x < 0.6:
            return {"type": "array", "items": schema(n, depth + 1)}
        if x < 0.7:
            return {rng.choice(["oneOf", "anyOf"]): [schema(n, depth + 1) for _ in range(rng.randint(1, 3))]}
        if x < 0.8:
            return {"allOf": [schema(n, depth + 1) for _ in range(rng.randint(1, 3))]} | ({"properties": {"own": schema(n, depth + 1)}} if rng.random() < 0.5 else {})
        return {"type": "object", "properties": {k: schema(n, depth + 1) for k in rng.sample("abcdef", rng.randint(0, 3))}, "required": rng.sample("abcdef", 2)}

    total = 0
    for _ in range(600):
        n = rng.randint(1, 4)
        text = _posting({f"S{j}": schema(n) for j in range(n)}, schema(n))
        doc = json.loads(text)
        want = _tree_fields(_written_out(doc, doc["paths"]["/x"]["post"]["requestBody"]["content"]["application/json"]["schema"]))
        got = [(f["pointer"], f["required"]) for f in _payload(text)]
        assert got == [w[:2] for w in want]
        total += len(got)
    assert total > 500


def test_every_kind_of_document_change(spark):
    new = json.loads(json.dumps(DOC))
    new["security"].append({"oidc": []})
    new["components"]["securitySchemes"]["key"]["name"] = "X-Other"
    new["servers"] = [{"url": "https://a.test"}, {"url": "https://b.test"}]  # the first has no counterpart
    op = new["paths"]["/trees"]["post"]
    op["deprecated"] = True
    del op["responses"]["204"]
    op["requestBody"]["content"]["application/xml"] = op["requestBody"]["content"].pop("text/plain")
    new["components"]["schemas"]["Size"]["enum"] = [1, "big", "huge"]
    new["components"]["schemas"]["Fruit"]["oneOf"].append({"type": "boolean"})
    rows = [("p", "old", "x", json.dumps(DOC)), ("p", "new", "y", json.dumps(new))]
    d = contract_diff.DocumentDiff(spark.createDataFrame(rows, "pair_id string, side string, source string, content string"))
    got = {(r["kind"], r["breaking"], r["from_name"], r["to_name"], r["method"]) for r in d.changes().collect()}
    d.close()
    assert got == {
        ("security.added", True, None, "oidc", None), ("security.scheme.changed", True, "key", "key", None), ("server.added", False, None, "https://b.test", None),
        ("operation.deprecated", False, None, None, "post"), ("response.status.removed", True, "204", None, "post"),
        ("content.type.removed", True, "text/plain", None, "post"), ("content.type.added", False, None, "application/xml", "post"),
        ("enum.value.removed", False, "[].size", "[].size", "post"), ("enum.value.added", True, "[].size", "[].size", "post"),
        ("response.field.type.changed", True, "[].fruit", "[].fruit", "post"),
    }


def test_a_folder_of_documents(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    good = _posting({}, {"type": "object", "properties": {"x": {"type": "string"}}})
    for name, data in (("a.json", good.encode()), ("deep/b.yaml", b"openapi: 3.0.0\ninfo: {title: Y}\npaths: {}\n"), ("large.json", good.encode() + b" " * 3000), ("bytes.json", b'{"openapi": "3.0.0", "x": "\xff\xfe"}'), ("torn.json", good[:40].encode()), ("empty.json", b"")):
        (tmp_path / name).write_bytes(data)
    specs = documents.read_documents(spark, str(tmp_path), max_bytes=2000)
    loaded = documents.load(specs.selectExpr("source AS pair_id", "'old' AS side", "*"))
    got = {r["source"].rsplit("/", 1)[1]: (r["problem"], r["title"]) for r in loaded.collect()}
    assert got["a.json"] == (None, "untitled api") and "more than 2000" in got["large.json"][0] and got["bytes.json"][0] == "not UTF-8"
    assert got["torn.json"][0] and len(got) == 5  # Spark lists no empty files
    if "yaml" in TEXTS:
        assert got["b.yaml"] == (None, "Y")
