"""OpenAPI documents as tables: parsing, references, and the normalised model."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlake.sources.schemas import Graph


#: Methods in the order of the model, and locations that callers fill.
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
LOCATIONS = ("path", "query", "header")
SCHEMA_MAP = "map<string,string>"
#: Fixed value: bytes of a document that is read.
MAX_BYTES = 24 << 20


def read_documents(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """source, content, problem of every file below a folder, JSON and YAML alike: what a text is shows when it is parsed.

    A file over `max_bytes` isn't read: it is a row with a problem, as is one that is no UTF-8; the others still load. Spark
    lists no empty files, so these give no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    none = F.lit(None).cast("string")
    large = files.filter(F.col("length") > max_bytes).select(F.col("path").alias("source"), none.alias("content"), F.concat(F.col("length").cast("string"), F.lit(f" bytes, more than {max_bytes}")).alias("problem"))
    text = F.col("content").cast("string")
    fine = F.is_valid_utf8(text)
    read = files.filter(F.col("length") <= max_bytes).select(F.col("path").alias("source"), F.when(fine, text).alias("content"), F.when(~fine, "not UTF-8").alias("problem"))
    return read.unionByName(large)


def contract_of(text: str) -> str:
    """The contract of a document, as JSON."""
    return _json(_contract(text))


def _contract(text: str) -> dict:
    """What a JSON or YAML document says as a contract: info, servers, security, and operations with the types of their
    parameters and the fields of their payloads. References are followed where they are met; those to other documents, and
    those that lead nowhere, are unknown. A reference back into the schema that is being walked keeps its type, format and
    enum and loses its members, which is where walks of a cyclic document stop.
    """
    stripped = text.lstrip("\ufeff \t\r\n")
    named = stripped.startswith(("{", "["))  # keys are strings already
    if named:
        doc = json.loads(stripped)
    else:
        import yaml

        doc = yaml.safe_load(text)
    if not isinstance(doc, dict):
        raise ValueError("not an object")
    graph, payloads = Graph(doc), {}

    def of(node) -> dict:
        """A part other than a schema, references followed."""
        seen = set()
        while isinstance(node, dict) and isinstance(node.get("$ref"), str) and node["$ref"] not in seen:
            seen.add(node["$ref"])
            node = graph.at(node["$ref"]) if node["$ref"].startswith("#/") else None
        return {} if not isinstance(node, dict) else node if named else {str(k): v for k, v in node.items()}

    def payload(content: dict):
        """Fields of application/json, else of the first type with json in its name, else of the first by name."""
        names = ["application/json"] if "application/json" in content else [n for n in content if "json" in n] or sorted(content)
        schema = of(content[names[0]]).get("schema") if names else None
        if schema is None:
            return None
        key = schema.get("$ref") if isinstance(schema, dict) and isinstance(schema.get("$ref"), str) else id(schema)
        if key not in payloads:
            payloads[key] = graph.fields(graph.view(schema))
        return payloads[key]

    def parameters(items) -> list[dict]:
        found = [of(p) for p in items] if isinstance(items, list) else []
        return [{k: p.get(k) for k in ("name", "in", "required")} | {"schema": graph.facts(graph.view(p.get("schema")))} for p in found]

    def operation(raw) -> dict:
        o = of(raw)
        out = {k: o[k] for k in ("operationId", "deprecated", "security") if k in o}
        if "parameters" in o:
            out["parameters"] = parameters(o["parameters"])
        body = of(of(o.get("requestBody")).get("content"))
        if o.get("requestBody") is not None:
            out["requestBody"] = {"content": {k: {} for k in body}, "payload": payload(body)}
        replies = of(o.get("responses"))
        good = min((s for s in replies if s.startswith("2")), default=None)
        out["responses"] = {}
        for status, reply in replies.items():
            content = of(of(reply).get("content"))
            out["responses"][status] = {"content": {k: {} for k in content}} | ({"payload": payload(content)} if status == good else {})
        return out

    paths = {}
    for path, item in of(doc.get("paths")).items():
        item = of(item)
        paths[path] = {m: operation(item[m]) for m in METHODS if isinstance(item.get(m), dict)} | ({"parameters": parameters(item["parameters"])} if "parameters" in item else {})
    info = of(doc.get("info"))
    schemes = {k: of(v) for k, v in of(of(doc.get("components")).get("securitySchemes")).items()}
    out = {"info": {k: _text(info[k]) for k in ("title", "version") if info.get(k) is not None}, "paths": paths, "components": {"securitySchemes": schemes}}
    out |= {k: doc[k] for k in ("servers", "security", "swagger") if k in doc}
    if isinstance(doc.get("openapi"), str):
        out["openapi"] = doc["openapi"]
    return out


def _json(value: dict) -> str:
    return json.dumps(value, ensure_ascii=False, default=str)


def _text(v):
    return v if isinstance(v, (str, int, float, bool)) else str(v)


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_S, _B, _L, _TEXTS = T.StringType(), T.BooleanType(), T.LongType(), T.ArrayType(T.StringType())
_FACTS = {"type": _S, "schema_fp": _S, "enum_values": _TEXTS}
_FIELDS = T.ArrayType(_struct(pointer=_S, name=_S, parent=_S, required=_B, **_FACTS))
_PARAMS = T.ArrayType(_struct(location=_S, name=_S, required=_B, ord=_L, **_FACTS))
#: What an operation says of itself, and an operation as it leaves Python.
OWN = {"op_key": _S, "path": _S, "method": _S, "ord": _L, "operation_id": _S, "deprecated": _B, "security": _TEXTS, "own_security": _B, "request_types": _TEXTS, "response_types": _TEXTS, "statuses": _TEXTS}
OPERATION = _struct(**OWN, params=_PARAMS, request=_FIELDS, response=_FIELDS)
_PARSED = _struct(doc=_S, head=_S, operations=T.ArrayType(OPERATION), problem=_S)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(pa.field("element", _arrow(kind.elementType)))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind])
    return {_S: pa.string(), _B: pa.bool_(), _L: pa.int64()}[kind]


#: Ranks of an operation's own parameters begin here, after those that its path shares.
OWN_PARAMS = 100_000


def _said(v) -> str | None:
    """A value of a contract as the text it has there."""
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str, separators=(",", ":"))


def _true(v) -> bool:
    return v is True or v == "true"


def _required_names(security) -> list[str]:
    """The schemes that a list of requirements names; anything else requires none."""
    asked = json.loads(_json(security)) if isinstance(security, list) else None
    return sorted({k for m in asked for k in m}) if isinstance(asked, list) and all(isinstance(m, dict) for m in asked) else []


def _operations(contract: dict) -> list[dict]:
    """The operations of a contract, each with its parameters (an own one hides the shared one of its name) and payload fields."""
    whole, out = _required_names(contract.get("security")), []
    for at, (path, item) in enumerate(contract["paths"].items()):
        shared = list(enumerate(item.get("parameters") or ()))
        for place, method in enumerate(METHODS):
            o = item.get(method)
            if o is None:
                continue
            params: dict[tuple[str, str], dict] = {}
            for rank, p in [*shared, *enumerate(o.get("parameters") or (), OWN_PARAMS)]:
                name, location = _said(p["name"]), _said(p["in"])
                if name is not None and location in LOCATIONS:
                    first = params.get((location, name), {"ord": rank})["ord"]
                    params[location, name] = {"location": location, "name": name, "required": _true(p["required"]), "ord": first, **p["schema"]}
            body, replies = o.get("requestBody") or {}, o["responses"]
            good = replies.get(min((s for s in replies if s.startswith("2")), default=None)) or {}
            out.append({
                "op_key": f"{method.upper()} {path}", "path": path, "method": method, "ord": at * 8 + place, "operation_id": _said(o.get("operationId")), "deprecated": _true(o.get("deprecated")),
                "security": _required_names(o["security"]) if "security" in o else whole, "own_security": "security" in o,
                "request_types": sorted(body.get("content", ())), "response_types": sorted(good.get("content", ())), "statuses": sorted(replies),
                "params": list(params.values()), "request": body.get("payload"), "response": good.get("payload"),
            })
    return out


def _parsed(texts: pa.Array, whole: bool) -> pa.Array:
    """doc (where `whole`), head, operations and problem of each text."""
    kind, rows = _arrow(_PARSED), []
    for text in texts.to_pylist():
        try:
            said = _contract(text or "")
            row = {"doc": _json(said) if whole else None, "head": _json({k: v for k, v in said.items() if k != "paths"}), "operations": _operations(said)}
            rows.append(pa.array([row], kind))
        except Exception as e:  # a bad document is a row with its problem, not a failed job
            rows.append(pa.array([{"problem": f"{type(e).__name__}: {e}"[:300].encode("utf-8", "replace").decode()}], kind))
    return pa.concat_arrays(rows) if rows else pa.array([], kind)


@F.arrow_udf(_PARSED)
def parse_document(content: pa.Array) -> pa.Array:
    return _parsed(content, True)


@F.arrow_udf(_PARSED)
def parse_operations(content: pa.Array) -> pa.Array:
    return _parsed(content, False)


def load(specs: DataFrame, whole: bool = True) -> DataFrame:
    """specs: pair_id, side, source, content. Adds doc, head (doc without its paths), operations (see OPERATION), problem, title, version, primary_server; bad
    rows keep a problem, and those that came with one their own; neither have operations. Not `whole`: without doc."""
    unread = F.col("problem") if "problem" in specs.columns else F.lit(None).cast("string")
    specs = specs.withColumn("_unread", unread).drop("problem")
    parse, made = (parse_document, ("doc", "head", "operations")) if whole else (parse_operations, ("head", "operations"))
    parsed = specs.withColumn("p", parse("content")).select(*[c for c in specs.columns if c != "content"], *[f"p.{c}" for c in made], "p.problem")
    get = lambda p: F.get_json_object("head", p)
    version = F.when(F.col("problem").isNull() & get("$.openapi").isNull(), F.when(get("$.swagger").isNotNull(), "Swagger 2.0 is not supported").otherwise("no openapi version"))
    judged = parsed.withColumn("problem", F.coalesce("_unread", "problem", version)).drop("_unread")
    return judged.withColumns({
        "operations": F.when(F.col("problem").isNull(), F.col("operations")),
        "title": F.coalesce(get("$.info.title"), F.lit("untitled api")), "version": F.coalesce(get("$.info.version"), F.lit("unknown")), "primary_server": get("$.servers[0].url"),
    })


def _map(text) -> Column:
    return F.from_json(text, SCHEMA_MAP)


def _keys(text):
    empty = F.array().cast("array<string>")
    return F.coalesce(F.array_sort(F.map_keys(_map(text))), empty)


class Model:
    """Normalised tables of loaded documents (rows with a problem are left out).

    `read`: raw_operations where they are written, a row an operation.
    """

    def __init__(self, loaded: DataFrame, read: DataFrame | None = None) -> None:
        self.docs, self.read = loaded.filter("problem IS NULL"), read

    def servers(self) -> DataFrame:
        got = self.docs.select("pair_id", "side", F.posexplode(F.from_json(F.get_json_object("head", "$.servers"), "array<struct<url:string>>")).alias("pos", "s"))
        return got.select("pair_id", "side", "pos", F.col("s.url").alias("url"))

    def security(self) -> DataFrame:
        return self.docs.select("pair_id", "side", F.explode(_requirement_names(F.get_json_object("head", "$.security"))).alias("name"))

    def schemes(self) -> DataFrame:
        rows = self.docs.select("pair_id", "side", F.explode(_map(F.get_json_object("head", "$.components.securitySchemes"))).alias("name", "s"))
        g = lambda p: F.get_json_object("s", p)
        kind = g("$.type")
        say = (
            F.when(kind == "apiKey", F.concat(F.lit("apiKey in "), g("$.in"), F.lit(" named "), g("$.name"))).when(kind == "http", F.concat(F.lit("http "), g("$.scheme")))
            .when(kind == "oauth2", F.concat(F.lit("oauth2 flows "), F.array_join(_keys(g("$.flows")), ", "))).when(kind == "openIdConnect", F.concat(F.lit("openIdConnect "), g("$.openIdConnectUrl"))).otherwise("unknown scheme")
        )
        return rows.filter(kind.isNotNull()).select("pair_id", "side", "name", say.alias("description"))

    def raw_operations(self) -> DataFrame:
        if self.read is not None:
            return self.read
        return self.docs.select("pair_id", "side", F.explode("operations").alias("o"))

    def operations(self) -> DataFrame:
        return self.raw_operations().select("pair_id", "side", *[f"o.{c}" for c in OWN])

    def params(self) -> DataFrame:
        rows = self.raw_operations().select("pair_id", "side", "o.op_key", F.explode("o.params").alias("p"))
        return rows.select("pair_id", "side", "op_key", *[f"p.{c}" for c in ("location", "name", "required", "ord", "type", "enum_values")])

    def fields(self) -> DataFrame:
        """Payload fields in reading order."""
        bodies = F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"o.{d}").alias("c")) for d in ("request", "response")])
        both = self.raw_operations().select("pair_id", "side", "o.op_key", F.explode(bodies).alias("b"))
        return both.select("pair_id", "side", "op_key", F.col("b.d").alias("direction"), F.posexplode("b.c").alias("ord", "f")).select("pair_id", "side", "op_key", "direction", "ord", "f.*")


def _requirement_names(text):
    names = F.transform(F.from_json(text, f"array<{SCHEMA_MAP}>"), lambda m: F.map_keys(m))
    return F.coalesce(F.array_sort(F.array_distinct(F.flatten(names))), F.array().cast("array<string>"))
