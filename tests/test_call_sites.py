"""Sites in source code: payloads, declared request functions, bindings and types, and the scan that they rest on."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pactlake.operators import call_sites as cs
from pactlake.sources import projects
from pactlake.sources.source_code import Scan, facts_of

NAMES = ("id", "kind", "direction", "path", "method", "operation_id", "from_name", "to_name", "detail")
REQUEST = {"id": "f", "kind": "request.field.renamed", "direction": "request", "path": "/v1/charges", "method": "post", "from_name": "amount", "to_name": "cents"}
RESPONSE = {"id": "r", "kind": "response.field.renamed", "direction": "response", "path": "/v1/charges/{id}", "method": "get", "from_name": "data.amount", "to_name": "data.cents"}
MOVED = {"id": "p", "kind": "path.renamed", "path": "/v1/charges", "from_name": "/v1/charges", "to_name": "/v1/payments"}


def sites(spark, texts, changes, wrappers=(), base_urls=None):
    rows = [tuple(c.get(n) for n in NAMES) + (True,) for c in changes]
    ch = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in NAMES) + ", breaking boolean")
    files = spark.createDataFrame([("repo", k, v) for k, v in texts.items()], "repo string, file string, content string")
    out = cs.find_sites(files, ch, wrappers, base_urls).collect()
    for r in out:
        assert texts[r.file][r.start_at : r.end_at] == r.text and r.line == texts[r.file][: r.start_at].count("\n") + 1
    return sorted((r.file, r.line, r.text, r.replacement, r.strategy, r.confidence) for r in out)


def test_only_the_payload_of_the_call_is_edited(spark):
    texts = {
        "no_semicolon": "http.post('/v1/charges', { total: 1 })\nconst other = { amount: 2 }\nshow({ amount: 3 })\n",
        "nested": "http.post('/v1/charges', { meta: { amount: 1 }, amount: 2 })",
        "sum": "http.post('/v1/' + 'charges', { amount: 1 })",
        "one_object": "axios({ url: `/v1/charges`, method: 'post', data: { amount } })",
        "quoted": "http.post('/v1/charges', { \"amount\": 1 })",
        "text": "fetch('/v1/charges', { method: 'POST', body: JSON.stringify({ id: f(')}'), amount: a ? b : c }), other: { amount: 1 } })",
        "spread": "http.put('/v1/charges', { amount: 1 }); http.post('/v1/charges', { ...rest, amount /* , amount */, ['amount']: 3 })",
        "comment": "// http.post('/v1/charges', { amount: 1 })\nconst s = `http.post('/v1/charges', { amount: ${1} })`; const re = /post('\\/v1\\/charges', {amount: 1}/",
        "inner": "log(`${http.post('/v1/charges', { amount: 5 })}`)",
    }
    high = ("request.payload", "high")
    assert sites(spark, texts, [REQUEST]) == [
        ("inner", 1, "amount", "cents", *high), ("nested", 1, "amount", "cents", *high), ("one_object", 1, "amount", "cents: amount", *high), ("quoted", 1, '"amount"', '"cents"', *high),
        ("spread", 1, "amount", "cents: amount", *high), ("sum", 1, "amount", "cents", *high), ("text", 1, "amount", "cents", *high),
    ]


def test_declared_request_functions(spark):
    texts = {
        "wrapped": "const api = { make: (amount) => request('POST', '/v1/charges', { amount }) };\nrequest('GET', '/v1/charges', { amount: 1 });\nthis.http.send('/x', 'https://api.test/v1/charges')",
        "plain": "send('https://api.test/v1/charges'); other('/v1/charges'); request('POST'); http.get(BASE + '/v1/charges' + tail)",
    }
    rules = [cs.Wrapper("request", 1, 2, 0), cs.Wrapper("this.http.send", 1), cs.Wrapper("send", 0, repo="repo"), cs.Wrapper("other", 0, repo="another")]
    bases = spark.createDataFrame([("repo", "https://api.test")], "repo string, base_url string")
    assert sites(spark, texts, [REQUEST, MOVED], rules, bases) == [
        ("plain", 1, "'https://api.test/v1/charges'", "'https://api.test/v1/payments'", "url.literal", "high"),
        ("wrapped", 1, "'/v1/charges'", "'/v1/payments'", "url.literal", "high"), ("wrapped", 1, "amount", "cents: amount", "request.payload", "high"),
        ("wrapped", 2, "'/v1/charges'", "'/v1/payments'", "url.literal", "high"), ("wrapped", 3, "'https://api.test/v1/charges'", "'https://api.test/v1/payments'", "url.literal", "high"),
    ]


def test_reads_of_bound_variables_only(spark):
    texts = {
        "decoded": "async function a(id) {\n const r = await fetch(`/v1/charges/${id}`);\n const body = await r.json();\n wallet.amount; body.amount; body.data.amount; body.other.amount;\n { const body = 1; body.amount }\n}\nbody.amount",
        "axios": "async function b(id) {\n const { data } = await axios.get('/v1/charges/' + id);\n const whole = await axios.get(`/v1/charges/${id}`);\n return data.amount + whole.data.amount + data.x.amount;\n}",
        "other": "async function c() { const r = await fetch('/v1/refunds/1'); const body = await r.json(); return body.amount }",
        "then": "const r = fetch('/v1/charges/1').then(x => x.json()); r.amount",
    }
    medium = ("cents", "response.member", "medium")
    assert sites(spark, texts, [RESPONSE]) == [("axios", 4, "amount", *medium), ("axios", 4, "amount", *medium), ("decoded", 4, "amount", *medium), ("decoded", 4, "amount", *medium)]


def test_types_carry_a_rename_to_every_file(spark):
    texts = {
        "types": "export interface Charge {\n  id: string\n  readonly amount?: number\n  nested: { amount: number }\n}\nexport type Wallet = { amount: number };",
        "api": "export async function get(id: string): Promise<Charge> {\n const r = await fetch(`/v1/charges/${id}`);\n return (await r.json()) as Charge;\n}",
        "reader": "const show = (c: Charge, w: Wallet) => `${c.amount} ${w.amount}`;\nasync function f(id) { const one = await get(id); const two = one; return two.amount + one.amount; }",
        "array": "const sum = (all: Charge[]) => all.amount; const x: Charge | null = get(); x.amount",
        "returned": "function g(id): Promise<Charge> { return request(`/v1/charges/${id}`) }",
    }
    high = ("cents", "response.member", "high")
    want = [("reader", 1, "amount", *high), ("reader", 2, "amount", *high), ("reader", 2, "amount", *high), ("types", 3, "amount", "cents", "response.type", "high")]
    assert sites(spark, texts, [RESPONSE]) == want
    assert sites(spark, {k: v for k, v in texts.items() if k != "api"}, [RESPONSE], ["request"]) == [w for w in want if w[1] != 2]
    changed = RESPONSE | {"kind": "response.field.type.changed", "to_name": "data.amount", "detail": "amount is text"}
    assert sites(spark, texts, [changed]) == [("types", 3, "amount", None, "response.type", "high")]
    twice = texts | {"more": "interface Charge { amount: number }"}  # two types of that name: neither is sure
    assert sites(spark, twice, [RESPONSE]) == []


def test_one_site_a_place_and_reason(spark):
    detail = {"kind": "response.field.type.changed", "direction": "response", "method": "get", "from_name": "amount", "to_name": "amount", "detail": "amount is text"}
    texts = {"a": "interface C { amount: number }\nfunction g(): Promise<C> { return request('/v1/charges') }\nfunction h(): Promise<C> { return request(`/v1/charges/${id}`) }"}
    assert sites(spark, texts, [detail | {"id": "1", "path": "/v1/charges"}, detail | {"id": "2", "path": "/v1/charges/{id}"}], ["request"]) == [("a", 1, "amount", None, "response.type", "high")]


def test_project_folders(spark, tmp_path):
    root = tmp_path / "my repo"
    for name in ("src/a.ts", "src/deep/b.mjs", "node_modules/x/c.js", "src/dist/d.ts", "README.md", "distant/e.jsx"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"// {name} é")
    found = {r.file: (r.repo, r.content) for r in projects.read_project(spark, str(root), "r").collect()}
    assert found == {n: ("r", f"// {n} é") for n in ("src/a.ts", "src/deep/b.mjs", "distant/e.jsx")}
    for bad in (root / "missing", root / "README.md", root / "node_modules/x"):
        if bad.name != "x":
            with pytest.raises(projects.ScanTargetError):
                projects.read_project(spark, str(bad))
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("x")
    with pytest.raises(projects.ScanTargetError):
        projects.read_project(spark, str(tmp_path / "docs"))


def test_settings(spark, tmp_path):
    text = '{"baseUrl": "https://api.test", "requestFunctions": [{"name": "request", "methodArgument": 0, "urlArgument": 1, "bodyArgument": 2}]}'
    assert projects.parse_config({}) == (None, [])
    for raw in ([], {"requestFunctions": [{"urlArgument": 1}]}, {"requestFunctions": [{"name": "x", "urlArgument": -1}]}, {"requestFunctions": [{"name": "x", "urlArgument": "1"}]}, {"requestFunctions": [{"name": "x", "urlArgument": 0, "bodyArgument": 0.5}]}, {"baseUrl": 42}, {"requestFunctions": {}}):
        with pytest.raises(projects.ConfigError):
            projects.parse_config(raw)
    rows = spark.createDataFrame([("a", text), ("b", "{"), ("c", '{"baseUrl": "/x"}'), ("d", None)], "repo string, content string")
    found = sorted(map(tuple, projects.config_table(rows).collect()))
    assert found[0] == ("a", "https://api.test", "request", 1, 2, 0, None) and found[1][0] == "b" and found[1][-1] and found[2] == ("c", "/x", None, None, None, None, None) and len(found) == 3
    assert projects.read_config(spark, str(tmp_path)).count() == 0
    (tmp_path / "scanner.json").write_text(text)
    assert projects.read_config(spark, str(tmp_path), "a").first().name == "request"
    (tmp_path / "scanner.json").write_text("[]")
    with pytest.raises(projects.ConfigError):
        projects.read_config(spark, str(tmp_path))


CODE = st.lists(st.sampled_from(["fetch(", "'/a'", "`", "${", "}", "{", ")", "(", "[", "]", "a", ".", "b", ",", ":", "=", "const x =", "=>", "/", "//", "\n", "/*", "*/", '"', "'", "\\", "<T>", "as T", "return", "interface T {", "await", "!", "?", "é", "😀"]), max_size=25).map(" ".join)


@settings(max_examples=400, deadline=None)
@given(CODE)
def test_any_text_is_scanned(text):
    s = Scan(text)
    assert all(a < b <= len(text) for a, b in zip(s.a, s.b))
    assert s.a == sorted(s.a)
    for f in facts_of(text):
        assert f["kind"] in {"call", "object", "declare", "function", "type", "member"}


def test_a_large_file_takes_time_in_proportion():
    facts = facts_of("async function f(a: T) { const r = await fetch(`/v1/${a}`, { body: JSON.stringify({ x: 1, y: [a.b] }) }); return r.data.z; }\n" * 3000)
    assert sum(f["kind"] == "call" for f in facts) == 6000


def test_the_scan_of_one_small_table_is_dealt_to_all_cores(spark):
    text = "export async function load() {\n  const r = await fetch('/v1/charges', { method: 'GET' });\n  return (await r.json()) as Charge;\n}\n"
    files = spark.range(400).coalesce(1).selectExpr("'repo' AS repo", "concat('f', id) AS file", f"\"{text}\" AS content".replace("\n", "\\n"))
    code = cs.Code(files)
    tasks = {f.rsplit("/", 1)[1].split("-")[1] for f in code.of("call").inputFiles()}
    assert len(tasks) > 4 and code.of("call").count() == 800
    code.close()


def test_facts_of_many_files_leave_a_worker_together():
    import pyarrow as pa

    from pactlake.sources import source_code

    schema = source_code._arrow_schema(None)
    rows = [{"repo": "r", "file": str(i)} | f for i in range(3) for f in facts_of("fetch('/v1/a', { body: x })")]
    batch = source_code._facts_batch(rows, schema)
    assert batch.num_rows == len(rows) and pa.Table.from_batches([batch])["file"].to_pylist() == [r["file"] for r in rows]
