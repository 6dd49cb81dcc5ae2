"""The engine's own queries against DuckDB, and what SQL cannot express against brute force."""

import decimal
import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from pactlake import catalog
from pactlake.operators import call_sites, edits, history, matching
from pactlake.plans import contract_diff, demo
from pactlake.streaming import checks

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.6g}"
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, list | tuple) else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    want = duck.execute(catalog.oracle_sql()[name])
    at = [[d[0] for d in want.description].index(c) for c in cols]
    assert len(at) == len(want.description)
    assert sorted(tuple(map(plain, r)) for r in df.select(*cols).collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_greedy_pairs_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(b, f, t, float(rng.randrange(4)), 1) for b in range(12) for f, t in itertools.product(range(5), range(5)) if rng.random() < 0.6]
    want = set()
    for b in range(12):
        left, right = set(), set()
        for _, f, t, s, _ in sorted((r for r in rows if r[0] == b), key=lambda r: (-r[3], r[1], r[2])):
            if f not in left and t not in right:
                left.add(f)
                right.add(t)
                want.add((b, f, t, s))
    got = matching.greedy_pairs(spark.createDataFrame(rows, "b int, from_ord int, to_ord int, score double, conf int"), ["b"])
    assert {(r["b"], r["from_ord"], r["to_ord"], r["score"]) for r in got.collect()} == want


def test_bad_documents_are_rows_with_a_problem(spark):
    old, new = demo.documents()
    rows = [("a", "old", "x.json", old), ("a", "new", "y.json", new), ("b", "old", "x.json", "{"), ("c", "old", "x.json", '{"swagger": "2.0"}'), ("d", "old", "x.json", None)]
    d = contract_diff.DocumentDiff(spark.createDataFrame(rows, "pair_id string, side string, source string, content string"))
    assert sorted(r["pair_id"] for r in d.problems().collect()) == ["b", "c", "d"]
    assert d.changes().filter("pair_id = 'a'").count() == 8
    d.close()


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, i, f"text {random.Random(s + str(i // 3)).randrange(3)}") for s in "abc" for i in range(12)]
    schema = "spec string, seq long, content string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = checks.check_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("statuses").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["spec"], r["seq"], r["status"]) for r in spark.table("statuses").collect()}
    want = history.snapshot_status(spark.createDataFrame(rows, schema)).select("spec", F.col("seq"), "status")
    assert got == {tuple(r) for r in want.collect()}


def test_entry_works_without_the_optional_part(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    top = pathlib.Path(__file__).resolve().parent.parent
    shutil.copytree(top / "pactlake", tmp_path / "pactlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'field_diff' in q and not any(x.startswith('op1_') or x == 'pipeline' for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_call_sites_in_source_code(spark):
    schema = "id string, kind string, breaking boolean, direction string, path string, method string, operation_id string, from_name string, to_name string"
    found = spark.createDataFrame([
        ("p", "path.renamed", True, None, "/v1/charges", None, None, "/v1/charges", "/v1/payments"),
        ("f", "request.field.renamed", True, "request", "/v1/charges", "post", "create", "amount", "cents"),
        ("r", "operation.removed", True, None, "/v1/old/{id}", "get", "getOld", None, None),
        ("n", "operation.added", False, None, "/v1/charges", "get", None, None, None),
    ], schema)
    texts = {
        "axios": 'api.post("/v1/charges", { amount: 3, other: amount });\n',
        "value": "fetch('/v1/charges?x=1', { method: 'POST', body: JSON.stringify({ 'a': 1, amount: total }) });",
        "wrong": "fetch('/v1/charges/7'); fetch('/v2/charges', { method: 'PUT' }); // fetch(url)\n",
        "gone": "\n\nfetch(`${b}/v1/old/${x}`);\nclient.get_old(3); sdk.getOld (4);\n",
        "wrapped": "request('/v1/charges');",
        "empty": "",
        "none": None,
    }
    files = spark.createDataFrame([("repo", k, v) for k, v in texts.items()], "repo string, file string, content string")
    rows = call_sites.find_sites(files, found, wrappers=("request",)).collect()
    assert all(texts[r["file"]][r["start_at"] : r["end_at"]] == r["text"] for r in rows)
    assert sorted((r["file"], r["change_id"], r["text"], r["replacement"] or "", r["line"]) for r in rows) == [
        ("axios", "f", "amount", "cents", 1), ("axios", "p", '"/v1/charges"', '"/v1/payments"', 1),
        ("gone", "r", "`${b}/v1/old/${x}`", "", 3), ("gone", "r", "client.get_old", "", 4), ("gone", "r", "sdk.getOld", "", 4),
        ("value", "f", "amount", "cents", 1), ("value", "p", "'/v1/charges?x=1'", "'/v1/payments?x=1'", 1),
        ("wrapped", "p", "'/v1/charges'", "'/v1/payments'", 1),
    ]
    assert call_sites.find_sites(files.limit(0), found).count() == 0
