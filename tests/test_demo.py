"""The demo's documents and caller, in every step, against what was worked out by hand."""

import duckdb
import pytest

from pactlake.operators import artifacts, call_sites, edits, grouping
from pactlake.plans import contract_diff, demo
from pactlake.work import written
from pyspark.sql import functions as F

#: kind, method, path, location, names and types, and whether it breaks.
_DEMO_CHANGES = """SELECT *, substr(sha1(concat_ws('|', kind, coalesce(method, ''), path, coalesce(location, ''), coalesce(a, ''), coalesce(b, ''), coalesce(ta, ''), coalesce(tb, ''))), 1, 10) AS id FROM (VALUES
('path.renamed', 'post', '/v2/parcels', 'path', '/v2/parcels', '/v2/shipments', NULL, NULL, true),
('path.renamed', 'get', '/v2/parcels/{ref}/events', 'path', '/v2/parcels/{ref}/events', '/v2/shipments/{ref}/events', NULL, NULL, true),
('request.field.renamed', 'post', '/v2/parcels', 'body', 'weight', 'weight_grams', NULL, NULL, true),
('enum.value.added', 'post', '/v2/parcels', 'response', 'state', 'state', NULL, NULL, true),
('response.field.type.changed', 'get', '/v2/parcels/{ref}/events', 'response', 'events[].at', 'events[].at', 'string', 'integer', true),
('param.added.required', 'get', '/v2/parcels/{ref}/events', 'query', NULL, 'zone', NULL, 'string', true),
('operation.removed', 'delete', '/v2/labels/{label}', NULL, NULL, NULL, NULL, NULL, true),
('operation.added', 'get', '/v2/depots', NULL, NULL, NULL, NULL, NULL, false)) t(kind, method, path, location, a, b, ta, tb, breaking)"""



#: Worked out by hand from the demo's caller: line, kind, action, text and replacement of each site.
_DEMO_SITES = """(8, 'path.renamed', 'apply', '`${HOST}/v2/parcels`', '`${HOST}/v2/shipments`', 1), (8, 'request.field.renamed', 'apply', 'weight', 'weight_grams', 1),
(11, 'path.renamed', 'apply', '`${HOST}/v2/parcels/${ref}/events`', '`${HOST}/v2/shipments/${ref}/events`', 1), (11, 'param.added.required', 'review', '`${HOST}/v2/parcels/${ref}/events`', NULL, 1),
(5, 'response.field.type.changed', 'review', 'at', NULL, 1), (16, 'operation.removed', 'review', 'client.voidLabel', NULL, 1)"""



#: The report of the demo, written out by hand.
_DEMO_REPORT = """API diff: Parcel desk
  old  v2.json (2.3.0)
  new  v3.json (3.0.0)

  7 breaking, 1 non breaking

BREAKING (7)

  DELETE /v2/labels/{label}
    operation.removed  [high]
      DELETE /v2/labels/{label} removed

  POST /v2/parcels
    enum.value.added  [high]
      state can now return held

  POST /v2/parcels
    path.renamed  [high]
      /v2/parcels -> /v2/shipments

  POST /v2/parcels
    request.field.renamed  [high]
      weight -> weight_grams

  GET /v2/parcels/{ref}/events
    param.added.required  [high]
      new required query parameter zone (string)

  GET /v2/parcels/{ref}/events
    path.renamed  [high]
      /v2/parcels/{ref}/events -> /v2/shipments/{ref}/events

  GET /v2/parcels/{ref}/events
    response.field.type.changed  [high]
      events[].at string -> integer

NON BREAKING (1)

  GET /v2/depots
    operation.added  [high]
      GET /v2/depots added
"""


@pytest.fixture(scope="module")
def found(spark):
    return written(contract_diff.diff_documents(demo.specs(spark)), "demo")[0]


@pytest.fixture(scope="module")
def planned(spark, found):
    return written(edits.plan_edits(call_sites.find_sites(demo.files(spark), found), found), "demo")[0]


def of_sql(text):
    return sorted(map(str, duckdb.sql(text).fetchall()))


def test_changes_and_their_json(found):
    got = found.select("id", "kind", "method", "path", "breaking").collect()
    assert sorted(str(tuple(r)) for r in got) == of_sql(f"SELECT id, kind, method, path, breaking FROM ({_DEMO_CHANGES}) c")
    g = lambda p: F.get_json_object("json", p)
    lines = artifacts.change_lines(found).select(g("$.id"), g("$.target.from"), g("$.target.toType")).collect()
    assert sorted(str(tuple(r)) for r in lines) == of_sql(f"SELECT id, a, tb FROM ({_DEMO_CHANGES}) c")


def test_no_two_changes_are_alike(found):
    r = grouping.grouping_summary(found).first()
    assert (r.groups, r.total) == (8, 8)


def test_sites_and_actions(planned, found):
    got = planned.join(found.select(F.col("id").alias("change_id"), "kind"), "change_id").groupBy("line", "kind", "action", "text", "replacement").count()
    assert sorted(str(tuple(r)) for r in got.collect()) == of_sql(f"SELECT * FROM (VALUES {_DEMO_SITES}) t")


def test_edits_are_spliced(spark, planned):
    changed, _ = edits.splice(planned.filter("action = 'apply'").withColumnRenamed("replacement", "after_text"), demo.files(spark).select("file", "content"))
    want = demo.CALLER.replace("/v2/parcels", "/v2/shipments").replace("{ weight: weight,", "{ weight_grams: weight,")
    assert [r["content"] for r in changed.collect()] == [want]


def test_report(spark):
    d = contract_diff.DocumentDiff(demo.specs(spark))
    rows = grouping.report_lines(d.changes(), d.header()).select("section", "ord", F.posexplode("lines").alias("place", "line")).collect()
    d.close()
    assert [r.line for r in sorted(rows, key=lambda r: (r.section, r.ord, r.place))] == _DEMO_REPORT.split("\n")


def test_fix_of_two_repositories(spark):
    from pactlake.plans.fix import Fix

    found = contract_diff.diff_documents(demo.specs(spark))
    changes = written(found.withColumn("repo", F.explode(F.array(F.lit("one"), F.lit("two"), F.lit("none")))).withColumn("id", F.concat_ws(":", "repo", "id")), "demo")[0]
    other = demo.CALLER.replace("weight: weight", "weight: kilos")
    files = spark.createDataFrame([("one", "src/a.ts", demo.CALLER), ("two", "src/a.ts", other), ("two", "README.md", "no code")], "repo string, file string, content string")
    f = Fix(files, changes)
    patched = {(r.repo, r.file): r.content for r in f.patched.collect()}
    change = lambda text: text.replace("/v2/parcels", "/v2/shipments").replace("{ weight: ", "{ weight_grams: ")
    assert patched == {("one", "src/a.ts"): change(demo.CALLER), ("two", "src/a.ts"): change(other)}
    assert sorted((r.repo, r.outcome == "applied") for r in f.edits.collect()) == [(repo, x) for repo in ("one", "two") for x in (False, False, False, True, True, True)]
    pulls = {r.repo: r for r in f.pull_requests().collect()}
    assert {k: (r.applied, r.review, r.files_changed, r.total) for k, r in pulls.items()} == {"one": (3, 3, 1, 8), "two": (3, 3, 1, 8), "none": (0, 0, 0, 8)}
    assert "`src/a.ts:8` weight -> weight_grams" in pulls["one"].body and "Nothing met the bar" in pulls["none"].body
    lines = [(r.repo, r.part) for r in f.lines().collect()]
    assert {p: lines.count(("one", p)) for p in ("change", "edit", "pull_request")} == {"change": 8, "edit": 6, "pull_request": 1}
    f.close()
