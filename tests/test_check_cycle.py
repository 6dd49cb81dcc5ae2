"""A check of tracked documents: outcomes, counters, what moves on, exit code, files for other programs."""

import json
import pathlib
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from pactlake.operators import artifacts, edits, grouping
from pactlake.plans import check_cycle, contract_diff, demo


@pytest.fixture(scope="module")
def cycle(spark):
    c = check_cycle.CheckCycle(*demo.tracked(spark))
    yield c
    c.close()


def test_outcomes(cycle):
    got = {r["spec"]: r.asDict() for r in cycle.outcomes().collect()}
    assert {k: v["status"] for k, v in got.items()} == {"parcels": "changed", "first": "baseline", "same": "unchanged", "torn": "failed", "never": "failed"}
    c = got["parcels"]
    assert (c["breaking"], c["sites"], c["applied"], c["review"]) == (7, 6, 3, 3)
    assert (c["old_version"], c["new_version"], got["first"]["new_version"]) == ("2.3.0", "3.0.0", "2.3.0")
    assert "Swagger" in got["never"]["error"] and got["torn"]["error"] and c["error"] is None
    assert cycle.exit_code().first()[0] == 2


def test_snapshots_move_on_only_after_a_good_check(spark, cycle):
    old, new = demo.documents()
    got = {r["spec"]: r["content"] for r in cycle.snapshots().collect()}
    assert got == {"parcels": new, "first": old, "same": old, "torn": old}
    later = check_cycle.CheckCycle(cycle.snapshots(), demo.tracked(spark)[1])
    again = {r["spec"]: r["status"] for r in later.outcomes().collect()}
    assert again == {"parcels": "unchanged", "first": "unchanged", "same": "unchanged", "torn": "failed", "never": "failed"}
    later.close()


def test_sites_are_of_the_spec_own_repository(cycle):
    assert {r["repo"] for r in cycle.edits.select("repo").distinct().collect()} == {"parcels"}


def test_nothing_tracked(spark):
    snapshots, current, _ = demo.tracked(spark)
    c = check_cycle.CheckCycle(snapshots.limit(0), current.limit(0))
    assert c.outcomes().count() == 0 and c.exit_code().first()[0] == 0 and c.snapshots().count() == 0
    c.close()


def test_json_lines(cycle):
    lines = [json.loads(r["json"]) for r in artifacts.change_lines(cycle.changes).collect()]
    assert len(lines) == 8 and all(None not in x.values() for x in lines)
    by = {x["kind"]: x for x in lines if x["kind"] != "path.renamed"}
    assert by["response.field.type.changed"]["target"] == {"location": "response", "from": "events[].at", "to": "events[].at", "fromType": "string", "toType": "integer"}
    assert by["operation.added"]["breaking"] is False and "target" not in by["operation.added"]
    done = {x["spec"]: x for x in (json.loads(r["json"]) for r in artifacts.outcome_lines(cycle.outcomes()).collect())}
    assert done["parcels"] == {"spec": "parcels", "status": "changed", "oldVersion": "2.3.0", "newVersion": "3.0.0", "breaking": 7, "sites": 6, "applied": 3, "review": 3}
    assert done["same"] == {"spec": "same", "status": "unchanged"}


def test_update_description(cycle):
    r = edits.pull_request(cycle.edits, cycle.changes).first()
    assert (r["applied"], r["review"], r["files_changed"], r["total"], r["breaking"]) == (3, 3, 1, 8, 7)
    assert r["title"] == "Update API usage for 7 breaking changes"
    body = r["body"].split("\n")
    assert sum(x.startswith("- `src/parcels.ts:") for x in body) == 3 and sum(x.startswith("- [ ] `src/parcels.ts:") for x in body) == 3
    none = edits.pull_request(cycle.edits.limit(0), cycle.changes.limit(0)).first()
    assert none["applied"] == 0 and edits.PATCHED_NONE in none["body"] and edits.OPEN_NONE in none["body"]


def test_patched_files_stay_in_their_folder(spark, tmp_path):
    names = ["a.ts", "src/b.ts", "../c.ts", "/etc/d", "x/../../e", "C:\\f", "..dots/ok.ts"]
    files = spark.createDataFrame([(n, "text") for n in names], "file string, content string")
    refused = edits.write_patched(files, str(tmp_path / "out"))
    assert {r["file"] for r in refused.collect()} == {"../c.ts", "/etc/d", "x/../../e", "C:\\f"}
    assert {r["file"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a.ts", "src/b.ts", "..dots/ok.ts"}


def test_breaking_only_report(spark):
    d = contract_diff.DocumentDiff(demo.specs(spark))
    lines = [x for r in grouping.report_lines(d.changes(), d.header(), breaking_only=True).collect() for x in r["lines"]]
    assert "BREAKING (7)" in lines and not any(x.startswith("NON") for x in lines) and not any("depots" in x for x in lines)
    same = contract_diff.DocumentDiff(demo.specs(spark).withColumn("content", F.lit(demo.documents()[0])))
    lines = [x for r in grouping.report_lines(same.changes(), same.header()).collect() for x in r["lines"]]
    assert grouping.NONE in lines
    for x in (d, same):
        x.close()


@pytest.mark.parametrize("left", ["nothing", "pipeline", "folder"])
def test_entry_without_the_optional_part(tmp_path, left):
    """The optional folder and the pipeline gone, or one of them left behind, or an empty folder in its place."""
    top = pathlib.Path(__file__).resolve().parent.parent
    shutil.copytree(top / "pactlake", tmp_path / "pactlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    if left != "nothing" and (top / "corpus_pipeline.py").exists():
        shutil.copy(top / "corpus_pipeline.py", tmp_path)
    if left == "folder":
        (tmp_path / "pactlake" / "llm").mkdir()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'field_diff' in q and not any(x.startswith('op1_') or x == 'pipeline' for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
