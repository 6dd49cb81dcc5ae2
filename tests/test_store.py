"""The store's commits, and checks that are recorded in it: batches, replays, splits and stops."""

import json

import pytest
from pyspark.sql import functions as F

from pactlake.plans import demo, version_checks
from pactlake.sources import store as st


def specs(spark, *rows):
    return spark.createDataFrame(rows, "name string, source string, repo string")


def versions(spark, rows):
    return spark.createDataFrame(rows, "spec string, seq long, source string, content string")


def history_of():
    """Versions of three specs: a change and back, a torn one between, one seen once, one that never reads."""
    old, new = demo.documents()
    return [("a", 1, "x", old), ("a", 2, "x", old), ("a", 3, "x", new[:-5]), ("a", 4, "x", new), ("a", 5, "x", old), ("b", 2, "x", new), ("c", 1, "x", "{"), ("c", 6, "x", '{"swagger": "2.0"}')]


def snapshot(store, spec, version, content):
    row = store.spark.createDataFrame([(spec, version, "h-" + content, content)], "spec string, version string, hash string, content string")
    return store.commit({"snapshots": row.withColumn("at", F.current_timestamp())})


def test_specs_and_snapshots(spark, tmp_path):
    s = st.Store(spark, str(tmp_path / "store"))
    assert s.version() == 0 and s.specs().count() == 0 and s.list_runs().count() == 0
    s.track(specs(spark, ("zulip", "z", None), ("acme", "a", "./app")))
    s.track(specs(spark, ("acme", "a2", None)))
    snapshot(s, "acme", "1.0", "one")
    snapshot(s, "acme", "2.0", "two")
    got = {r["name"]: r for r in s.specs().collect()}
    assert got.keys() == {"acme", "zulip"} and (got["acme"]["source"], got["acme"]["repo"], got["acme"]["last_seen_version"], got["acme"]["last_hash"]) == ("a2", None, "2.0", "h-two")
    assert [r["content"] for r in s.snapshots().collect()] == ["two"]
    s.commit({"runs": spark.createDataFrame([("1", "acme", "1.0", "2.0", "running")], "run_id string, spec string, old_version string, new_version string, status string").withColumn("started_at", F.current_timestamp())})
    s.untrack(spark.createDataFrame([("acme",)], "name string"))
    assert s.snapshots().count() == 0 and [(r["run_id"], r["spec_name"]) for r in s.list_runs().collect()] == [("1", None)]
    s.track(specs(spark, ("acme", "again", None)))
    assert s.snapshots().count() == 0  # the old one does not come back
    before = {n: sorted(map(str, getattr(s, n)().drop("commit").collect())) for n in ("specs", "snapshots", "runs")}
    version = s.compact()
    assert len(s.markers()) == 1 and s.version() == version
    assert before == {n: sorted(map(str, getattr(s, n)().drop("commit").collect())) for n in ("specs", "snapshots", "runs")}


def test_commits_are_whole_or_absent(spark, tmp_path):
    root = tmp_path / "store"
    s = st.Store(spark, str(root))
    s.track(specs(spark, ("a", "x", None)))
    (root / "data" / "torn" / "specs").mkdir(parents=True)  # a writer that stopped before its marker
    (root / "_log" / ".aside").write_text('{"version":')
    assert [r["name"] for r in st.Store(spark, str(root)).specs().collect()] == ["a"]
    with pytest.raises(st.CommitConflict):
        s.commit({"specs": specs(spark, ("b", "x", None))}, expected=0)
    with pytest.raises(st.CommitConflict):
        s._publish(f"{root}/_log/{1:012d}.json", "{}")
    assert s.version() == 1


def test_parts_of_earlier_schemas_are_read_as_the_present_one(spark, tmp_path):
    old = st.Store(spark, str(tmp_path / "store"), schema_version=1)
    snapshot(old, "a", "1", "one")
    now = st.Store(spark, str(tmp_path / "store"))
    snapshot(now, "b", "2", "two")
    got = {r["spec"]: r.asDict() for r in now.table("snapshots").collect()}
    assert got["a"]["seq"] is None and got["a"]["commit"] == 1 and got["b"]["commit"] == 2
    with pytest.raises(ValueError):
        old.markers()


def recorded(store):
    """What a history of checks leaves, without times and numbers of commits."""
    short = lambda i: i.split("-", 1)[1]
    runs = sorted((short(r["run_id"]), r["spec"], r["old_version"], r["new_version"], r["status"], r["breaking"], r["sites"], r["applied"], r["review"]) for r in store.runs().collect())
    changes = sorted((short(r["run_id"]), r["change_id"], r["kind"], json.loads(r["payload"])["detail"]) for r in store.table("changes").collect())
    found = sorted((short(r["run_id"]), r["file"], r["line"], r["action"]) for r in store.table("edits").collect())
    return runs, changes, found, sorted((r["spec"], r["seq"], r["content"]) for r in store.snapshots().collect())


def test_any_split_of_a_stream_leaves_what_one_check_leaves(spark, tmp_path):
    rows, files = history_of(), demo.files(spark).withColumn("repo", F.lit("a"))
    whole = st.Store(spark, str(tmp_path / "whole"))
    version_checks.check_into(whole, versions(spark, rows), files)
    want = recorded(whole)
    old, new = demo.documents()
    assert [r[1:6] for r in want[0]] == [("a", "2.3.0", "3.0.0", "success", 7), ("a", "3.0.0", "2.3.0", "success", want[0][1][5])]
    assert want[3] == [("a", 5, old), ("b", 2, new)] and len(want[1]) > 8 and want[2]
    feed = tmp_path / "feed"
    for part in (rows[:3] + rows[6:7], rows[3:6], rows[7:]):
        versions(spark, part).coalesce(1).write.mode("append").parquet(str(feed))
    split = st.Store(spark, str(tmp_path / "split"))
    stream = spark.readStream.schema(versions(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(str(feed))
    for folder in ("log", "log-lost"):  # the second run has lost its progress: every batch comes again
        assert version_checks.check_stream(split, stream, "feed", str(tmp_path / folder), files).awaitTermination(1200)
        assert recorded(split) == want
    assert split.last_batch("feed") == 2


def test_a_stop_between_the_writes_leaves_the_baseline(spark, tmp_path):
    old, new = demo.documents()
    s = st.Store(spark, str(tmp_path / "store"))
    version_checks.check_into(s, versions(spark, [("a", 1, "x", old)]))
    with pytest.raises(KeyboardInterrupt):

        def stop():
            raise KeyboardInterrupt

        version_checks.check_into(s, versions(spark, [("a", 2, "x", new)]), stop=stop)
    assert [r["content"] for r in s.snapshots().collect()] == [old] and s.table("changes").count() == 0
    assert [(r["status"], r["finished_at"]) for r in s.list_runs().collect()] == [("running", None)]
    version_checks.check_into(s, versions(spark, [("a", 2, "x", new)]))
    assert [r["content"] for r in s.snapshots().collect()] == [new] and s.table("changes").count() == 8
    assert [r["status"] for r in s.list_runs(1).collect()] == ["success"]
