"""Checks of many versions at once, kept in a store, in batches or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlake.functions.text import content_hash
from pactlake.operators import artifacts, call_sites, edits, history
from pactlake.plans.check_cycle import BASELINE, CHANGED, FAILED, UNCHANGED
from pactlake.plans.contract_diff import BATCH_DOCUMENTS, DocumentDiff
from pactlake.sources.documents import load
from pactlake.sources.store import Store
from pactlake.work import discard, written


class VersionChecks:
    """The checks of versions (spec, seq, source, content), each against the last good one before it.

    Equal to one check after the other in order of seq, from the stored snapshots (spec, content) on: a version that can't be
    read fails and leaves the baseline where it was. All versions that changed are compared in one comparison. Only hashes
    are put in order by spec; contents travel for those that changed. Of rows with the same spec and seq the smaller hash
    comes first; rows without a seq come first of all. files: repo (the spec they call), file, content.
    """

    def __init__(self, snapshots: DataFrame, versions: DataFrame, files: DataFrame | None = None) -> None:
        self._spark, self._paths = versions.sparkSession, []
        texts = versions.select("spec", F.col("seq").cast("long").alias("seq"), "source", "content", content_hash("content").alias("hash")).dropDuplicates(["spec", "seq", "hash"])
        self._texts = self._keep(texts.withColumn("key", F.sha2(F.concat_ws("\u0001", "spec", F.coalesce(F.col("seq").cast("string"), F.lit("")), "hash"), 256)))
        self._loaded = self._keep(load(self._texts.select(F.col("key").alias("pair_id"), F.lit("new").alias("side"), "source", "content")).select(F.col("pair_id").alias("key"), "problem", F.col("version").alias("new_version")), BATCH_DOCUMENTS)
        slim = self._texts.select("spec", "seq", "hash", "key").join(self._loaded, "key")
        stored = snapshots.select("spec", F.lit(None).cast("long").alias("seq"), content_hash("content").alias("hash"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("problem"), F.lit(None).cast("string").alias("new_version"))
        order = Window.partitionBy("spec").orderBy("stored", F.asc_nulls_first("seq"), "hash").rowsBetween(Window.unboundedPreceding, -1)
        rows = slim.withColumn("stored", F.lit(1)).unionByName(stored.withColumn("stored", F.lit(0)))
        before = F.last(F.when(F.col("problem").isNull(), F.struct("hash", "key")), ignorenulls=True).over(order)
        rows = rows.withColumn("before", before).filter("stored = 1").drop("stored")
        status = F.when(F.col("problem").isNotNull(), FAILED).when(F.col("before").isNull(), BASELINE).when(F.col("before.hash") == F.col("hash"), UNCHANGED).otherwise(CHANGED)
        self.checks = self._keep(rows.withColumn("status", status))
        moved = self.checks.filter(F.col("status") == CHANGED).select("key", "spec", F.col("before.key").alias("old_key"))
        new = moved.join(self._texts.select("key", "source", "content"), "key").select(F.col("key").alias("pair_id"), F.lit("new").alias("side"), "source", "content")
        earlier = self._texts.select(F.col("key").alias("old_key"), "source", "content")
        old = moved.join(earlier, "old_key").unionByName(moved.filter("old_key IS NULL").join(snapshots.select("spec", "content"), "spec").select("old_key", "key", "spec", F.lit("stored").alias("source"), "content"))
        self._diff = DocumentDiff(new.unionByName(old.select(F.col("key").alias("pair_id"), F.lit("old").alias("side"), "source", "content")))
        found = self._diff.changes().join(moved.select(F.col("key").alias("pair_id"), F.col("spec").alias("repo")), "pair_id")
        self.changes = self._keep(found.withColumn("id", F.concat_ws(":", "pair_id", "id")))
        self.edits = None if files is None else self._keep(edits.plan_edits(call_sites.find_sites(files, self.changes), self.changes).join(self.changes.select(F.col("id").alias("change_id"), F.col("pair_id").alias("key")), "change_id"))

    def _keep(self, df: DataFrame, batch: int | None = None) -> DataFrame:
        out, path = written(df, "versions", batch=batch)
        self._paths.append(path)
        return out

    def outcomes(self) -> DataFrame:
        """spec, seq, key, status, old_version, new_version, breaking, sites, applied, review, error."""
        old = self._diff.loaded.filter("side = 'old'").select(F.col("pair_id").alias("key"), F.col("version").alias("old_version"))
        joined = self.checks.join(old, "key", "left").join(self.changes.groupBy(F.col("pair_id").alias("key")).agg(F.count_if("breaking").alias("breaking")), "key", "left")
        if self.edits is not None:
            joined = joined.join(self.edits.groupBy("key").agg(F.count("*").alias("sites"), F.count_if(F.col("action") == "apply").alias("applied"), F.count_if(F.col("action") == "review").alias("review")), "key", "left")
        number = lambda c: F.when(F.col("status") == CHANGED, F.coalesce(F.col(c) if c in joined.columns else F.lit(None), F.lit(0))).cast("long").alias(c)
        new = F.when(F.col("status").isin(CHANGED, BASELINE), F.col("new_version")).alias("new_version")
        return joined.select("spec", "seq", "key", "status", F.when(F.col("status") == CHANGED, F.col("old_version")).alias("old_version"), new, *map(number, ("breaking", "sites", "applied", "review")), F.col("problem").alias("error"))

    def snapshots(self) -> DataFrame:
        """spec, seq, version, hash, content: the last good version of each spec whose baseline moves."""
        good = self.checks.filter(F.col("status").isin(BASELINE, CHANGED))
        last = good.groupBy("spec").agg(F.max_by(F.struct("key", "seq", "hash", "new_version"), F.struct(F.coalesce("seq", F.lit(-(1 << 63))), "hash")).alias("r"))
        return last.select("spec", "r.*").join(self._texts.select("key", "content"), "key").select("spec", "seq", F.col("new_version").alias("version"), "hash", "content")

    def close(self) -> None:
        self._diff.close()
        discard(self._spark, *self._paths)
        self._paths = []


def check_into(store: Store, versions: DataFrame, files: DataFrame | None = None, batch: tuple[str, int] | None = None, stop=None) -> int | None:
    """One check, recorded in the store; returns its last commit, None where this batch was recorded before.

    Runs are first recorded as running. Their ends, changes, edits, the checks made and the baselines that move appear in one
    commit: a check that stops before it leaves the baselines, and the next one sees the same changes. `stop` is called
    between the two.
    """
    if batch and batch[1] <= store.last_batch(batch[0]):
        return None
    at = store.version()
    c = VersionChecks(store.snapshots().select("spec", "content"), versions, files)
    try:
        name, now = F.col("key"), F.current_timestamp()
        run = F.concat_ws("-", F.lit(f"{at:012d}"), F.coalesce(F.lpad(F.col("seq").cast("string"), 20, "0"), F.lit("")), name)
        done = c.outcomes().filter(F.col("status") == CHANGED).withColumn("run_id", run).withColumn("started_at", F.lit(None).cast("timestamp"))
        repo = store.specs().select(F.col("name").alias("spec"), "repo")
        done, path = written(done.drop("started_at").join(repo, "spec", "left").withColumn("started_at", now), "runs")
        at = store.commit({"runs": done.select("run_id", "spec", "old_version", "new_version", "repo", "started_at", F.lit("running").alias("status"))}, expected=at)
        if stop:
            stop()
        ids = done.select("key", "run_id")
        changes = c.changes.join(ids.withColumnRenamed("key", "pair_id"), "pair_id")
        payload = artifacts.change_lines(c.changes.withColumn("pair_id", F.col("id"))).select(F.col("pair_id").alias("id"), F.col("json").alias("payload"))
        tables = {
            "runs": done.select("run_id", "spec", "old_version", "new_version", "repo", "started_at", now.alias("finished_at"), F.lit("success").alias("status"), "breaking", "sites", "applied", "review"),
            "changes": changes.join(payload, "id").select("run_id", F.col("id").alias("change_id"), "kind", "breaking", "confidence", "payload"),
            "checks": c.outcomes().filter(F.col("status") != FAILED).select("spec").distinct().withColumn("at", now),
            "snapshots": c.snapshots().withColumn("at", now),
        }
        if c.edits is not None:
            detail = F.to_json(F.struct(F.col("text").alias("before"), F.col("replacement").alias("after"), F.col("reason")))
            tables["edits"] = c.edits.join(ids, "key").select("run_id", "change_id", "file", "line", "strategy", "confidence", "action", detail.alias("detail"))
        at = store.commit(tables, batch, expected=at)
        discard(store.spark, path)
        return at
    finally:
        c.close()


def check_stream(store: Store, versions: DataFrame, name: str, folder: str, files: DataFrame | None = None):
    """A running query that checks a stream of versions (spec, seq, source, content) against the store, batch by batch.

    Any split of the input into batches leaves the same baselines, changes and outcomes of runs; a batch that comes again
    after a failure is known by its number. `folder` holds the stream's own progress.
    """

    def step(batch: DataFrame, number: int) -> None:
        held, path = written(batch, "stream-batch")
        check_into(Store(store.spark, store.root), held, files, (name, number))
        discard(store.spark, path)

    return versions.writeStream.foreachBatch(step).option("checkpointLocation", folder).trigger(availableNow=True).start()


def exit_code(outcomes: DataFrame) -> DataFrame:
    return history.exit_code(outcomes.select((F.col("status") == FAILED).alias("failed"), F.coalesce("breaking", F.lit(0)).alias("breaking")))
