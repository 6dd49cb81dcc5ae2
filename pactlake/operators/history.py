"""Tracked documents, snapshots and runs as append-only logs with latest-row views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlake.functions.text import content_hash
from pactlake.work import written

#: The last row of each spec, as a stream carries it on.
KEPT = "spec string, seq long, hash string"


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; partial aggregation keeps one row a key and task."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def upsert(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `incoming` replace those of `current` with the same key."""
    return current.join(incoming.select(*key).distinct(), key, "left_anti").unionByName(incoming)


def untrack(specs: DataFrame, snapshots: DataFrame, runs: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Specs and their snapshots go, runs stay without their spec. names: name; specs: name, spec_id."""
    gone = specs.join(names, "name", "left_semi").select("spec_id").withColumn("_gone", F.lit(True))
    kept_runs = runs.join(gone, "spec_id", "left").withColumn("spec_id", F.when(F.col("_gone").isNull(), F.col("spec_id"))).drop("_gone")
    return specs.join(names, "name", "left_anti"), snapshots.join(gone, "spec_id", "left_anti"), kept_runs.select(runs.columns)


def batch_statuses(ranged: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statuses, new state) of one micro-batch. ranged: spec, seq, hash, range; kept: spec, seq, hash of the last rows.

    A key is split into ranges of seq; rows with equal seq share one. Lag is taken within a range, and what stands before
    a range (the last row of the ranges below or the stored one) is one row a key and range.
    """
    rows = Window.partitionBy("spec", "range").orderBy("seq", "hash")
    new = F.col("seq").isNotNull() & (F.lag("seq").over(rows).isNull() | (F.lag("seq").over(rows) < F.col("seq")))
    own = ranged.withColumn("new", new)
    before = F.last(F.when(F.col("new"), F.struct("seq", "hash")), ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("before", before)
    ends = own.filter("new").groupBy("spec", "range").agg(F.max_by(F.struct("seq", "hash"), "seq").alias("e")).select("spec", "range", "e.*")
    ends = ends.unionByName(kept.withColumn("range", F.lit(-1)))
    # Of equal seqs the stored row came first.
    top = F.struct("seq", (-F.col("range")).alias("r"), "hash")
    below = Window.partitionBy("spec").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    floors = ends.select("spec", "range", F.max(top).over(below).alias("floor")).filter("range >= 0")
    # Ranges of null seqs alone have no end; their rows are late.
    full = own.join(floors.withColumnsRenamed({"spec": "_s", "range": "_r"}), F.col("spec").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r")), "left")
    late = ~F.col("new") | F.coalesce(F.col("seq") <= F.col("floor.seq"), F.lit(False))
    near = F.col("before").isNotNull() & (F.col("floor").isNull() | (F.col("before.seq") > F.col("floor.seq")))
    last = F.when(near, F.col("before.hash")).otherwise(F.col("floor.hash"))
    status = F.when(late, "late").when(last.isNull(), "baseline").when(F.coalesce(last == F.col("hash"), F.lit(False)), "unchanged").otherwise("changed")
    state = ends.groupBy("spec").agg(F.max(top).alias("t")).select("spec", "t.seq", "t.hash")
    return full.select("spec", "seq", "hash", status.alias("status")), state


def snapshot_status(snapshots: DataFrame) -> DataFrame:
    """spec, seq, hash and status of each snapshot (spec, seq, content) against the one before: baseline, unchanged or changed.

    The hash is computed before the shuffle, so contents do not travel. Rows are dealt out by ranges of (spec, seq), so that a
    spec of very many snapshots is many tasks. Of equal seqs the smaller hash comes first; the others, and rows without a
    seq, are `late`.
    """
    hashed = snapshots.select("spec", "seq", content_hash("content").alias("hash"))
    ranged, _ = written(hashed.repartitionByRange("spec", "seq").withColumn("range", F.spark_partition_id()), "snapshots")
    kept = hashed.limit(0)
    return batch_statuses(ranged, kept)[0]


def run_history(runs: DataFrame, specs: DataFrame, limit: int) -> DataFrame:
    """Newest runs first with the name of their spec, if it is still tracked."""
    return runs.join(specs, "spec_id", "left").orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def exit_code(outcomes: DataFrame, *by: str) -> DataFrame:
    """2 if any check failed, 1 if any found breaking changes, else 0; over all outcomes or by columns."""
    code = F.when(F.col("failed"), 2).when(F.col("breaking") > 0, 1).otherwise(0)
    return outcomes.groupBy(*by).agg(F.coalesce(F.max(code), F.lit(0)).alias("exit_code"))
