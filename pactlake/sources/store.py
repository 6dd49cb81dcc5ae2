"""Tracked specs, snapshots, runs, changes and edits as append-only tables with a commit log.

A commit writes its rows as Parquet parts and then one marker that names them: readers see the parts of markers alone, so
all of a commit's tables appear together or not at all, whatever stops in between. Markers are numbered; two writers that
would write the same number can't both succeed. Every marker has the schema version its parts were written in, and parts of
earlier versions get what later ones added when they are read. A marker may carry a transaction (a stream and its batch
number): a batch that comes again is known.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.operators import history

_COUNTS = "breaking long, sites long, applied long, review long"
#: Tables of each schema version: a table's first columns, or columns that a version adds, with the value of older rows.
MIGRATIONS: list[dict[str, str | list[tuple[str, str, object]]]] = [
    {
        "specs": "name string, source string, repo string, tracked boolean, at timestamp",
        "snapshots": "spec string, version string, hash string, content string, at timestamp",
        "checks": "spec string, at timestamp",
        "runs": f"run_id string, spec string, old_version string, new_version string, repo string, started_at timestamp, finished_at timestamp, status string, error string, {_COUNTS}",
        "changes": "run_id string, change_id string, kind string, breaking boolean, confidence string, payload string",
        "edits": "run_id string, change_id string, file string, line int, strategy string, confidence string, action string, detail string",
    },
    {"runs": [("pr_url", "string", None)], "snapshots": [("seq", "long", None)]},
]


class CommitConflict(RuntimeError):
    """Another writer made the commit that this one was about to make."""


class Store:
    """Tables under `root`, a folder of any store that Spark and all its executors reach."""

    def __init__(self, spark: SparkSession, root: str, schema_version: int = len(MIGRATIONS)) -> None:
        self.spark, self.root, self.schema_version = spark, root.rstrip("/"), schema_version
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- log ----

    def markers(self) -> list[dict]:
        """The commits since the last compaction, in order."""
        log = self._path(f"{self.root}/_log")
        if not self._fs.exists(log):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(log)]
        if not any(n.endswith(".json") for n in names):
            return []
        rows = self.spark.read.option("pathGlobFilter", "*.json").text(f"{self.root}/_log", wholetext=True).collect()
        found = sorted((json.loads(r["value"]) for r in rows), key=lambda m: m["version"])
        newest = max((m["schema"] for m in found), default=0)
        if newest > self.schema_version:
            raise ValueError(f"the store has schema version {newest}, this engine knows {self.schema_version}")
        first = max((i for i, m in enumerate(found) if m.get("compacted")), default=0)
        return found[first:]

    def version(self) -> int:
        return max((m["version"] for m in self.markers()), default=0)

    def last_batch(self, stream: str) -> int:
        """The number of the last batch of a stream that was committed; -1: none."""
        return max((m["batches"].get(stream, -1) for m in self.markers()), default=-1)

    def commit(self, tables: dict[str, DataFrame], batch: tuple[str, int] | None = None, expected: int | None = None, compacted: bool = False) -> int:
        """Add rows to tables at once; returns the commit's number. `expected`: the version that the rows were made from."""
        before = self.markers()
        version = max((m["version"] for m in before), default=0)
        if expected is not None and version != expected:
            raise CommitConflict(f"the store is at version {version}, not {expected}")
        folder, parts = f"data/{uuid.uuid4().hex}", {}
        for name, df in tables.items():
            schema = self.schema(name)
            df.select([F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(f"{self.root}/{folder}/{name}")
            parts[name] = f"{folder}/{name}"
        batches = {}
        for m in before if compacted else []:
            batches |= m["batches"]
        if batch:
            batches[batch[0]] = batch[1]
        marker = {"version": version + 1, "schema": self.schema_version, "parts": parts, "batches": batches, "compacted": compacted}
        self._publish(f"{self.root}/_log/{version + 1:012d}.json", json.dumps(marker))
        return version + 1

    def _publish(self, path: str, text: str) -> None:
        """The marker stands whole or not at all: it is written aside and renamed, which fails where it exists."""
        aside, final = self._path(f"{self.root}/_log/.{uuid.uuid4().hex}"), self._path(path)
        out = self._fs.create(aside)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise CommitConflict(f"{path} was written by another")

    # ---- tables ----

    def schema(self, name: str, version: int | None = None):
        text = MIGRATIONS[0][name]
        for step in MIGRATIONS[1 : version or self.schema_version]:
            text += "".join(f", {c} {kind}" for c, kind, _ in step.get(name, []))
        return self.spark.createDataFrame([], text).schema

    def table(self, name: str) -> DataFrame:
        """All committed rows of a table with `commit`, the number of their commit."""
        whole = self.spark.createDataFrame([], self.schema(name)).withColumn("commit", F.lit(0).cast("long"))
        by_schema: dict[int, list[tuple[int, str]]] = {}
        for m in self.markers():
            if name in m["parts"]:
                by_schema.setdefault(m["schema"], []).append((m["version"], m["parts"][name]))
        for written_in, parts in by_schema.items():
            df = self.spark.read.schema(self.schema(name, written_in)).parquet(*[f"{self.root}/{p}" for _, p in parts])
            number = F.create_map(*[F.lit(x) for v, p in parts for x in (p.split("/")[1], v)])
            df = df.withColumn("commit", F.try_element_at(number, F.regexp_extract(F.col("_metadata.file_path"), r"/data/([0-9a-f]{32})/", 1)).cast("long"))
            for step in MIGRATIONS[written_in : self.schema_version]:
                df = df.withColumns({c: F.lit(value).cast(kind) for c, kind, value in step.get(name, [])})
            whole = whole.unionByName(df)
        return whole

    def specs(self) -> DataFrame:
        """Tracked specs by name, with the markers of their last snapshot and check."""
        now = history.latest(self.table("specs"), ["name"], ["commit", "at"]).filter("tracked").drop("tracked", "commit")
        seen = self.snapshots().select(F.col("spec").alias("name"), F.col("version").alias("last_seen_version"), F.col("hash").alias("last_hash"))
        checked = self.table("checks").groupBy(F.col("spec").alias("name")).agg(F.max("at").alias("last_checked_at"))
        return now.join(seen, "name", "left").join(checked, "name", "left")

    def snapshots(self) -> DataFrame:
        """The last snapshot of each spec that was taken since it was last untracked."""
        gone = self.table("specs").filter("NOT tracked").groupBy(F.col("name").alias("spec")).agg(F.max("commit").alias("gone"))
        last = history.latest(self.table("snapshots"), ["spec"], ["commit", "seq", "at"])
        return last.join(gone, "spec", "left").filter("gone IS NULL OR commit > gone").drop("gone")

    def runs(self) -> DataFrame:
        """Each run as it was last written, with its spec's name while that is tracked."""
        last = history.latest(self.table("runs"), ["run_id"], ["commit"]).drop("commit")
        kept = self.specs().select(F.col("name").alias("spec"), F.col("name").alias("spec_name"))
        return last.join(kept, "spec", "left")

    def list_runs(self, limit: int = 20) -> DataFrame:
        return self.runs().orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)

    def track(self, specs: DataFrame) -> int:
        """specs: name, source, repo. A spec that is tracked already gets the new source and repo."""
        return self.commit({"specs": specs.select("name", "source", "repo", F.lit(True).alias("tracked"), F.current_timestamp().alias("at"))})

    def untrack(self, names: DataFrame) -> int:
        """names: name. Their snapshots go with them; their runs stay."""
        return self.commit({"specs": self.specs().join(names, "name", "left_semi").select("name", "source", "repo", F.lit(False).alias("tracked"), F.current_timestamp().alias("at"))})

    def compact(self) -> int:
        """One commit that holds what all commits so far hold: fewer parts to read. Rows keep their order."""
        at = self.version()
        specs = history.latest(self.table("specs"), ["name"], ["commit", "at"]).filter("tracked")
        checks = self.table("checks").groupBy("spec").agg(F.max("at").alias("at"))
        runs = history.latest(self.table("runs"), ["run_id"], ["commit"])
        tables = {"specs": specs, "snapshots": self.snapshots(), "checks": checks, "runs": runs, "changes": self.table("changes"), "edits": self.table("edits")}
        return self.commit(tables, expected=at, compacted=True)
