"""One check of tracked documents: compare with the snapshot, diff what changed, plan edits, then move the baseline on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.functions.text import content_hash
from pactlake.operators import call_sites, edits, history
from pactlake.plans.contract_diff import BATCH_DOCUMENTS, DocumentDiff
from pactlake.sources.documents import load
from pactlake.work import discard, written

BASELINE, UNCHANGED, CHANGED, FAILED = "baseline", "unchanged", "changed", "failed"


class CheckCycle:
    """Frames of one check: `outcomes`, `changes`, `edits`, `snapshots`.

    snapshots: spec, content (the last good text); current: spec, source, content (what was read now); files, if there are
    any: repo (the spec whose contract they call), file, content. Specs with the same text as before cost a hash each;
    only changed ones are parsed and compared, all in one comparison. A spec is named once in `current`.

    A spec that can't be read, now or as it was, fails alone: its outcome has the error and its snapshot stays. Snapshots
    move on only in the frame that `snapshots` returns, so a check that stops half-way sees the same changes again.
    """

    def __init__(self, snapshots: DataFrame, current: DataFrame, files: DataFrame | None = None) -> None:
        self._spark, self._paths = current.sparkSession, []
        self._old = snapshots.select("spec", F.col("content").alias("old_content"))
        hashed = current.join(self._old, "spec", "left")
        status = F.when(F.col("old_content").isNull(), BASELINE).when(content_hash("content") == content_hash("old_content"), UNCHANGED).otherwise(CHANGED)
        self._state = self._keep(hashed.withColumn("status", status))
        moved = self._state.filter(F.col("status") == CHANGED)
        side = lambda s, c: moved.select(F.col("spec").alias("pair_id"), F.lit(s).alias("side"), "source", F.col(c).alias("content"))
        self._diff = DocumentDiff(side("old", "old_content").unionByName(side("new", "content")))
        self._first = self._keep(load(self._state.filter(F.col("status") == BASELINE).select("spec", "source", "content")), BATCH_DOCUMENTS)
        found = self._diff.changes().withColumn("id", F.concat_ws(":", "pair_id", "id"))  # the same change in two specs is two
        broken = self._diff.problems().select("pair_id").distinct()
        self.changes = self._keep(found.join(broken, "pair_id", "left_anti"))
        if files is None:
            self.edits = None
        else:
            sites = call_sites.find_sites(files, self.changes.withColumn("repo", F.col("pair_id")))
            self.edits = self._keep(edits.plan_edits(sites, self.changes))

    def _keep(self, df: DataFrame, batch: int | None = None) -> DataFrame:
        out, path = written(df, "check", batch=batch)
        self._paths.append(path)
        return out

    def outcomes(self) -> DataFrame:
        """spec, status, old_version, new_version, breaking, sites, applied, review, error; what does not apply is null."""
        version = lambda s: self._diff.loaded.filter(F.col("side") == s).select(F.col("pair_id").alias("spec"), F.col("version").alias(f"{s}_version"), F.col("problem").alias(f"{s}_problem"))
        first = self._first.select("spec", F.col("version").alias("first_version"), F.col("problem").alias("first_problem"))
        count = self.changes.groupBy(F.col("pair_id").alias("spec")).agg(F.count_if("breaking").alias("n_breaking"))
        joined = self._state.select("spec", "status").join(version("old"), "spec", "left").join(version("new"), "spec", "left").join(first, "spec", "left").join(count, "spec", "left")
        if self.edits is not None:
            of = self.edits.groupBy(F.col("repo").alias("spec")).agg(F.count("*").alias("n_sites"), F.count_if(F.col("action") == "apply").alias("n_applied"), F.count_if(F.col("action") == "review").alias("n_review"))
            joined = joined.join(of, "spec", "left")
        error = F.coalesce("new_problem", "old_problem", "first_problem")
        changed = error.isNull() & (F.col("status") == CHANGED)
        number = lambda c: F.when(changed, F.coalesce(F.col(c) if c in joined.columns else F.lit(None), F.lit(0))).cast("long").alias(c.removeprefix("n_"))
        good = lambda *c: F.when(error.isNull(), F.coalesce(*c))
        return joined.select(
            "spec", F.when(error.isNotNull(), FAILED).otherwise(F.col("status")).alias("status"), good("old_version").alias("old_version"), good("new_version", "first_version").alias("new_version"),
            *[number(c) for c in ("n_breaking", "n_sites", "n_applied", "n_review")], error.alias("error"),
        )

    def exit_code(self) -> DataFrame:
        return history.exit_code(self.outcomes().select((F.col("status") == FAILED).alias("failed"), F.coalesce("breaking", F.lit(0)).alias("breaking")))

    def snapshots(self) -> DataFrame:
        """spec, content: the new baselines of specs that were read well, the old ones of all others."""
        good = self.outcomes().filter(F.col("status").isin(BASELINE, CHANGED)).select("spec")
        return history.upsert(self._old.withColumnRenamed("old_content", "content"), self._state.join(good, "spec", "left_semi").select("spec", "content"), ["spec"])

    def close(self) -> None:
        """Remove the written tables when the frames have been written elsewhere."""
        self._diff.close()
        discard(self._spark, *self._paths)
        self._paths = []
