"""From changes and source files to patched files, pull requests and the result as JSON."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.operators import artifacts, call_sites, edits
from pactlake.work import discard, written

#: Between repository and file in the key of a file.
SEP = "\u0001"


class Fix:
    """Frames of one update of the files (repo, file, content) for changes (id, repo, ...): `edits`, `patched`, `pull_requests`.

    edits: the planned edits with `outcome`: applied, or why not. patched: repo, file, content of files that change. Nothing
    is written to the files themselves.
    """

    def __init__(self, files: DataFrame, changes: DataFrame, wrappers: Iterable | DataFrame = (), base_urls: DataFrame | None = None) -> None:
        self._spark, self._paths = files.sparkSession, []
        self.changes = changes
        planned = edits.plan_edits(call_sites.find_sites(files, changes, wrappers, base_urls), changes).withColumn("after_text", F.col("replacement"))
        keyed = lambda df: df.withColumn("file", F.concat_ws(SEP, "repo", "file"))
        routed = self._keep(edits.route_edits(keyed(planned)))
        patched, marked = edits.splice(routed.filter("reason IS NULL").drop("repo"), keyed(files).select("file", "content"))
        split = lambda df: df.withColumns({"repo": F.substring_index("file", SEP, 1), "file": F.element_at(F.split("file", SEP), 2)})
        self.patched = self._keep(split(patched).select("repo", "file", "content"))
        lost = F.concat(F.lit("the text at offset "), F.col("start_at").cast("string"), F.lit(" is no longer "), F.col("text"))
        done = split(marked).withColumn("outcome", F.when(F.col("applied"), "applied").otherwise(lost)).drop("applied", "reason")
        self.edits = self._keep(done.unionByName(split(routed.filter("reason IS NOT NULL")).withColumn("outcome", F.col("reason")).drop("reason"), allowMissingColumns=True))

    def _keep(self, df: DataFrame) -> DataFrame:
        out, path = written(df, "fix")
        self._paths.append(path)
        return out

    def pull_requests(self) -> DataFrame:
        """One row a repository: repo, counters, branch digest, title and body."""
        return edits.pull_request(self.edits.withColumn("reason", F.col("outcome")), self.changes, ["repo"])

    def lines(self) -> DataFrame:
        """repo, part (change, edit, pull_request), json: the result for other programs."""
        change = artifacts.change_lines(self.changes.withColumn("pair_id", F.col("repo"))).select(F.col("pair_id").alias("repo"), F.lit("change").alias("part"), "json")
        edit = self.edits.select("repo", F.lit("edit").alias("part"), F.to_json(F.struct(*[F.col(c).alias(n) for c, n in artifacts.EDIT.items()])).alias("json"))
        pull = self.pull_requests().select("repo", F.lit("pull_request").alias("part"), F.to_json(F.struct(*[F.col(c).alias(n) for c, n in artifacts.PULL_REQUEST.items()])).alias("json"))
        return change.unionByName(edit).unionByName(pull)

    def close(self) -> None:
        discard(self._spark, *self._paths)
        self._paths = []
