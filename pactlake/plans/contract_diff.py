"""The whole comparison of document pairs: load, normalise, match, diff, fold cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.operators import diff, matching
from pactlake.operators.changes import HIGH
from pactlake.sources.documents import Model, load
from pactlake.work import discard, written


#: Documents that a Python worker holds at a time.
BATCH_DOCUMENTS = 64


class DocumentDiff:
    """Frames of one comparison: `loaded`, `model`, `header`, `changes`. `specs`: pair_id, side (old, new), source, content.

    Tables that several comparisons read are written to the shared folder once: each plan stays short, and a lost
    executor costs its tasks only. `close` removes them when the changes have been written elsewhere.
    """

    def __init__(self, specs: DataFrame) -> None:
        self._spark, self._paths = specs.sparkSession, []
        # A row an operation; what a document says besides them stands in its first row.
        found = load(specs, whole=False)
        read = self._keep(found.select(*[c for c in found.columns if c != "operations"], F.posexplode_outer("operations").alias("at", "o")).withColumn("head", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("head"))), BATCH_DOCUMENTS)
        self.loaded = read.filter("coalesce(at, 0) = 0").drop("at", "o")
        self.model = Model(self.loaded, read.filter("at IS NOT NULL").select("pair_id", "side", "o"))
        self._ops = self._keep(self.model.operations())
        self._fields = self._keep(self.model.fields())
        self._params = self._keep(self.model.params())
        self._paired = None

    def _keep(self, df: DataFrame, batch: int | None = None) -> DataFrame:
        out, path = written(df, "contract", batch=batch)
        self._paths.append(path)
        return out

    def close(self) -> None:
        """Remove the written tables; frames made from them can't be read afterwards."""
        discard(self._spark, *self._paths)
        self._paths = []

    def problems(self) -> DataFrame:
        return self.loaded.filter("problem IS NOT NULL").select("pair_id", "side", "source", "problem")

    @staticmethod
    def _side(df: DataFrame, side: str) -> DataFrame:
        return df.filter(F.col("side") == side).drop("side")

    def _shape(self, ops: DataFrame, side: str) -> DataFrame:
        """Operations with the pointers of both payloads, for the resemblance of renamed ones."""
        f = self._side(self._fields, side).groupBy("pair_id", "op_key").pivot("direction", ["request", "response"]).agg(F.collect_set("pointer"))
        empty = F.array().cast("array<string>")
        joined = ops.join(f, ["pair_id", "op_key"], "left")
        return joined.withColumns({c: F.coalesce(c, empty) for c in ("request", "response")})

    def paired(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(paired operations with old and new keys and rank, removed, added)."""
        if self._paired is None:
            self._paired = tuple(self._keep(df) for df in self._pair())
        return self._paired

    def _pair(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        old, new = self._side(self._ops, "old"), self._side(self._ops, "new")
        matched, removed, added = diff.match_operations(old, new)
        r, a = self._shape(removed, "old"), self._shape(added, "new")
        renames = matching.operation_renames(r, a)
        named = lambda df, o: df.select("pair_id", F.col("ord").alias(o), F.col("op_key").alias(o.replace("ord", "key")))
        moved = renames.join(named(removed, "from_ord"), ["pair_id", "from_ord"]).join(named(added, "to_ord"), ["pair_id", "to_ord"])
        pairs = matched.select("pair_id", F.col("op_key").alias("from_key"), F.col("op_key").alias("to_key"), F.lit(HIGH).alias("rank"), F.lit(False).alias("renamed"))
        pairs = pairs.unionByName(moved.select("pair_id", "from_key", "to_key", F.col("conf").alias("rank"), F.lit(True).alias("renamed")))
        left = lambda df, k: diff.unmatched(df, pairs.withColumnRenamed(k, "op_key"), ["pair_id", "op_key"])
        return pairs, left(removed, "from_key"), left(added, "to_key")

    def changes(self) -> DataFrame:
        pairs, removed, added = self.paired()
        old, new = self._side(self._ops, "old"), self._side(self._ops, "new")
        flags = ("deprecated", "security", "own_security", "request_types", "response_types", "statuses")
        a = old.select("pair_id", F.col("op_key").alias("from_key"), "path", "method", "operation_id", "ord", *[F.col(c).alias(f"old_{c}") for c in flags])
        b = new.select("pair_id", F.col("op_key").alias("to_key"), F.col("path").alias("to_path"), *[F.col(c).alias(f"new_{c}") for c in flags])
        full = self._keep(pairs.join(a, ["pair_id", "from_key"]).join(b, ["pair_id", "to_key"]))
        context = self._keep(full.select("pair_id", F.col("from_key").alias("op"), "path", "method", "operation_id", "rank"))
        moved = full.filter("renamed").withColumn("from_path", F.col("path"))
        from_side = lambda df: self._side(df, "old").withColumnRenamed("op_key", "op")
        to_side = lambda df: self._side(df, "new").join(pairs.select("pair_id", F.col("from_key").alias("op"), F.col("to_key").alias("op_key")), ["pair_id", "op_key"]).drop("op_key")
        servers, security, schemes = self.model.servers(), self.model.security(), self.model.schemes()
        both = lambda df: (self._side(df, "old"), self._side(df, "new"))
        return diff.union_all([
            diff.diff_servers(*both(servers)), diff.diff_security(*both(security), *both(schemes)), diff.path_renames(moved),
            diff.diff_operation_flags(full), diff.diff_statuses(full), diff.diff_content_types(full, "request"), diff.diff_content_types(full, "response"),
            diff.diff_params(context, from_side(self._params), to_side(self._params)), diff.diff_fields(context, from_side(self._fields), to_side(self._fields)),
            diff.unpaired_changes(removed, "operation.removed", True, "removed"), diff.unpaired_changes(added, "operation.added", False, "added"),
        ])

    def header(self) -> DataFrame:
        side = lambda s: self.loaded.filter(F.col("side") == s).select("pair_id", *[F.col(c).alias(f"{s}_{c}") for c in ("title", "version", "source", "primary_server")])
        return side("old").join(side("new"), "pair_id", "full")


def diff_documents(specs: DataFrame) -> DataFrame:
    """Changes of every pair of documents."""
    return DocumentDiff(specs).changes()
