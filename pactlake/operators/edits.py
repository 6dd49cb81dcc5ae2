"""Planning and applying text edits: scoring, routing, overlap removal and splicing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.functions.text import branch_digest
from pactlake.operators.changes import HIGH, LOW, confidence_of, rank_of

REVIEW, NO_TEXT, CLASH = "needs human review", "no replacement text", "overlaps another edit at the same location"


def plan_edits(sites: DataFrame, changes: DataFrame) -> DataFrame:
    """sites (change_id, confidence, codemod, ...) left-joined to changes (id, confidence): the weakest signal decides.

    Only high confidence is applied. A site whose change is unknown counts as low.
    """
    known = changes.select(F.col("id").alias("change_id"), rank_of(F.col("confidence")).alias("_rank")).dropDuplicates(["change_id"])
    joined = sites.join(known, "change_id", "left")
    rank = F.least(F.coalesce("_rank", F.lit(LOW)), rank_of(F.col("confidence")), F.when(F.col("codemod").isNotNull(), HIGH).otherwise(LOW))
    return joined.withColumns({"confidence": confidence_of(rank), "action": F.when(rank == HIGH, "apply").otherwise("review"), "strategy": F.coalesce("codemod", F.lit("review-note"))}).drop("_rank")


def skip_reason(action: Column | str = "action", confidence: Column | str = "confidence", after: Column | str = "after_text") -> Column:
    """Why an edit is not applied, null where it may be."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.when((c(action) != "apply") | (c(confidence) != "high"), REVIEW).when(c(after).isNull(), NO_TEXT)


def mark_overlaps(edits: DataFrame, file: str = "file", start: str = "start_at", end: str = "end_at") -> DataFrame:
    """`overlaps`: whether another edit of the file meets [start, end). Touching edits do not.

    Two running extremes over the sorted edits of a file replace the pairwise test. Empty edits meet what strictly holds them.
    """
    order = [F.col(start), F.col(end)]
    before = Window.partitionBy(file).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(file).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    hit = (F.coalesce(F.max(end).over(before) > F.col(start), F.lit(False)) & (F.col(end) > F.coalesce(F.min(start).over(before), F.col(end)))) | F.coalesce(F.min(start).over(after) < F.col(end), F.lit(False))
    return edits.withColumn("overlaps", hit)


def route_edits(edits: DataFrame) -> DataFrame:
    """`reason`: null for edits that are safe to apply."""
    reasoned = edits.withColumn("reason", skip_reason())
    open_ = mark_overlaps(reasoned.filter("reason IS NULL"))
    return open_.withColumn("reason", F.when(F.col("overlaps"), CLASH)).drop("overlaps").unionByName(reasoned.filter("reason IS NOT NULL"))


def splice(edits: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, content of changed files; edits with `applied`). edits: file, start_at, end_at, text, after_text; files: file, content.

    Safe edits of a file are folded back to front; one whose text is no longer at its place is left out.
    """
    joined = edits.join(files, "file")
    here = F.substr(F.col("content"), F.col("start_at").cast("int") + 1, (F.col("end_at") - F.col("start_at")).cast("int"))
    marked = joined.withColumn("applied", here == F.col("text"))
    item = F.struct((-F.col("start_at")).alias("k"), "start_at", "end_at", "after_text")
    folded = marked.filter("applied").groupBy("file").agg(F.first("content").alias("content"), F.array_sort(F.collect_list(item)).alias("e"))
    out = F.aggregate("e", F.col("content"), lambda acc, e: F.concat(F.substr(acc, F.lit(1), e["start_at"].cast("int")), e["after_text"], F.substr(acc, e["end_at"].cast("int") + 1)))
    changed = folded.select("file", "content", out.alias("new")).filter("new <> content").select("file", F.col("new").alias("content"))
    return changed, marked.drop("content")


def dedupe_sites(sites: DataFrame, order: str = "ord", place: list[str] | None = None) -> DataFrame:
    """One site for each (file, start, end, reason): the first with a replacement, else the first. `place`: columns that name a file."""
    w = Window.partitionBy(*(place or ["file"]), "start_at", "end_at", "reason").orderBy(F.col("replacement").isNull(), order)
    return sites.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


#: The sentences of an update's description.
TITLE = "Update API usage for %d breaking changes"
SUMMARY = "## Spec change summary\n\n%d breaking changes across %d total.\nFound %d affected locations in the codebase.\n"
PATCHED, PATCHED_NONE = "## Patched automatically (high confidence)\n", "Nothing met the bar for an automatic edit."
OPEN, OPEN_NONE = "\n## Needs human review (low confidence)\n", "Nothing left for review."


def pull_request(edits: DataFrame, changes: DataFrame, of: list[str] | None = None) -> DataFrame:
    """One row: counters, branch digest and body of one update; one for each value of the columns `of`, if named.

    All edits of an update stand in its body, as its reader needs.
    """
    of = of or []
    place = F.concat(F.lit("`"), "file", F.lit(":"), F.col("line").cast("string"), F.lit("` "))
    item = lambda action, *text: F.array_sort(F.collect_list(F.when(F.col("action") == action, F.struct("file", "line", F.concat(*text).alias("t")))))
    by = edits.groupBy(*of).agg(
        F.count_if(F.col("action") == "apply").alias("applied"), F.count_if(F.col("action") == "review").alias("review"), F.countDistinct(F.when(F.col("action") == "apply", F.col("file"))).alias("files_changed"), F.count("*").alias("sites"),
        item("apply", F.lit("- "), place, "snippet", F.lit(" -> "), F.coalesce("replacement", F.lit(""))).alias("a"), item("review", F.lit("- [ ] "), place, "reason").alias("r"),
    )
    ch = changes.groupBy(*of).agg(F.count("*").alias("total"), F.count_if("breaking").alias("breaking"), branch_digest(F.collect_list("id")).alias("digest"))
    lines = lambda c, none: F.when(F.size(c) == 0, F.lit(none)).otherwise(F.array_join(F.transform(c, lambda s: s["t"]), "\n"))
    body = F.concat_ws("\n", F.format_string(SUMMARY, "breaking", "total", "sites"), F.lit(PATCHED), lines(F.col("a"), PATCHED_NONE), F.lit(OPEN), lines(F.col("r"), OPEN_NONE))
    one = ch.join(by, of, "left").fillna(0, ["applied", "review", "files_changed", "sites"]) if of else by.join(ch)  # else one row beside one row
    empty = F.array().cast("array<struct<file:string,line:int,t:string>>")
    return one.withColumns({c: F.coalesce(c, empty) for c in ("a", "r")}).select(*of, "applied", "review", "files_changed", "total", "breaking", "digest", F.format_string(TITLE, "breaking").alias("title"), body.alias("body"))


def safe_name(file: Column) -> Column:
    """Whether a file's name stays below the folder it is written to."""
    return ~file.startswith("/") & ~F.array_contains(F.split(file, r"[/\\\\]"), "..") & ~file.contains(":")


def write_patched(files: DataFrame, root: str) -> DataFrame:
    """Write changed files (file, content) under `root`, a folder in any store that Spark reaches, as a table of name and text.

    An explicit act, never part of planning. Names that leave the folder are refused: they are returned, not written.
    """
    files.filter(safe_name(F.col("file"))).select("file", "content").write.mode("overwrite").parquet(root)
    return files.filter(~safe_name(F.col("file"))).select("file")
