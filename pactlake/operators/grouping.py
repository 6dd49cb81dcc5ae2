"""Groups of identical changes across endpoints, summaries and the text report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.functions.text import endpoint_label, leaf_of
from pactlake.functions.vendor import looks_like_different_apis
from pactlake.operators.changes import CONFIDENCES

LISTED = 4
#: The words of the text report.
HEAD, COUNTS, TITLES = ("API diff: ", "  old  ", "  new  "), (" breaking, ", " non breaking"), ("BREAKING", "NON BREAKING")
WARNING, NONE, SHARED = '  WARNING: these look like different APIs, "', "  no differences found", " distinct changes, some shared across endpoints"


def group_key() -> Column:
    """Kind, direction, breaking, leaves, types and the wording with pointers cut to their leaves."""
    a, b = leaf_of("from_name"), leaf_of("to_name")
    detail = F.when(a.isNotNull(), F.replace(F.col("detail"), F.col("from_name"), a)).otherwise(F.col("detail"))
    detail = F.when(b.isNotNull(), F.replace(detail, F.col("to_name"), b)).otherwise(detail)
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat_ws("|", F.col("kind"), blank(F.col("direction")), F.when(F.col("breaking"), "breaking").otherwise("safe"), blank(a), blank(b), blank(F.col("from_type")), blank(F.col("to_type")), detail)


def with_order(changes: DataFrame) -> DataFrame:
    """`ord`: the place of each change in report order within its pair."""
    keys = [F.collate(F.coalesce(F.col(c), F.lit("")), "UNICODE") for c in ("path", "method", "kind", "from_name", "id")]
    return changes.withColumn("ord", F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("breaking"), *keys)))


def group_changes(changes: DataFrame) -> DataFrame:
    """One row a group of changes with `ord`: pair_id, first (its representative), changes, endpoints, ord.

    Groups and endpoints stand in the order in which they are first seen. Two steps, so that a change shared by very many
    endpoints is counted by label first.
    """
    keyed = changes.withColumns({"_key": group_key(), "_label": endpoint_label("method", "path")})
    rest = [c for c in changes.columns if c not in ("pair_id", "ord")]
    labels = keyed.groupBy("pair_id", "_key", "_label").agg(F.min("ord").alias("ord"), F.count("*").alias("n"), F.min_by(F.struct(*rest), "ord").alias("first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("_label").alias("l")))), lambda s: s["l"])
    return labels.groupBy("pair_id", "_key").agg(F.min_by("first", "ord").alias("first"), F.sum("n").alias("changes"), ordered.alias("endpoints"), F.min("ord").alias("ord")).drop("_key")


def grouping_summary(changes: DataFrame) -> DataFrame:
    return changes.withColumn("_key", group_key()).groupBy("pair_id").agg(F.countDistinct("_key").alias("groups"), F.count("*").alias("total"))


def summary(changes: DataFrame) -> DataFrame:
    """Counts of each pair, zero where a confidence does not occur."""
    by = [F.count_if(F.col("confidence") == c).alias(c) for c in CONFIDENCES]
    return changes.groupBy("pair_id").agg(F.count("*").alias("total"), F.count_if("breaking").alias("breaking"), F.count_if(~F.col("breaking")).alias("non_breaking"), *by)


def kinds(changes: DataFrame) -> DataFrame:
    return changes.groupBy("pair_id", "kind").agg(F.count("*").alias("n")).orderBy("pair_id", F.desc("n"), "kind")


def describe(c: str = "first") -> Column:
    """Rename as an arrow, type change as an arrow of types, else the wording."""
    f = lambda n: F.col(f"{c}.{n}")
    arrow = F.concat_ws(" -> ", f("from_name"), f("to_name"))
    types = F.trim(F.concat_ws(" ", F.coalesce(f("from_name"), F.lit("")), F.concat_ws(" -> ", f("from_type"), f("to_type"))))
    return F.when(f("from_name") != f("to_name"), arrow).when(f("from_type").isNotNull() & f("to_type").isNotNull(), types).otherwise(f("detail"))


def listed_endpoints(endpoints: Column) -> Column:
    """The first LISTED endpoints, and how many more there are."""
    n = F.size(endpoints)
    return F.when(n > LISTED, F.array_append(F.slice(endpoints, 1, LISTED), F.concat(F.lit("and "), (n - LISTED).cast("string"), F.lit(" more")))).otherwise(endpoints)


def report_lines(changes: DataFrame, header: DataFrame, breaking_only: bool = False) -> DataFrame:
    """pair_id, section, ord, line of a text report; order by section, ord and the place in `lines`.

    header: pair_id, old_title, new_title, old_source, new_source, old_version, new_version.
    """
    shown = with_order(changes)
    if breaking_only:
        shown = shown.filter("breaking")
    groups = group_changes(shown).withColumn("shared", F.size("endpoints") > 1)
    head = F.when(F.col("shared"), F.concat(F.size("endpoints").cast("string"), F.lit(" endpoints"))).otherwise(F.col("endpoints")[0])
    body = F.array(F.concat(F.lit("  "), head), F.concat(F.lit("    "), F.col("first.kind"), F.lit("  ["), F.col("first.confidence"), F.lit("]")), F.concat(F.lit("      "), describe()))
    more = F.when(F.col("shared"), F.transform(listed_endpoints(F.col("endpoints")), lambda e: F.concat(F.lit("        "), e))).otherwise(F.array().cast("array<string>"))
    grouped = groups.select("pair_id", F.when(F.col("first.breaking"), 2).otherwise(4).alias("section"), "ord", F.concat(body, more, F.array(F.lit(""))).alias("lines"))
    total = header.join(summary(changes).drop("total"), "pair_id", "left").join(grouping_summary(changes).drop("total"), "pair_id", "left").fillna(0, ["breaking", "non_breaking", "groups"]).withColumn("total", F.col("breaking") + F.col("non_breaking"))
    warn = F.when(looks_like_different_apis("old_title", "new_title"), F.concat(F.lit(WARNING), "old_title", F.lit('" against "'), "new_title", F.lit('"')))
    blank, none = F.lit(""), F.col("total") == 0
    top = F.array_compact(F.array(
        F.concat(F.lit(HEAD[0]), "new_title"), F.concat(F.lit(HEAD[1]), "old_source", F.lit(" ("), "old_version", F.lit(")")), F.concat(F.lit(HEAD[2]), "new_source", F.lit(" ("), "new_version", F.lit(")")), blank,
        warn, F.when(warn.isNotNull(), blank), F.concat(F.lit("  "), F.col("breaking").cast("string"), F.lit(COUNTS[0]), F.col("non_breaking").cast("string"), F.lit(COUNTS[1])),
        F.when(F.col("groups") < F.col("total"), F.concat(F.lit("  "), F.col("groups").cast("string"), F.lit(SHARED))), blank, F.when(none, F.lit(NONE)), F.when(none, blank),
    ))
    sections = [total.select("pair_id", F.lit(0).alias("section"), F.lit(0).alias("ord"), top.alias("lines"))]
    for place, n, title in ((1, "breaking", TITLES[0]), (3, "non_breaking", TITLES[1])):
        if place == 1 or not breaking_only:
            sections.append(total.filter(F.col(n) > 0).select("pair_id", F.lit(place).alias("section"), F.lit(0).alias("ord"), F.array(F.concat(F.lit(f"{title} ("), F.col(n).cast("string"), F.lit(")")), F.lit("")).alias("lines")))
    out = grouped
    for s in sections:
        out = out.unionByName(s)
    return out.orderBy("pair_id", "section", "ord")
