"""Connected components of an edge table, by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.llm.common import discard, materialize


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, component = smallest node reachable) of every node of `edges` (a, b); also the path of that table.

    Each round every node hooks to its smallest neighbour, hooks are followed four steps, and the edges are rewritten to what
    they then join; an edge from a node to its own hook stays where the hook is not yet settled, so nothing is lost. Rounds
    grow with the logarithm of a component's diameter; each is written to the shared folder.
    """
    spark = edges.sparkSession
    label, label_path = None, None
    live, live_path = materialize(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct(), "cc-edges")
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook, hook_path = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "cc-hook")
        twice = hook.join(hook.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up"))
        up, up_path = materialize(twice.join(twice.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up")), "cc-up")
        if label is None:
            new, new_path = materialize(up.select("node", F.col("up").alias("component")), "cc-label")
        else:
            moved = up.select(F.col("node").alias("component"), "up")
            new, new_path = materialize(label.join(moved, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "cc-label")
        a = up.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        b = up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        rest, rest_path = materialize(live.join(a, "a").join(b, "b").filter("ua <> ub").select(F.col("ua").alias("a"), F.col("ub").alias("b")).distinct(), "cc-edges")
        discard(spark, label_path, live_path, hook_path, up_path)
        label, label_path, live, live_path = new, new_path, rest, rest_path
    discard(spark, live_path)
    if label is None:
        label, label_path = materialize(spark.createDataFrame([], "node long, component long"), "cc-label")
    return label, label_path
