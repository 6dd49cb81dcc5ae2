"""Cascades: the removal or type change of a parent hides the changes under it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What makes the changes of one operation and direction a unit.
SCOPE = ("pair_id", "path", "method", "operation_id", "direction")


def ancestors(pointer: Column) -> Column:
    """Proper prefixes of a pointer that end before `.` or `[]`; null where there is neither."""
    cut = F.filter(F.sequence(F.lit(1), F.greatest(F.length(pointer) - 1, F.lit(1))), lambda i: (F.substr(pointer, i + 1, F.lit(1)) == ".") | (F.substr(pointer, i + 1, F.lit(2)) == "[]"))
    nested = F.contains(pointer, F.lit(".")) | F.contains(pointer, F.lit("[]"))
    return F.when(nested, F.transform(cut, lambda i: F.substr(pointer, F.lit(1), i)))


def shadowed(changes: DataFrame, scope: tuple[str, ...] = SCOPE) -> DataFrame:
    """`changes` with `shadow`: the outermost removed or type-changed ancestor of from_name, null where there is none.

    The shadowing pointers of a unit stand beside each of its rows; a unit is one operation's direction, so both are small.
    """
    casts = F.endswith("kind", F.lit(".type.changed")) | F.endswith("kind", F.lit(".field.removed"))
    keyed = changes.withColumn("_casts", F.collect_set(F.when(casts, F.col("from_name"))).over(Window.partitionBy(*scope)))
    return keyed.withColumn("shadow", F.get(F.array_intersect(ancestors(F.col("from_name")), "_casts"), F.lit(0))).drop("_casts")


def suppress_cascades(changes: DataFrame, scope: tuple[str, ...] = SCOPE) -> DataFrame:
    """Without shadowed changes; a survivor tells how many changes below its from_name are hidden."""
    marked = shadowed(changes, scope)
    below = Window.partitionBy(*scope, F.coalesce("shadow", "from_name"))
    kept = marked.withColumn("_n", F.count("shadow").over(below)).filter("shadow IS NULL")
    detail = F.when(F.col("_n") > 0, F.concat("detail", F.lit(", along with "), F.col("_n").cast("string"), F.lit(" nested fields below it"))).otherwise(F.col("detail"))
    return kept.withColumn("detail", detail).select(changes.columns)
