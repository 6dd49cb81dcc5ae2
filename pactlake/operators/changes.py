"""The change record: one schema for every operator that reports a difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.functions.text import change_id

#: Confidences by rank.
CONFIDENCES = ("low", "medium", "high")
LOW, MEDIUM, HIGH = 0, 1, 2
COLUMNS = ("pair_id", "id", "kind", "breaking", "confidence", "direction", "path", "method", "operation_id", "location", "from_name", "to_name", "from_type", "to_type", "detail")


def rank_of(confidence: Column) -> Column:
    return F.when(confidence == "high", HIGH).when(confidence == "medium", MEDIUM).otherwise(LOW)


def confidence_of(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CONFIDENCES)), rank + 1)


def make_changes(df: DataFrame, kind, breaking, detail: Column, rank: Column | None = None, direction=None, location=None, **named) -> DataFrame:
    """Change rows from a frame with pair_id, path and perhaps method and operation_id.

    `kind`, `breaking`, `direction` and `location` may be values or columns; from_name, to_name, from_type, to_type,
    path, method and operation_id are columns (missing: null, but for the frame's own path, method and operation_id).
    """
    as_col = lambda v, t="string": v if isinstance(v, Column) else F.lit(v).cast(t)
    own = {c: named.get(c, F.col(c) if c in df.columns else None) for c in ("path", "method", "operation_id")}
    rest = {c: named.get(c) for c in ("from_name", "to_name", "from_type", "to_type")}
    v = {c: as_col(x) for c, x in {"kind": kind, "direction": direction, "location": location, **own, **rest}.items()}
    v |= {"breaking": as_col(breaking, "boolean"), "detail": detail, "confidence": confidence_of(rank if rank is not None else F.lit(HIGH)), "pair_id": F.col("pair_id")}
    v["id"] = change_id(*[v[c] for c in ("kind", "method", "path", "location", "from_name", "to_name", "from_type", "to_type")])
    return df.select(*[v[c].alias(c) for c in COLUMNS])


def sort_changes(changes: DataFrame) -> DataFrame:
    """Breaking first, then path, method, kind, from_name and id in locale order, within each pair."""
    keys = [F.collate(F.coalesce(F.col(c), F.lit("")), "UNICODE") for c in ("path", "method", "kind", "from_name", "id")]
    return changes.orderBy("pair_id", F.desc("breaking"), *keys)
