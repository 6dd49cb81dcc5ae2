"""Results as JSON lines, one small row each: files for other programs to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The names that changes, their targets and check outcomes have in JSON.
CHANGE = {"id": "id", "kind": "kind", "breaking": "breaking", "confidence": "confidence", "path": "path", "method": "method", "operation_id": "operationId", "direction": "direction", "detail": "detail"}
TARGET = {"location": "location", "from_name": "from", "to_name": "to", "from_type": "fromType", "to_type": "toType"}
OUTCOME = {"spec": "spec", "status": "status", "old_version": "oldVersion", "new_version": "newVersion", "breaking": "breaking", "sites": "sites", "applied": "applied", "review": "review", "error": "error"}

EDIT = {"change_id": "changeId", "file": "file", "line": "line", "start_at": "start", "end_at": "end", "strategy": "strategy", "confidence": "confidence", "action": "action", "snippet": "before", "replacement": "after", "outcome": "outcome"}
PULL_REQUEST = {"title": "title", "digest": "branch", "files_changed": "filesChanged", "applied": "appliedCount", "review": "reviewCount", "body": "body"}


def _named(names: dict[str, str]) -> list[Column]:
    return [F.col(c).alias(n) for c, n in names.items()]


def change_lines(changes: DataFrame) -> DataFrame:
    """pair_id, json: each change as an object without its nulls; what it is about stands in `target`."""
    target = F.when(F.coalesce(*TARGET).isNotNull(), F.struct(*_named(TARGET))).alias("target")
    return changes.select("pair_id", F.to_json(F.struct(*_named(CHANGE), target)).alias("json"))


def outcome_lines(outcomes: DataFrame) -> DataFrame:
    """json: each outcome of a check as an object without its nulls."""
    return outcomes.select(F.to_json(F.struct(*_named(OUTCOME))).alias("json"))
