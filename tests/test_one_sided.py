"""Changes of one kind are made without the work of the others, and are the same."""

import random

import pytest
from pyspark.sql import functions as F

from pactlake.operators import diff

FIELD = "pair_id string, op string, direction string, pointer string, name string, parent string, required boolean, type string, schema_fp string, enum_values array<string>, ord int"


def _sides(spark):
    r, sides = random.Random(5), []
    for _ in range(2):
        keys = sorted({(op, d, p) for op in "abcdef" for d in ("request", "response") for p in "uvwxyz" if r.random() < 0.5})
        sides.append(spark.createDataFrame([("p", op, d, p, p, "", r.random() < 0.5, (t := r.choice(["string", "integer", "number"])), t, r.choice([None, ["1"], ["1", "2"]]), i) for i, (op, d, p) in enumerate(keys)], FIELD))
    context = spark.createDataFrame([("p", op, "/" + op, "get", op, 2) for op in "abcde"], "pair_id string, op string, path string, method string, operation_id string, rank int")
    return context, *sides


def _rows(df):
    return sorted(map(str, df.collect()))


def test_matched_rows_alone(spark):
    sides = _sides(spark)
    kinds = F.col("kind").rlike("changed|became|enum")
    want = _rows(diff.field_changes(*sides).filter(kinds))
    assert want and _rows(diff.field_changes(*sides, diff.MATCHED)) == want


@pytest.mark.parametrize(("only", "way"), [(diff.REMOVED_ALONE, 1), (diff.ADDED_ALONE, -1)])
def test_rows_of_one_sided_classes(spark, only, way):
    context, old, new = _sides(spark)
    here, there = (old, new)[::way]
    keys, same = diff.FIELD_KEYS, [*diff.OP, *diff.FIELD_CLASS]
    alone = diff.unmatched(diff.unmatched(here, there, keys), diff.unmatched(there, here, keys), same).select("op", "direction", "pointer")
    got = diff.field_changes(context, old, new, only)
    name = "from_name" if way == 1 else "to_name"
    want = diff.field_changes(context, old, new).filter(F.col("kind").rlike("field.removed|added.required")).filter(f"{name} IS NOT NULL")
    want = want.join(alone.select(F.concat(F.lit("/"), "op").alias("path"), "direction", F.col("pointer").alias(name)), ["path", "direction", name], "left_semi").select(got.columns)
    assert _rows(want) and _rows(got) == _rows(want)


def test_a_class_of_nulls_agrees_with_nothing(spark):
    row = lambda p: [("p", "a", "response", p, p, "", False, None, None, None, 0)]
    context = spark.createDataFrame([("p", "a", "/a", "get", "a", 2)], "pair_id string, op string, path string, method string, operation_id string, rank int")
    got = diff.field_changes(context, spark.createDataFrame(row("u"), FIELD), spark.createDataFrame(row("v"), FIELD), diff.REMOVED_ALONE)
    assert [(r.kind, r.from_name) for r in got.collect()] == [("response.field.removed", "u")]
